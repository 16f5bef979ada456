"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; it is parsed here, and its normaliser, metaspace
marker, scores and byte fallback are rebuilt as a tokenizers model: unigram scores as they
are, BPE scores as the order of merges. Texts are normalised and cut into pieces that no
entry of the vocabulary crosses; only pieces that a worker has not met are encoded, in
multithreaded batches, and all others are looked up by hash in a table. A fixed share of
the documents is encoded by the sentencepiece library too, and the results compared.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import prepare, remainder
from cuelattice.llm.textscan import Scan, mix64, slices, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space
AUDIT = 1  # one document of so many is compared with the sentencepiece library
CACHE = 1 << 19  # pieces that a worker remembers, some 30 bytes each
GROUP = 256  # pieces that are encoded as the lines of one text
# Fixed values of the public model format: kinds of models and of vocabulary entries.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, 0x0A]] = True
_HARD = re.compile(b"  | \n|^[ \n]| $|\xe2\x96\x81|<0x|\xf4\x8f\xbf\xbf")  # what the table of pieces does not cover
_HIDDEN = "\U0010ffff"  # begins the names of entries that no text may match
_NAMES = re.compile(f"<0x[0-9A-F]{{2}}>|{_HIDDEN}")  # names of entries, where a text has them itself


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    pieces: list[tuple[str, float, int]] = field(default_factory=list)


def parse_model(message: bytes) -> Spec:
    """The parts of a sentencepiece model that encoding depends on."""
    spec = Spec()
    for number, value in _fields(message):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
                elif n == 24 and v:
                    raise ValueError("models with the marker behind words are not supported")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n in (3, 4, 5):
                    setattr(spec, {3: "dummy_prefix", 4: "strip_spaces", 5: "escape_spaces"}[n], bool(v))
    if spec.kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {spec.kind} are not supported")
    if any(k == USER_DEFINED for _, _, k in spec.pieces):
        raise ValueError("models with user-defined symbols are not supported")
    return spec


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, message: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        self.spec = spec = parse_model(message)
        self.message = message
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        self.normaliser = normalizers.Sequence(steps) if steps else None
        normal = {p: i for i, (p, _, k) in enumerate(spec.pieces) if k == NORMAL}
        unknown = next((i for i, (_, _, k) in enumerate(spec.pieces) if k == UNKNOWN), None)
        score = {p: s for p, s, k in spec.pieces if k == NORMAL}
        self.runs: dict[int, int] = {}
        if spec.kind == BPE:
            runs = {p for p in normal if set(p) == {MARK}}
            floor = min((s for p, s in score.items() if len(p) > 1 and p not in runs), default=0.0)
            if len({score[p] for p in runs if len(p) > 1}) == 1 and max(score[p] for p in runs if len(p) > 1) < floor:
                self.runs = {len(p): normal[p] for p in runs}  # merged last, from the left: see _merge_runs
            merges = []
            for p, i in normal.items():
                if len(p) > 1 and not (self.runs and p in runs):
                    merges += [(-score[p], i, c, (p[:c], p[c:])) for c in range(1, len(p)) if p[:c] in normal and p[c:] in normal]
            names = {p: i for i, (p, _, k) in enumerate(spec.pieces) if k in (NORMAL, BYTE, UNKNOWN)}
            name = spec.pieces[unknown][0] if unknown is not None else None
            model = models.BPE(names, [m[-1] for m in sorted(merges)], unk_token=name, fuse_unk=True, byte_fallback=spec.byte_fallback)
        else:
            vocab = [(p if k in (NORMAL, BYTE) else f"{_HIDDEN}{i}", s) for i, (p, s, k) in enumerate(spec.pieces)]
            model = models.Unigram(vocab, unk_id=unknown, byte_fallback=spec.byte_fallback)
            self.normal, self.unknown = {p: (s, i) for i, (p, s, k) in enumerate(spec.pieces) if k == NORMAL}, unknown
            self.longest = max(map(len, self.normal), default=1)
        self.tokenizer = Tokenizer(model)
        self.lines = not any("\n" in p for p in normal if len(p) > 1)  # no entry goes beyond a line
        self.whole = any(MARK in p.lstrip(MARK) for p in normal)  # entries that cross words: texts stay whole
        if self.lines:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        alone = "\n" if self.lines else ""
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.plain = self.lines and not self.whole and not spec.charsmap and spec.dummy_prefix and spec.escape_spaces
        self.line = np.array(self._ids("\n"), np.int32)
        self.plain = self.plain and len(self.line) == 1
        self.clear()
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(spec.pieces) if k == BYTE}
        self.bytes = []
        for p, _, k in spec.pieces:
            if k == BYTE:
                self.bytes.append(bytes([int(p[1:-1], 16)]))
            elif k == UNKNOWN:
                self.bytes.append(" ⁇ ".encode())
            else:
                self.bytes.append(b"" if k == CONTROL else p.replace(MARK, " ").encode())
        sizes = np.array([len(x) for x in self.bytes])
        self.sizes, self.places = sizes, np.cumsum(sizes) - sizes
        self.spelt = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.other = None

    def clear(self) -> None:
        """Forget all pieces."""
        self.known = np.zeros(0, np.uint64)  # hashes of pieces, sorted
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def _best(self, piece: str) -> list[int]:
        """Ids of the unigram path of the largest score, worked out without the library.

        For the few pieces that spell the name of an entry which is not theirs.
        """
        low = min((s for s, _ in self.normal.values()), default=0.0) - 10.0  # an unknown sign scores so much below the rest
        score, back = [0.0] + [-np.inf] * len(piece), [(0, -1)] * (len(piece) + 1)
        for i in range(len(piece)):
            for j in range(i + 1, min(len(piece), i + self.longest) + 1):
                s, k = self.normal.get(piece[i:j], (None, -1))
                if s is None and j == i + 1:
                    s = low
                if s is not None and score[i] + s > score[j]:
                    score[j], back[j] = score[i] + s, (i, k)
        out: list[list[int]] = []
        j, fused = len(piece), False
        while j:
            i, k = back[j]
            if k >= 0:
                out.append([k])
            elif self.spec.byte_fallback:
                out.append([self.byte_ids[b] for b in piece[i:j].encode()])
            elif not fused:
                out.append([self.unknown])
            j, fused = i, k < 0
        return [x for part in reversed(out) for x in part]

    def _ids(self, piece: str) -> list[int]:
        if self.spec.kind == UNIGRAM and _NAMES.search(piece):
            return self._best(piece)
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def normalise(self, text: str) -> str:
        """The text as the vocabulary spells it."""
        if self.normaliser:
            text = self.normaliser.normalize_str(text)
        if self.spec.strip_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if self.spec.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape_spaces else text

    def _merge_runs(self, ids: list[int]) -> list[int]:
        """Single markers in a row as the longest entries, joined in pairs from the left."""
        one = self.runs[1]
        out: list[int] = []
        i = 0
        while i < len(ids):
            if ids[i] != one:
                out.append(ids[i])
                i += 1
                continue
            stack: list[int] = []
            while i < len(ids) and ids[i] == one:
                stack.append(1)
                i += 1
                while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                    stack[-2:] = [stack[-2] + stack[-1]]
            out += [self.runs[n] for n in stack]
        return out

    def _slow(self, text: str) -> list[int]:
        """Ids of any text, piece by piece."""
        text = self.normalise(text)
        if self.whole:
            return self._ids(text) if text else []
        out: list[int] = []
        for piece in self.cut.findall(text):
            ids = self._ids(piece)
            out += self._merge_runs(ids) if self.runs and MARK + MARK in piece else ids
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Enter new pieces, which hold no line feed, in the table."""
        groups = ["\n".join(pieces[i : i + GROUP]) for i in range(0, len(pieces), GROUP)]
        flat, sizes = [], []
        for i, got in enumerate(self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array(got.ids, np.int32)
            ends = np.r_[np.flatnonzero(ids == self.line[0]), len(ids)]
            if len(ends) != len(pieces[i * GROUP : (i + 1) * GROUP]):
                raise ValueError("a piece holds a line feed")
            sizes.append(np.diff(np.r_[-1, ends]) - 1)
            flat.append(ids[ids != self.line[0]])
        size = np.concatenate(sizes)
        place = len(self.store) + np.cumsum(size) - size
        self.store = np.concatenate([self.store, *flat])
        order = np.argsort(keys)
        into = np.searchsorted(self.known, keys[order])
        self.known = np.insert(self.known, into, keys[order])
        self.at, self.count = np.insert(self.at, into, place[order]), np.insert(self.count, into, size[order])

    def _fast(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose words are parted by one space or by line feeds, and how many each has."""
        scan = Scan(texts, separator=_BREAKS)
        after = scan.data[scan.ws - 1] == 0x20
        keys = mix64(scan.hashes() + after.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        plain, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, plain), max(0, len(self.known) - 1))
        fresh = np.flatnonzero(self.known[at] != plain) if len(self.known) else np.arange(len(plain))
        if len(fresh):
            raw, own = scan.data.tobytes(), first[fresh]
            self._learn(plain[fresh], [MARK * int(m) + raw[a:b].decode() for m, a, b in zip(after[own], scan.ws[own].tolist(), scan.we[own].tolist(), strict=True)])
            at = np.searchsorted(self.known, plain)
        lines = np.flatnonzero(scan.data == 10)
        where = np.concatenate([scan.ws, lines])
        order = np.argsort(where, kind="stable")
        size = np.concatenate([self.count[at][place], np.ones(len(lines), np.int64)])[order]
        begin = np.concatenate([self.at[at][place], np.full(len(lines), len(self.store))])[order]
        ends = np.cumsum(size)
        flat = np.append(self.store, self.line)[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        until = np.r_[0, ends][np.searchsorted(where[order], scan.start)]
        return flat, np.diff(until)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        texts = [t or b"" for t in texts]
        easy = [self.plain and not _HARD.search(t) for t in texts]
        flat, count = self._fast([t if e else b"" for t, e in zip(texts, easy, strict=True)]) if any(easy) else (np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
        if all(easy):
            return flat, count
        ends = np.cumsum(count)
        parts = [flat[n - c : n] if e else np.array(self._slow(t.decode()), np.int32) for t, e, n, c in zip(texts, easy, ends, count, strict=True)]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def decode_all(self, flat: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The texts of ids one after another, count of them each, as UTF-8 or what the ids make of it."""
        size = self.sizes[flat]
        ends = np.cumsum(size)
        data = self.spelt[np.repeat(self.places[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.r_[0, ends][np.r_[0, np.cumsum(count)]].tolist()
        texts = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if self.spec.dummy_prefix and t[:1] == b" " else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_all(np.array(ids, np.int32), np.array([len(ids)]))[0].decode("utf-8", "replace")

    def agrees(self, text: str, ids: np.ndarray) -> bool:
        """Whether the sentencepiece library encodes the text alike."""
        if self.other is None:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=self.message)
        return self.other.encode(text) == ids.tolist()


@lru_cache(2)
def codec(message: bytes) -> Codec:
    return Codec(message)


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode(shared) -> Callable:  # shared: a broadcast model file
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                flat, count = own.encode(texts)
                ends = np.cumsum(count)
                back = [a == (b or b"") for a, b in zip(own.decode_all(flat, count), texts, strict=True)]
                audit = part.column(2).to_pylist()
                parity = [own.agrees((t or b"").decode(), flat[e - c : e]) if a else None for t, a, e, c in zip(texts, audit, ends, count, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
                more = part.columns[3:]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(back, pa.bool_()), pa.array(parity, pa.bool_()), *more], names=["doc_id", "ids", "round_trip", "parity", *part.schema.names[3:]]
                )

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, audit: int = AUDIT, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids (array of int), round_trip, parity and the columns in keep of every document.

    round_trip tells whether the ids, decoded, are the text again (a text with the marker
    itself is not: it comes back as a space). parity tells whether the sentencepiece
    library gives the same ids: for every document by default, or for one of audit by a
    checksum of its id, and null for the others. A null or empty text has no ids.
    Repeated rows keep a row each; extra columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    chosen = F.coalesce(remainder("doc_id", audit) == 0, F.lit(True))
    rows = docs.select("doc_id", "text", chosen.alias("_audit"), *keep)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_encode(shared), "doc_id long, ids array<int>, round_trip boolean, parity boolean" + kept)


def _decode(shared) -> Callable:  # shared: a broadcast model file
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            count = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            texts = own.decode_all(ids.flatten().to_numpy(zero_copy_only=False), count)
            text = [t.decode("utf-8", "replace") if there else None for t, there in zip(texts, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of a table with ids (array of int), all columns and repeats kept, and the text that these stand for.

    Null ids give a null text, no ids an empty one; a column text is replaced; an empty
    table gives no rows. Bytes that are no UTF-8 become U+FFFD. An id that the model lacks
    is an error.
    """
    prepare(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    rows = encoded.drop("text")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(shared), f"{kind}, text string")

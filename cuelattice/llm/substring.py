"""Removal of passages that an earlier document already has, with a count-min prefilter.

A window is 50 consecutive words of one document. Its anchor is the 16-word piece in it
with the smallest hash, so equal windows have equal anchors. The first pass counts anchors
in a count-min sketch: each chunk of texts sends its own counts to the shards of the sketch,
which add them up cell by cell and answer which anchors may occur in two documents. The
count of a window's anchor there is never below the window's own count, so the second pass
may leave out every window whose anchor was counted once. It groups exactly what is left,
by 96 bits of hash of its words: each chunk sends a window once, with the smallest doc_id
that has it there, to a bucket by the window's own hash, and is told whether another chunk
has it under a smaller one. Shards and buckets follow the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.chunks import buckets_for, chunked, heads, pack, places, rows_of, sent, steps, unpack
from cuelattice.llm.common import prepare
from cuelattice.llm.textscan import Scan, mix64, rolling, texts_of, window_starts

WINDOW, PIECE = 50, 16
CHUNK_BYTES = 8 << 20  # of text in a chunk, about
SHARD_BYTES, CELL_BITS = 64 << 20, 23  # of text for a shard of the sketch at most; a shard has two rows of 2**CELL_BITS cells
BUCKET_BYTES = 32 << 20  # of text for each bucket of windows at most
_U = np.uint64
_PLACE_BITS = 28  # of a hash that give way to a word's number while the smallest is sought
_SENT = "bucket int, chunk long, blob binary"


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k consecutive values."""
    n, have = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= k:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[k - have : k - have + n])


def _anchors(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the first words of all windows and the anchor of each of those windows.

    The anchor is the first piece whose hash has the smallest upper bits, so that equal
    windows have the same.
    """
    words = scan.hashes()
    start = window_starts(scan.ptr, WINDOW)
    pieces = rolling(words, PIECE)
    low = _U((1 << _PLACE_BITS) - 1)
    least = _sliding_min((pieces & ~low) | (np.arange(len(pieces), dtype=np.uint64) & low), WINDOW - PIECE + 1)[start]
    return words, start, mix64(pieces[(least & low).astype(np.int64)])


class Windows:
    """The windows of a chunk's documents; rows without a doc_id have none.

    scans: one for each slice of rows. Of all windows: anchor; doc: the doc_id; at and part:
    the first word in the slice, and which slice. words: the word hashes of each slice.
    """

    def __init__(self, blob: bytes) -> None:
        self.parts = rows_of(blob)
        self.scans, self.words, found = [], [], []
        for i, part in enumerate(self.parts):
            scan = Scan(texts_of(part))
            words, start, anchor = _anchors(scan)
            owner = np.searchsorted(scan.ptr, start, "right") - 1
            doc = part.column(0)
            known = ~np.asarray(doc.is_null())[owner]
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False)[owner]
            found.append((anchor[known], doc[known], owner[known].astype(np.int32), start[known].astype(np.int32), np.full(int(known.sum()), i, np.int32)))
            self.scans.append(scan)
            self.words.append(words)
        self.anchor, self.doc, self.row, self.at, self.part = map(np.concatenate, zip(*found, strict=True))

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors in order, and in how many rows each occurs."""
        head = np.flatnonzero(np.r_[True, (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1]) | (self.part[1:] != self.part[:-1])]) if len(self.anchor) else []
        anchor, row = self.anchor[head], self.row[head] + (self.part[head].astype(np.int64) << 32)
        order = np.lexsort((row, anchor))
        anchor, row = anchor[order], row[order]
        first = heads(anchor)
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])].astype(np.int64) if len(anchor) else np.zeros(0, np.int64)
        return anchor[first], np.add.reduceat(fresh, first) if len(first) else fresh

    def repeated(self, several: np.ndarray) -> np.ndarray:
        """Indexes of the windows whose anchor may be repeated; several: what the sketch says of anchors."""
        known, _ = self.anchors
        marked = known[several]
        if not len(marked):
            return np.zeros(0, np.int64)
        run = heads(self.anchor) if len(self.anchor) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(marked, self.anchor[run]), len(marked) - 1)
        return np.flatnonzero(np.repeat(marked[at] == self.anchor[run], np.diff(np.r_[run, len(self.anchor)])))

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of some windows, of 64 and 32 bits."""
        out = np.empty(len(some), np.uint64)
        cut = np.searchsorted(self.part[some], np.arange(len(self.parts) + 1))
        for i, words in enumerate(self.words):
            out[cut[i] : cut[i + 1]] = rolling(words, WINDOW)[self.at[some[cut[i] : cut[i + 1]]]] if cut[i] < cut[i + 1] else 0
        return out, (self.anchor[some] >> _U(16)).astype(np.uint32)


def grouped(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of windows by h, where groups of equal ones begin in it, and the smallest doc of each group."""
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) if len(h) else np.zeros(0, bool)
    if (same & (check[order][1:] != check[order][:-1])).any():  # two windows with one h
        order = np.lexsort((check, h))
        same = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    head = np.flatnonzero(np.r_[True, ~same]) if len(h) else np.zeros(0, np.int64)
    return order, head, np.minimum.reduceat(doc[order], head) if len(head) else doc[:0]


def _rest(anchor: np.ndarray, shards: int) -> np.ndarray:
    """The bits of an anchor that are its cells in its shard."""
    return (anchor << _U(shards.bit_length() - 1)) >> _U(64 - 2 * CELL_BITS)


def _ask_sketch(shards: int) -> Callable:
    """From chunks (chunk, blob) the anchors of each and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchor, n = Windows(blob).anchors
                cut = places(anchor, shards)
                full = np.flatnonzero(np.diff(cut)).tolist()
                yield sent(full, chunk, [pack(steps(_rest(anchor[cut[b] : cut[b + 1]], shards)), np.minimum(n[cut[b] : cut[b + 1]], 2).astype(np.uint8)) for b in full])

    return run


def _sketch(table: pa.Table) -> pa.Table:
    """A shard of the sketch: for each chunk which of its anchors count two or more, one bit each."""
    asked = [unpack(x, np.uint64, np.uint8) for x in table.column("blob").to_pylist()]
    key = np.concatenate([np.cumsum(s, dtype=np.uint64) for s, _ in asked])
    count = np.concatenate([n for _, n in asked])
    several = np.ones(len(count), bool)
    for row in (0, 1):
        cell = (key >> _U(row * CELL_BITS) & _U((1 << CELL_BITS) - 1)).astype(np.int64)
        total = np.zeros(1 << CELL_BITS, np.uint32)
        np.add.at(total, cell, count)
        several &= total[cell] > 1
    ends = np.cumsum([len(n) for _, n in asked])
    return _answers(table, [pack(np.packbits(several[e - len(n) : e])) for e, (_, n) in zip(ends, asked, strict=True)])


def _answers(table: pa.Table, blobs: list[bytes]) -> pa.Table:
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "blob": pa.array(blobs, pa.binary())})


def _told(found: list[tuple[int, bytes]], keys: np.ndarray, buckets: int) -> np.ndarray:
    """What the buckets answered to some sorted keys, as one array."""
    size = np.diff(places(keys, buckets))
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(unpack(x, np.uint8)[0], count=int(size[b])).astype(bool) for b, x in sorted(found))])


_TEXTS, _SKETCH, _EXACT = 0, 1, 2  # what a row of a chunk's group is: its texts, or the answers of either pass


def _read(table: pa.Table) -> tuple[int, Windows, dict[int, list[tuple[int, bytes]]]]:
    kinds: dict[int, list[tuple[int, bytes]]] = {_TEXTS: [], _SKETCH: [], _EXACT: []}
    for kind, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
        kinds[kind].append((bucket, blob))
    return table.column("chunk")[0].as_py(), Windows(kinds[_TEXTS][0][1]), kinds


def _candidates(windows: Windows, kinds: dict, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of a chunk's windows that may be repeated, grouped: order, heads, and of each group the hashes and the smallest doc."""
    some = windows.repeated(_told(kinds[_SKETCH], windows.anchors[0], shards))
    h, check = windows.hashes(some)
    order, head, least = grouped(h, check, windows.doc[some])
    return some[order], head, h[order][head], check[order][head], least, np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(some)]))


def _ask_exactly(shards: int, buckets: int) -> Callable:
    """From a chunk and the sketch's answers its distinct windows that may be repeated, each with its smallest doc_id there."""

    def run(table: pa.Table) -> pa.Table:
        chunk, windows, kinds = _read(table)
        _, _, h, check, least, _ = _candidates(windows, kinds, shards)
        cut = places(h, buckets)
        full = np.flatnonzero(np.diff(cut)).tolist()
        blobs = [pack(steps(h[a:b]), check[a:b], least[a:b]) for a, b in ((cut[x], cut[x + 1]) for x in full)]
        return pa.Table.from_batches([sent(full, chunk, blobs)])

    return run


def _group(table: pa.Table) -> pa.Table:
    """A bucket of windows: for each chunk which of those it asked about another one has with a smaller doc_id."""
    asked = [unpack(x, np.uint64, np.uint32, np.int64) for x in table.column("blob").to_pylist()]
    doc = np.concatenate([d for _, _, d in asked])
    order, head, least = grouped(np.concatenate([np.cumsum(s, dtype=np.uint64) for s, _, _ in asked]), np.concatenate([c for _, c, _ in asked]), doc)
    later = np.zeros(len(doc), bool)
    later[order] = np.repeat(least, np.diff(np.r_[head, len(doc)])) < doc[order]
    ends = np.cumsum([len(d) for _, _, d in asked])
    return _answers(table, [pack(np.packbits(later[e - len(d) : e])) for e, (_, _, d) in zip(ends, asked, strict=True)])


def _cut(shards: int, buckets: int, layout: bool, names: list[str]) -> Callable:
    """From a chunk and all answers its rows with their words counted and cut; the columns from the third on pass through.

    layout: a text without repeats stays as it was written.
    """

    def run(table: pa.Table) -> pa.Table:
        _, windows, kinds = _read(table)
        order, head, h, _, least, group = _candidates(windows, kinds, shards)
        elsewhere = _told(kinds[_EXACT], h, buckets)
        gone = order[elsewhere[group] | (least[group] < windows.doc[order])] if len(order) else order
        return pa.Table.from_batches([_kept(part, scan, windows.at[gone[windows.part[gone] == i]], layout, names) for i, (part, scan) in enumerate(zip(windows.parts, windows.scans, strict=True))])

    return run


def _kept(part: pa.RecordBatch, scan: Scan, gone: np.ndarray, layout: bool, names: list[str]) -> pa.RecordBatch:
    """Rows without the words of the windows that begin at some words."""
    texts = texts_of(part)
    data, ws, we = scan.joined()
    step = np.zeros(len(ws) + 1, np.int32)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + WINDOW, -1)
    keep = np.cumsum(step[:-1]) == 0
    kept = np.r_[0, np.cumsum(keep)]
    words, left = np.diff(scan.ptr), kept[scan.ptr[1:]] - kept[scan.ptr[:-1]]
    out = []
    for i, hit in enumerate((left < words).tolist()):
        p, q = int(scan.ptr[i]), int(scan.ptr[i + 1])
        if hit:
            some = np.flatnonzero(keep[p:q]) + p
            out.append(b" ".join([data[a:b] for a, b in zip(ws[some].tolist(), we[some].tolist(), strict=True)]))
        else:
            out.append(texts[i] if layout else data[ws[p] : we[q - 1]] if p < q else b"")
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(words - left), pa.array(out, pa.binary()).cast(pa.string()), *part.columns[2:]], names=names)


def _cut_rows(docs: DataFrame, layout: bool, keep: list[str], chunk_bytes: int, shard_bytes: int, bucket_bytes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the columns of keep as _keep_0, _keep_1, …"""
    prepare(docs.sparkSession)
    kept = [f"_keep_{i}" for i in range(len(keep))]
    chunks, size = chunked(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)]), chunk_bytes)
    shards, buckets = buckets_for(size, shard_bytes), buckets_for(size, bucket_bytes)

    def rows(kind: int, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), "bucket", "chunk", "blob")

    texts = rows(_TEXTS, chunks.withColumn("bucket", F.lit(-1)))
    several = rows(_SKETCH, chunks.mapInArrow(_ask_sketch(shards), _SENT).groupBy("bucket").applyInArrow(_sketch, _SENT).checkpoint())
    asked = texts.unionByName(several).groupBy("chunk").applyInArrow(_ask_exactly(shards, buckets), _SENT)
    later = rows(_EXACT, asked.groupBy("bucket").applyInArrow(_group, _SENT))
    names = ["doc_id", "n_words", "n_removed", "kept_text", *kept]
    kind = "doc_id long, n_words long, n_removed long, kept_text string" + "".join(f", `{k}` {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True))
    return texts.unionByName(several).unionByName(later).groupBy("chunk").applyInArrow(_cut(shards, buckets, layout, names), kind)


def substring_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document.

    A word goes if a window of 50 words covers it that a document with a smaller doc_id
    also has, as the documents came in. kept_text has the words left, joined by one space.
    Null texts have no words. Rows with a null doc_id are neither compared nor cut.
    Repeated rows of one doc_id do not count against one another. Extra columns are
    ignored; an empty table gives no rows.
    """
    return _cut_rows(docs, False, [], chunk_bytes, shard_bytes, bucket_bytes)


def cut_documents(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with repeated passages cut out of text; a text without any stays as it is.

    n_chars, where the table has it, follows the new text. All other columns of a row stay
    with it, whatever their names; rows and handling of nulls are those of substring_dedup.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _cut_rows(docs, True, others, chunk_bytes, shard_bytes, bucket_bytes)
    named = {c: F.col(f"_keep_{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        named["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(named["n_chars"])
    return out.select(*[named[c].alias(c) for c in docs.columns])

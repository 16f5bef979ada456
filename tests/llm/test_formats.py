import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cuelattice.llm import chat, media, mixing, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Mixing.


def shares(sizes, weights=(3, 1, 2), boost=1.5, most=2.0):
    """Targets by sharing again and again what is above a source's most."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = boost * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= most * sizes[s]]
        for s in full or open_:
            out[s] = min(most * sizes[s], weight[s] * unit)
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def check_mix(rows, got):
    """rows: (doc_id, text, source)."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    target = shares(size)
    by_id = {i: (t, s) for i, t, s in rows}
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        text, source = by_id[r.doc_id]
        n = len(WORD.findall(text or ""))
        assert (r.size, r.source_size) == (n, size[source]) and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
    for source in size:
        assert abs(taken[source] - target[source]) <= largest[source]
    return taken, target


def test_mix_of_edge_cases(docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    check_mix([(r[0], r[1], r[3]) for r in rows], got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))  # reruns agree
    assert mixing.mix_sources(nothing).count() == 0


def test_mix_with_a_hot_source_and_a_tree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * min(4000, int(rng.lognormvariate(4, 1.2)))), "a" if i % 3 else f"s{i % 20:02d}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = check_mix(rows, mixing.mix_sources(frame, block=16).collect())
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 50 for s in target)


def test_mix_takes_documents_as_often_as_expected(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "abc"[i % 3]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    short, long = [], []
    for r in mixing.mix_sources(frame).collect():
        x = r.target / r.source_size
        (short if r.size < 10 else long).append(r.copies - x)
    assert abs(np.mean(short)) < 0.06 and abs(np.mean(long)) < 0.03  # no size is preferred


def test_mix_of_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), None if i % 10 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix_sources(frame).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix_sources(frame).collect())) == want


def test_mixed_documents_come_as_often_as_they_are_taken(docs, rows, nothing):
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    held = Counter(r[0] for r in rows)
    assert all(n <= 2 * held[i] for i, n in got.items()) and {i for i, n in want.items() if n > 1} <= set(got)
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).dtypes == docs.dtypes
    assert sorted(map(str, mixing.mixed_documents(docs).collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(2)).collect()))
    assert mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents_tell_rows_apart_by_all_columns(spark):
    rows = [(1, "a b c", "s", i) for i in range(6)] + [(None, "d e f", "s", i) for i in range(6)] + [(2, None, None, 0), (3, "", "t", 0), (4, "x " * 30, "t", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int").withColumn("_copies", F.lit(7)).withColumn("key", F.lit("k"))
    got = Counter((r.doc_id, r.text, r.source, r["_key"]) for r in mixing.mixed_documents(frame).collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    sizes = {"s": 36, "t": 30, None: 0}
    target = shares(sizes)
    for source in ("s", "t"):
        taken = sum(n * len(WORD.findall(t or "")) for (_, t, s, _), n in got.items() if s == source)
        assert abs(taken - target[source]) <= 30


def test_mix_of_rows_that_are_all_equal(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 7)
    frame = spark.createDataFrame([(1, "a b c d", "s")] * 100 + [(2, "e f g h", "t")] * 300, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame).collect()
    target = shares({"s": 400, "t": 1200})
    assert Counter(r.doc_id for r in got) == {1: 100, 2: 300}
    for i, source in ((1, "s"), (2, "t")):
        mine = [r for r in got if r.doc_id == i]
        assert abs(sum(r.taken for r in mine) - target[source]) <= 4 and mine[0].target == pytest.approx(target[source])
        assert len({r.copies for r in mine}) <= 2 and max(r.copies for r in mine) <= 2
    assert mixing.mixed_documents(frame).count() * 4 == sum(r.taken for r in got)


# Chat.


def conversations():
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(rng.choice((1, 2, 5, 30))):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join("word" for _ in range(rng.choice((0, 3, 50, 200, 900))))))
    rows += [(70, 0, "user", None), (70, 1, "assistant", ""), (71, 0, "assistant", "only"), (72, 0, "a\nb<|im_end|>\\", "x\\<|im_start|>\\n\n<\\|"), (72, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi\\")]
    rows += [(73, 1, "assistant", "b"), (73, 1, "assistant", "a"), (73, 0, "user", "q"), (74, None, None, "null role"), (None, 0, "assistant", "no id"), (75, 0, "system", "s " * 600), (75, 1, "assistant", "é" * 2000)]
    return rows + [(80, 0, "user", "twice")] * 2


def test_chat_reads_back(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x")).withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(text for *_, role, text in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_windows_keep_the_budget_and_the_system_turn(spark):
    turns = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    for w in chat.format_conversations(turns).collect():
        parsed = chat.parse(w.text)
        cost = [chat.count_tokens(text) for _, text in parsed]
        system = w.repeated > 0 and parsed[0][0] == "system"
        assert w.tokens == sum(cost)
        assert w.tokens <= chat.BUDGET or len(parsed) - w.repeated == 1  # only a turn that is too long by itself
        assert sum(cost[int(system) : w.repeated]) <= chat.HISTORY
        assert len(w.loss) == sum(role == "assistant" for role, _ in parsed[w.repeated :])
        if w.conv_id is not None and w.conv_id < 60 and w.conv_id % 3 == 0:
            assert parsed[0][0] == "system"


def test_windows_are_read_back_in_any_order(spark, tmp_path):
    turns = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.read_back(chat.format_conversations(turns)).collect()))
    chat.format_conversations(turns).orderBy(F.rand(3)).repartition(7).write.parquet(str(tmp_path / "windows"))
    assert sorted(map(str, chat.read_back(spark.read.parquet(str(tmp_path / "windows"))).collect())) == want
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    assert [r.conv_id for r in chat.read_back(chat.format_conversations(chat.with_probe(turns.limit(0)))).collect()] == [-1]


def test_probe_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_probe(turns))).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text)
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape("<|\\<\\|\\\\")) == "<|\\<\\|\\\\"


# Media.


def test_media_round_trip(docs, rows, nothing):
    got = media.audio_features(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = next(t or "" for i, t, *_ in rows if i == r.doc_id).encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert media.from_wav(bytes(r.media)) == (media.RATE, padded)
        times, clips = media.from_tensors(bytes(r.tensors))
        assert clips.shape[1:] == (media.CLIP, media.BANDS) and len(times) == len(clips) and np.isfinite(clips).all()
        assert (times[:, 0] < times[:, 1]).all() and all(0 <= s.start_s < s.end_s <= times[-1][1] + 1e-9 for s in r.spans)
        assert by_text.setdefault(raw, r.feature) == r.feature
    assert len(set(by_text.values())) == len(by_text)
    assert media.audio_features(nothing).count() == 0


def test_resampling_agrees_with_the_filter_written_out():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, 333).astype(np.uint8)
    signal = (x.astype(float) - 128) / 128
    n = -(-len(x) * media.UP // media.DOWN)
    half = media.REACH * max(media.UP, media.DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(media.UP, media.DOWN)) * np.kaiser(2 * half + 1, 5.0)
    taps *= media.UP / taps.sum()
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = signal
    full = np.convolve(wide, taps)[half:]
    want = [full[k * media.DOWN] if k * media.DOWN < len(full) else 0 for k in range(n)]
    assert media.resample(x, 0, n) == pytest.approx(want, abs=1e-4)
    assert media.resample(x, 37, 50) == pytest.approx(want[37:87], abs=1e-4)


def test_a_tone_lands_in_its_band_and_blocks_do_not_show(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(40_000) / media.RATE)).astype(np.uint8)
    mel, energy = media.log_mel(tone)
    edges = 700 * (np.exp(np.linspace(0, np.log1p(media.RATE * media.UP / media.DOWN / 2 / 700), media.BANDS + 2)) - 1)
    band = int(mel[10:-10].mean(axis=0).argmax())
    assert edges[band] <= 440 <= edges[band + 2]
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    again, other = media.log_mel(tone)
    assert again == pytest.approx(mel, abs=1e-3) and other == pytest.approx(energy, abs=1e-3)


def test_spans_open_high_and_close_low():
    energy = np.array([0, 0, 10, 4, 10, 0, 0, 0, 10, 10, 0, 0.0])
    assert media.active_spans(energy) == [(2, 5), (8, 10)]
    assert media.active_spans(np.zeros(5)) == []


def test_other_wav_files():
    with pytest.raises(ValueError, match="WAV"):
        media.from_wav(b"nothing at all")
    odd = media.to_wav(b"abc")
    assert len(odd) % 2 == 0 and media.from_wav(odd[:36] + b"LIST" + b"\x02\x00\x00\x00xx" + odd[36:]) == (media.RATE, b"abc")


# SentencePiece.


def same(codec, other, texts):
    flat, count = codec.encode([t.encode() for t in texts])
    ends = np.cumsum(count)
    got = [flat[e - c : e].tolist() for e, c in zip(ends, count, strict=True)]
    want = other.encode(texts)
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert [t.decode("utf-8", "replace") for t in codec.decode_all(flat, count)] == other.decode(want)


def odd_texts(n=3000):
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "a", "the", "▁", "é", "\t", "日本", "\u0000", "　", "!", "thing", "\U0001f600", "   ", "<s>", "\r", "<0x41>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "\n", " " * 37, "a" + " " * 11 + "b"]


def test_bpe_parity_on_odd_texts():
    same(pieces.codec(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), odd_texts())


def message(*fields):
    """A protobuf message of (number, value) fields."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        elif isinstance(value, int):
            tag, body = number << 3, b""
            while True:
                body += bytes([value & 127 | (128 if value > 127 else 0)])
                value >>= 7
                if not value:
                    break
            out += (bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])) + body
        else:
            size, head = len(value), b""
            while True:
                head += bytes([size & 127 | (128 if size > 127 else 0)])
                size >>= 7
                if not size:
                    break
            out += bytes([number << 3 | 2]) + head + value
    return out


def unigram_model(byte_fallback=True):
    """A hand-made unigram model; nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = {"▁": -3.0, "a": -3.5, "▁a": -2.5, "th": -3.1, "the": -2.7, "▁the": -1.9, "t": -4.0, "h": -4.1, "e": -3.3, "é": -5.0, "ing": -2.9, "thing": -4.4, "i": -4.2, "n": -4.3, "g": -4.6, "!": -3.9}
    rows += [(w, s, 1) for w, s in words.items()]
    parts = [(1, message((1, p.encode()), (2, float(s)), (3, k))) for p, s, k in rows]
    return message(*parts, (2, message((3, 1), (35, int(byte_fallback)))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_parity(byte_fallback):
    model = unigram_model(byte_fallback)
    codec = pieces.Codec(model)
    assert codec.spec.kind == pieces.UNIGRAM and codec.spec.byte_fallback == byte_fallback
    texts = odd_texts(1500) if byte_fallback else ["the thing", "a the", "thing!", "", "ate the things"[:9]]
    same(codec, sentencepiece.SentencePieceProcessor(model_proto=model), texts)


def test_models_that_are_not_supported():
    with pytest.raises(ValueError, match="kind"):
        pieces.parse_model(message((2, message((3, 4)))))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.parse_model(message((1, message((1, b"x"), (2, 0.0), (3, 4)))))


def test_encoding_a_table(docs, rows, nothing):
    encoded = pieces.encode_documents(docs, audit=1, keep=["source"])
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    assert {r.doc_id for r in got if not r.ids} == {i for i, t, *_ in rows if not t}
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    null = encoded.select("doc_id", F.when(F.col("doc_id") != 1, F.col("ids")).alias("ids"), F.lit("old").alias("text"))
    assert {r.doc_id: r.text for r in pieces.decode_documents(null).collect()}[1] is None
    assert pieces.encode_documents(nothing).count() == 0


def test_decoding_a_table(spark, docs, nothing):
    encoded = pieces.encode_documents(docs.select("doc_id", "text", "source"), keep=["source"])
    back = pieces.decode_documents(encoded.withColumns({"text": F.lit(1), "more": F.lit("x")}))
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter((r.doc_id, r.text or "", r.source) for r in docs.collect())
    assert pieces.decode_documents(encoded.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, str(r.text)) for r in pieces.decode_documents(odd).collect()) == [(1, "None"), (2, ""), (2, "")]


def test_a_forgetful_table_of_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    codec = pieces.Codec(pieces.load())
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for _ in range(3):
        same(codec, other, ["one two three four five", "six\nseven", "one six"])

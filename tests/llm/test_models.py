import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cuelattice.llm import langid, lm, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


# Language model.


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_lm_base_agrees_with_exact_counts(docs, rows, nothing):
    counts = Counter(t for i, text, *_ in rows if fold(i, 7) != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, text, *_ in rows:
        t = tokens(text)
        want[i] = (fold(i, 7) == 2, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t))
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4])
        assert r.score < 0
    assert lm.score_documents(nothing).count() == 0


def quantised(n):
    """The mean count of the level that n is in."""
    return (3 * 2 ** (n.bit_length() - 1) - 1) / 2 if n else 0.0


def brute_scores(rows):
    """Scores from exact counts, quantised."""
    words, grams, texts = Counter(), Counter(), 0
    for i, text, *_ in rows:
        if fold(i, 7) != 2:
            t = ["<s>", "<s>", *tokens(text)]
            texts += 1
            words.update(t[2:])
            grams.update(zip(t[1:], t[2:], strict=False))
            grams.update(zip(t, t[1:], t[2:], strict=False))
    coarse, opening = sum(map(quantised, words.values())), quantised(texts)
    out = []
    for i, text, *_ in rows:
        t, total, before, history, follows = ["<s>", "<s>", *tokens(text)], 0.0, opening, opening, False
        for k in range(2, len(t)):
            c, pair = quantised(words[t[k]]), quantised(grams[t[k - 1], t[k]])
            triple = quantised(grams[t[k - 2], t[k - 1], t[k]])
            p = (c + 1) / (coarse + len(words) + 1)
            p = (min(pair, history) + lm.BACK_OFF[0] * p) / (history + lm.BACK_OFF[0])
            weight = lm.FOLLOWING if follows else lm.BACK_OFF[1]
            total += math.log10((min(triple, before) + weight * p) / (before + weight))
            before, history, follows = pair, c, triple > 0
        out.append((str(i), total))
    return sorted(out)


def test_lm_score_agrees_with_quantised_counts(docs, rows):
    want = brute_scores(rows)
    for chunk, bucket in ((8 << 20, 8 << 20), (20_000, 1 << 14), (1, 1 << 10)):  # one chunk a task and one bucket, some, one for each row
        got = lm.score_documents(docs, bits=400, chunk_bytes=chunk, bucket_bytes=bucket)  # hardly any false positives
        got = sorted((str(r.doc_id), r.score) for r in got.collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)


def test_lm_filter_holds_quantised_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 1 << 40)
    known = lm.LogFilter(keys, counts)
    assert len(known.bits) * 64 >= lm.BITS_PER_ENTRY * lm.level_of(counts).sum()
    assert (known.level(keys) >= lm.level_of(counts)).all()  # a Bloom filter errs upwards only
    assert (known.level(keys) == lm.level_of(counts)).mean() > 0.97
    unseen = lm.word_id(np.arange(1, 20_000, dtype=np.uint64)) >> np.uint64(16)
    assert (known.level(unseen) > 0).mean() < 0.05
    assert lm.count_of(lm.level_of(np.array([0, 1, 2, 3, 4, 7]))).tolist() == [0.0, 1.0, 2.5, 2.5, 5.5, 5.5]
    assert lm.LogFilter(keys[:0], counts[:0]).level(keys).max() == 0


def test_lm_counts_are_summed_exactly():
    rng = np.random.default_rng(3)
    keys, n = rng.integers(0, 50, 400, dtype=np.uint64) << np.uint64(42), rng.integers(0, 200_000, 400)
    want = Counter()
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        want[k] += c
    for sums in (lm.sum_grams, lm.sum_words):
        got = sums(keys, n)
        assert dict(zip(*(x.tolist() for x in got), strict=True)) == want and (np.diff(got[0].astype(object)) > 0).all()
        assert all(len(x) == 0 for x in sums(keys[:0], n[:0]))
    grams = np.sort(np.unique(keys))
    again = lm.unpack_asked(lm.pack_asked(keys, n, grams, n[: len(grams)]))
    assert all((a == b).all() for a, b in zip(again, (keys, n, grams, n[: len(grams)]), strict=True))


def test_lm_scores_held_out_text_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("share")).first()
    assert r.s > r.b and r.share > 0.7


# Language identification.


def test_languages_of_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_edge_cases(docs, rows, nothing):
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in rows}
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) != letters[r.doc_id]
        assert r.held_out == (fold(r.doc_id, 3) == 1)
        assert r.lang_pred in ("und", "en", "de")
    assert langid.identify_languages(nothing).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_languages(unlabelled).collect()} == {"und"}


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    model = langid.Tagger(["a", "b", "c"], hidden=3)
    x, live, _ = langid._pieces([b"hello w\xc3\xb6rld", b"x", b"abc"], 12)
    y = np.array([0, 1, 2])

    def loss():
        _, p = model._logits(x, live)
        p = p.astype(np.float64)
        p = (p - np.log(np.exp(p).sum(axis=1, keepdims=True))).reshape(*x.shape, -1)
        return -(p[:, np.arange(3), y] * live).sum() / live.sum()

    for w in model.weights():
        w[...] = w.astype(np.float32)
    keep = ([], [])
    both, p = model._logits(x, live, keep)
    p = np.exp(p)
    p = (p / p.sum(axis=1, keepdims=True)).reshape(*x.shape, -1)
    p[:, np.arange(3), y] -= 1
    p *= live[:, :, None] / live.sum()
    d = p.reshape(-1, 3)
    into = (d @ model.out.T).reshape(both.shape)
    grads = [*model.ahead.gradients(x, live, keep[0], into[:, :, :3]), *model.back.gradients(x[::-1], live[::-1], keep[1], into[::-1, :, 3:]), both.reshape(-1, 6).T @ d, d.sum(axis=0)]
    for w, g in zip(model.weights(), grads, strict=True):
        spots = [np.unravel_index(i, w.shape) for i in np.argsort(-np.abs(g).ravel())[:4]] + [np.unravel_index(rng.integers(w.size), w.shape)]
        for spot in spots:
            old = w[spot]
            w[spot] = old + 1e-2
            up = loss()
            w[spot] = old - 1e-2
            down = loss()
            w[spot] = old
            assert g[spot] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_the_forward_pass_agrees_with_a_loop():
    model = langid.Tagger(["a", "b", "c"], hidden=4)
    texts = [b"hello w\xc3\xb6rld", b"x", b"abcabc"]

    def squash(v):
        return 1 / (1 + np.exp(-v))

    def states(gru, text):
        h, out = np.zeros(4), []
        for byte in text:
            z, r = (squash(gru.inputs[byte][i : i + 4] + h @ gru.gates[:, i : i + 4]) for i in (0, 4))
            new = np.tanh(gru.inputs[byte][8:] + (r * h) @ gru.new)
            h = (1 - z) * h + z * new
            out.append(h)
        return out

    got = langid.pooled(model, texts)
    for text, mean in zip(texts, got, strict=True):
        total = np.zeros(3)
        for ahead, back in zip(states(model.ahead, text), states(model.back, text[::-1])[::-1], strict=True):
            e = np.exp(np.r_[ahead, back] @ model.out + model.bias)
            total += e / e.sum()
        assert mean == pytest.approx(total / len(text), abs=1e-5)


def test_all_bytes_of_a_training_window_are_learnt():
    pieces, live, owner = langid._pieces([b"ab" * 150, b"", b"xyz"], 128)
    assert owner.tolist() == [0, 0, 0, 2] and live.sum(axis=0).tolist() == [128, 128, 44, 3]
    assert bytes(pieces.T[live.T > 0]) == b"ab" * 150 + b"xyz"


def test_many_languages_share_the_windows(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words", f"l{i % 40:02d}") for i in range(400)], "doc_id long, text string, lang string")
    got = langid.training_windows(docs, sample=64, most=80).collect()
    assert len(got) <= 80 and len({r.lang for r in got}) == 40
    few = langid.training_windows(docs, sample=64, most=80, languages=3).collect()
    assert {r.lang for r in few} == {"l00", "l01", "l02"}


def test_every_byte_is_labelled_once():
    model = langid.Tagger(["a", "b"])
    texts = [b"", b"x" * 1000, b"y" * 128, None, b"short", "é".encode() * 300]
    total = langid.pooled(model, texts).sum(axis=1)
    assert total == pytest.approx([0, 1, 1, 0, 1, 1], abs=1e-5)


# Toxicity.


def test_toxicity_of_held_out_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    low = np.sort([r.score for r in got if not r.toxic])
    beaten = np.mean([np.searchsorted(low, r.score) / len(low) for r in got if r.toxic])
    assert beaten > 0.8
    assert np.mean([r.predicted for r in got if not r.toxic]) < 0.05
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.5


def test_toxicity_edge_cases(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2)
    same = {}
    for r in got:
        assert same.setdefault(next(t or "" for i, t, *_ in rows if i == r.doc_id), r.score) == r.score
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert all(r.score < 0.01 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {tuple(r) for r in toxicity.toxicity_scores(docs, labels).collect()} == {tuple(r) for r in toxicity.toxicity_scores(docs, turned).collect()}


def test_evidence_is_the_difference_of_two_compressed_lengths():
    common = b"the quick brown fox jumps over the lazy dog and runs away from it "
    pair = toxicity.Pair(b"zorgle blaxx " + common, common + b" " * 13)
    for text in (b"", b"the quick brown fox", b"you ZORGLE blaxx " * 9):
        want = []
        for window in toxicity.windows(text.lower()):
            size = []
            for content in (common + b" " * 13, b"zorgle blaxx " + common):
                settings = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **toxicity._SETTINGS)
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size.append(len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(window)))
            want.append(min(max(size[0] - size[1], -toxicity.SPAN), toxicity.SPAN) + toxicity.SPAN)
        assert pair.evidence(text).tolist() == want
    assert pair.evidence(b"zorgle blaxx")[0] > toxicity.SPAN


def test_a_dictionary_of_few_samples_is_their_end():
    assert toxicity._dictionary(8, [b"abc", b"defghij"]) == b"cdefghij"
    assert toxicity._dictionary(8, []) == b""


def test_windows_cover_a_text():
    for text in (b"", b"a", b"word " * 100, b"x" * 1000, b" " * 300):
        cut = toxicity.windows(text)
        assert b"".join(cut) == text and all(0 < len(w) <= 4 * toxicity.WINDOW for w in cut)


# Quality.


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def test_quality_counts_agree_with_brute_force(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 40, 2)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(900, "a b c\na b c\n\na b c\n \n\n|#x y", "en", "b"), (901, "same line here\nsame line here \nsame line here", "en", "b"), (902, "\n\n", "en", "b")]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    want = {i: counts(t) for i, t, *_ in [*rows, *extra]}
    got = quality.quality_verdicts(more, labels).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert quality.quality_verdicts(nothing, labels).count() == 0
    untrained = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in untrained)


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    """Judged on documents whose labels were not learnt."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality.quality_verdicts(docs, labels.where(~apart)).join(labels.where(apart), "doc_id").where("NOT base_failed").collect()
    assert len(got) > 500 and np.mean([r.kept for r in got if r.quality]) > 0.98
    assert np.mean([r.kept for r in got if not r.quality]) < 0.1
    assert np.mean([0 < r.content_share < 1 for r in got if not r.quality]) > 0.2  # poor documents have lines of both kinds


def test_lines_planted_in_good_documents_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels)
    rng = random.Random(9)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 1000").orderBy("doc_id").limit(40)
    texts, want = [], []
    for r in good.collect():
        lines = [x for x in r.text.split("\n") if WORD.search(x)][:12]
        junk = [" | ".join(rng.choice("Home Login Cart Menu About Help".split()) for _ in range(9)), "$$$ buy*** now### " * 6, "click click click here here here! " * 4]
        at = rng.randrange(len(lines) + 1)
        texts.append("\n".join(lines[:at] + junk + lines[at:]).encode())
        want += [1] * at + [0] * 3 + [1] * (len(lines) - at)
    seen = quality.examine(texts)
    label = field.decode(seen.features, seen.ptr)
    assert (label == np.array(want)).mean() > 0.95
    content = np.r_[0, np.cumsum(seen.words * label)]
    share = (content[seen.ptr[1:]] - content[seen.ptr[:-1]]) / seen.n_words
    assert ((share > 0) & (share < 1)).mean() > 0.9


def test_line_labels_differ_within_a_poor_document():
    x, live = np.zeros((4, 5, 2)), np.ones((4, 5))
    x[:, :, 0] = 1
    x[2, 1:3, 1] = x[3, :, 1] = 1.0
    live[1, 3:] = 0
    assert quality.line_labels(x, live, np.array([True, True, False, False])).tolist() == [[1] * 5, [1] * 5, [1, 0, 0, 1, 1], [0] * 5]


def test_viterbi_agrees_with_all_sequences():
    rng = np.random.default_rng(4)
    field = quality.LineField()
    field.emit, field.change = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2))
    sizes = [0, 1, 5, 3, 0, 7]
    ptr = np.r_[0, np.cumsum(sizes)]
    x = rng.normal(size=(ptr[-1], len(quality.FEATURES)))
    got = field.decode(x, ptr)
    for p, q in zip(ptr[:-1], ptr[1:], strict=True):
        n, e = q - p, x[p:q] @ field.emit
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        best = max(paths, key=lambda s: sum(e[i, y] for i, y in enumerate(s)) + sum(field.change[a, b] for a, b in zip(s, s[1:], strict=False)))
        assert got[p:q].tolist() == best


def test_field_gradient_raises_the_likelihood():
    rng = np.random.default_rng(5)
    gold = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 6, len(quality.FEATURES)))
    x[:, :, 0] = 1
    x[:, :, 1] += 2 * gold[:, None]
    live = (np.arange(6) < rng.integers(1, 7, 60)[:, None]).astype(float)
    field = quality.LineField()
    field.fit(x * live[:, :, None], live, np.repeat(gold[:, None], 6, axis=1))
    n = live.sum(axis=1).astype(int)
    flat = np.concatenate([x[i, : n[i]] for i in range(60)])
    label = field.decode(flat, np.r_[0, np.cumsum(n)])
    assert (label == np.repeat(gold, n)).mean() > 0.95

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from cuelattice.llm import components, simhash, substring
from cuelattice.llm.chunks import pack, steps, unpack
from cuelattice.llm.textscan import Scan, rolling, window_starts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_scan(rows):
    texts = [r[1] for r in rows]
    scan = Scan([None if t is None else t.encode() for t in texts])
    want = [WORD.findall(t or "") for t in texts]
    data, ws, we = scan.joined()
    got = [data[a:b].decode() for a, b in zip(ws, we, strict=True)]
    assert got == [w for d in want for w in d]
    assert np.diff(scan.ptr).tolist() == list(map(len, want))
    seen = {}
    for word, h in zip(got, scan.hashes().tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    starts = window_starts(scan.ptr, 3)
    assert len(starts) == sum(max(0, len(d) - 2) for d in want)
    hashed = {}
    for i, h in zip(starts.tolist(), rolling(scan.hashes(), 3)[starts].tolist(), strict=True):
        assert hashed.setdefault(tuple(got[i : i + 3]), h) == h
    assert len(set(hashed.values())) == len(hashed)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*links, (None, 1)], "u long, v long")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.id: r.component for r in components.connected_components(frame).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(frame.limit(0)).count() == 0


def fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_agrees_with_brute_force(docs, rows, nothing):
    prints = {}
    for i, text, *_ in rows:
        prints.setdefault(fingerprint(text), []).append(i)
    known = list(prints)
    group = list(range(len(known)))
    for _ in known:
        for a in range(len(known)):
            for b in range(len(known)):
                if (known[a] ^ known[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for p, g in zip(known, group, strict=True):
        least[g] = min([*([least[g]] if g in least else []), *[i for i in prints[p] if i is not None]], default=None)
    want = sorted((str(i), f"{fingerprint(t):016x}", least[group[known.index(fingerprint(t))]]) for i, t, *_ in rows)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == want
    assert simhash.simhash_components(nothing).count() == 0


def test_simhash_keeps_one_of_each_group(docs, rows):
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({c for i, c in found.items() if i is not None})


def test_simhash_keeps_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(5, f"{a} {b}"), (5, f"{b} {c} {d}"), (None, a), (None, b), (None, b), (None, c), (1, c), (2, c), (2, d), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash.keep_first(docs).collect())
    assert got == sorted((str(i), str(t)) for i, t in [*rows[:2], (None, a), (None, b), (1, c), (2, d), (3, None)])


def test_simhash_keeps_one_of_many_equal_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    copies = spark.range(8, 2000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    docs = same.unionByName(copies).repartition(6)
    assert [tuple(r) for r in simhash.keep_first(docs).collect()] == [(7, text)]


def test_gray_index_agrees_with_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    one, two = (np.uint64(1) << rng.integers(0, 64, (40, 30)).astype(np.uint64) for _ in range(2))
    fps = np.unique(np.concatenate([base, (base ^ one).ravel(), (base ^ one ^ two).ravel()]))
    group = np.sort(rng.integers(0, 4, len(fps)))
    got = [(min(a, b), max(a, b)) for u, v in simhash.GrayIndex(fps, group).links(budget=3000) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want
    assert list(simhash.GrayIndex(fps[:0], group[:0]).links()) == []


def test_masks_bring_every_near_pair_together():
    bits = [(1 << a) | (1 << b) for a in range(64) for b in range(64)]
    assert all(any(d & m == 0 for m in simhash.MASKS) for d in bits)


def cut(rows, window=substring.WINDOW):
    """(kept words, number removed) of each row, by brute force."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            w = WORD.findall(text or "")
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for a in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substrings_agree_with_brute_force(docs, rows, nothing):
    got = cut_by_operator(docs)
    assert got == cut(rows) and sum(r[2] for r in got) > 300
    assert substring.substring_dedup(nothing).count() == 0


def test_sizes_change_nothing(docs, rows):
    for sizes in ((1, 1 << 30, 1 << 30), (20_000, 1 << 12, 1 << 12), (1 << 30, 1 << 14, 1 << 16)):
        assert cut_by_operator(docs, *sizes) == cut(rows)


def test_a_full_sketch_loses_nothing():
    rng = np.random.default_rng(6)
    table = pa.table({"bucket": [0, 0], "chunk": [4, 7], "blob": [pack(steps(np.sort(rng.integers(0, 1 << 6, 5000, dtype=np.uint64))), np.ones(5000, np.uint8)) for _ in range(2)]})
    told = substring._sketch(table)
    assert told.column("chunk").to_pylist() == [4, 7]
    assert all(np.unpackbits(unpack(x, np.uint8)[0], count=5000).all() for x in told.column("blob").to_pylist())


def test_the_sketch_passes_few_windows_that_occur_once():
    """At the density that a shard has at most: one anchor for about eighteen words of five bytes."""
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 1 << 46, substring.SHARD_BYTES // 100, dtype=np.uint64))
    table = pa.table({"bucket": [0], "chunk": [0], "blob": [pack(steps(keys), np.ones(len(keys), np.uint8))]})
    assert np.unpackbits(unpack(substring._sketch(table).column("blob")[0].as_py(), np.uint8)[0], count=len(keys)).mean() < 0.01


def test_equal_windows_with_one_hash_are_told_apart_by_the_other():
    h, check, doc = np.array([5, 5, 5, 5, 1], np.uint64), np.array([1, 2, 1, 2, 1], np.uint32), np.array([9, 8, 7, 6, 5])
    order, head, least = substring.grouped(h, check, doc)
    found = {(int(h[i]), int(check[i])): int(m) for i, m in zip(order[head], least, strict=True)}
    assert found == {(1, 1): 5, (5, 1): 7, (5, 2): 6}
    assert all(len(x) == 0 for x in substring.grouped(h[:0], check[:0], doc[:0]))


def test_documents_without_repeats_are_left_alone(docs, rows):
    got = {r.doc_id: r for r in substring.cut_documents(docs).collect()}
    changed = {i for i, _, n, _ in cut(rows) if n}
    for i, text, *_ in rows:
        assert (got[i].text == text) == (str(i) not in changed)
        assert text is None or got[i].n_chars == len(got[i].text)
    assert substring.cut_documents(docs).columns == docs.columns


def test_anchors_are_those_of_equal_windows():
    rng = random.Random(5)
    passage = [f"p{rng.randrange(9)}" for _ in range(80)]
    texts = [" ".join([f"{k}{i}" for i in range(30)] + passage).encode() for k in "abc"]
    scan = Scan(texts)
    _, start, anchor = substring._anchors(scan)
    by = {}
    found = WORD.findall(b" ".join(texts).decode())
    for s, a in zip(start.tolist(), anchor.tolist(), strict=True):
        assert by.setdefault(tuple(found[s : s + 50]), a) == a


def cut_by_operator(docs, *sizes):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.substring_dedup(docs, *sizes).collect())


def test_a_passage_that_a_document_repeats_goes_at_every_place(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    own = " ".join(f"x{i}" for i in range(60))
    rows = [(1, passage), (2, f"{passage} {own} {passage}"), (2, f"{own} y {passage}")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows[:1], rows[1:]], 2).flatMap(lambda x: x), "doc_id long, text string")
    assert cut_by_operator(docs) == cut(rows)
    assert sorted(r[2] for r in cut(rows)) == [0, 60, 120]


def test_neighbours_with_one_anchor_are_both_counted(spark):
    passage = " ".join(f"n{i}" for i in range(50))
    rows = [(1, passage), (2, passage), (3, " ".join(f"m{i}" for i in range(50)))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
    assert cut_by_operator(docs) == cut(rows)
    assert sorted(r[2] for r in cut(rows)) == [0, 0, 50]

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelattice.llm import simhash, substring, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "mix_sources", "sentencepiece"]
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append(out)
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    assert set(ids[1]) == set(ids[0]) - toxic
    component = {r.doc_id: r.component_id for r in simhash.simhash_components(seen[1]).collect()}
    assert set(ids[2]) == {i for i, c in component.items() if i == c}
    assert ids[3] == ids[2]
    cut = {r.doc_id: (r.n_removed, r.kept_text) for r in substring.substring_dedup(seen[2]).collect()}
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in seen[2:4])
    assert all(after[i] == (cut[i][1] if cut[i][0] else before[i]) for i in before)
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2


def test_run_agrees_with_its_stages_and_repeats(spark):
    first, second = (sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and len(first) > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in docs.collect()) == first


def test_run_leaves_one_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    made = {x for d in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if d.startswith("pipeline-") for x in os.listdir(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{d}")}
    assert out.count() and made == {corpus_pipeline.STAGES[-1][0]} and before <= set(os.listdir(folder))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id or with that of another, repeated rows, null and long texts, columns that the operators use."""
    own = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    rows = [(None, own["a"]), (None, own["b"]), (None, own["c"]), (3, own["d"]), (5, own["e"]), (5, own["d"]), (7, own["f"]), (7, own["g"]), (8, own["f"] + " " + own["a"]), (9, None), (9, None), (None, ""), (10, "z " * 30_000)]
    made = spark.createDataFrame([(i, t, None if n % 4 == 0 else f"s{n % 3}", n % 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, _key int")
    for name in ("_copies", "key", "twin", "one", "two", "c0", "kept_text", "fp", "chunk", "bucket", "kind", "_row", "_keep_0", "n_removed", "score"):
        made = made.withColumn(name, F.lit(name))
    return made.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).repartition(4).cache()


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd, SF)
    rows = out.collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if place < 4:
        assert out.dtypes == odd.dtypes
    text = Counter((r.doc_id, r.text) for r in odd.collect())
    if name == "toxicity":
        assert Counter((r.doc_id, r.text) for r in rows) == text
    elif name == "simhash_near_dedup":
        gone = text - Counter((r.doc_id, r.text) for r in rows)
        assert len(rows) == len({t or "" for _, t in text}) and set(gone) <= {(5, odd.where("doc_id = 3").first().text), (9, None), (None, "")}
    elif name == "substring_dedup":
        assert len(rows) == odd.count()
        cut = [r for r in rows if (r.doc_id, r.text) not in text]
        assert {r.doc_id for r in cut} == {5, 8} and all(r.n_chars == len(r.text) for r in cut)
    elif name == "mix_sources":
        took = Counter((r.doc_id, r.text) for r in rows)
        assert set(took) <= set(text) and all(n <= 2 * text[k] for k, n in took.items())
    else:
        assert len(rows) == odd.count() and all(r.parity for r in rows)

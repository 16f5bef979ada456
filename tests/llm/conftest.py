import random

import pytest

CLASHING = "score double, predicted int, n_words long, n_removed long, runs string, component_id long, fp long, key long, row string, block int, size long, target double, copies int, ids string, audit int, _row int"


def words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=40):
    """(doc_id, text, lang, source) rows: exact and near copies, shared passages, empty, null and long texts."""
    rng = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = []
    for i in range(n):
        own = " ".join(words(rng, rng.choice((0, 1, 2, 5, 60, 150)), 3000))
        rows.append((i, f"{own}\n{shared}  {own}" if i % 7 == 3 else own.replace(" ", "\n", 1), ("en", "de", None)[i % 3], (None, "b", "a", "é")[i % 4]))
    rows += [(100 + i, rows[4 + i][1], "en", "a") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "b"), (202, " \t\n\x0b ", "en", "b"), (203, "Ünïcode　wörd  x 你好 " * 40, "de", "b")]
    rows += [(204, "x" * 200_000, "en", "b"), (205, " ".join(words(rng, 20_000)), "en", "b"), (None, "no id at all", "en", "b"), (206, "!!! 123 ???", None, "a")]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for part in CLASHING.split(", "):
        name, kind = part.split()
        made = made.withColumn(name, F.lit(None).cast(kind))
    return made.repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

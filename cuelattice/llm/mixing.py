"""Mixing of sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source should be taken target / source size times: a whole number of
copies and a fraction. Two fractional documents are paired and words are moved from one
to the other, at random and without changing the expectation of either, until one of them
is taken or left. What is still fractional goes on: blocks of some sixty documents leave
one document each, blocks of sixty blocks again one, and so on up a tree. One block of a
source waits for the root: its documents, the long ones first, make up there for the words
by which the last long document misses its target when it is rounded. The words taken of a
source therefore differ from its target by less than its longest document, and by much
less where that block has short ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import prepare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BOOST, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK = 64  # documents in a block of the tree, about
BROADCAST_SOURCES = 20_000  # sources at most whose targets are broadcast
SLACK = 0.9  # how much of the way to 0 or 1 a waiting document's fraction may be moved
EQUAL_ROWS = 1 << 16  # equal rows that one row is spread to at once
_UNIT = "struct<waits:boolean,order:bigint,key:bigint,twin:bigint,doc_id:bigint,size:bigint,rows:bigint,base:bigint,more:bigint,x:double>"


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def source_targets(grouped: DataFrame, weights: Sequence[float] = WEIGHTS, boost: float = BOOST, most: float = MOST) -> DataFrame:
    """source, n, source_size and target of each source in grouped(source, size, rows); n counts the groups.

    Sources in code-point order, null last, get the weights in turn and share boost times
    all sizes; no target is above most times its source's size, and what is above is
    shared again by weight. With sources in order of size / weight, the level of the
    shares is the largest that any number of full sources leaves to the others.
    """
    total = grouped.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    given = F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1)
    total = total.withColumn("weight", given).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("level", (boost * F.sum("source_size").over(everything) - before) / rest)
    share = F.least("cap", F.col("weight") * F.max("level").over(everything))
    return total.select("source", "n", "source_size", share.alias("target"))


def _pivot(state: Column, unit: Column, seed: int) -> Column:
    """Move words between the unit carried so far and the next one until one is integral."""
    c, u = state["carry"], unit
    let = F.struct(
        (c["size"] * (1 - c["x"])).alias("room_c"),
        (c["size"] * c["x"]).alias("mass_c"),
        (u["size"] * (1 - u["x"])).alias("room_u"),
        (u["size"] * u["x"]).alias("mass_u"),
        _uniform(c["key"], u["key"], F.lit(seed)).alias("r"),
    )

    def moved(v: Column) -> Column:
        to_c, to_u = F.least(v["room_c"], v["mass_u"]), F.least(v["room_u"], v["mass_c"])
        up = v["r"] * (to_c + to_u) < to_u
        fills_c, fills_u = v["room_c"] <= v["mass_u"], v["room_u"] <= v["mass_c"]
        x_c = F.when(up, F.when(fills_c, F.lit(1.0)).otherwise((v["mass_c"] + to_c) / c["size"])).otherwise(
            F.when(fills_u, (v["mass_c"] - to_u) / c["size"]).otherwise(F.lit(0.0))
        )
        x_u = F.when(up, F.when(fills_c, (v["mass_u"] - to_c) / u["size"]).otherwise(F.lit(0.0))).otherwise(
            F.when(fills_u, F.lit(1.0)).otherwise((v["mass_u"] + to_u) / u["size"])
        )
        return F.struct(x_c.alias("x_c"), x_u.alias("x_u"), F.when(up, fills_c).otherwise(~fills_u).alias("c_ends"))

    def settle(v: Column) -> Column:
        new_c, new_u = c.withField("x", v["x_c"]), u.withField("x", v["x_u"])
        ended, carried = F.when(v["c_ends"], new_c).otherwise(new_u), F.when(v["c_ends"], new_u).otherwise(new_c)
        return F.struct(F.concat(state["done"], F.array(ended)).alias("done"), carried.alias("carry"))

    return F.transform(F.transform(F.array(let), moved), settle)[0]


def _step(state: Column, unit: Column, seed: int) -> Column:
    """One more unit: carried if it is the first, else paired with the one carried.

    A waiting unit's fraction is moved by shift. If the waiting units that are left can
    take the difference, the carried one is rounded at random before and they take it.
    """
    c = state["carry"]
    u = unit.withField("x", unit["x"] + F.when(unit["waits"], state["shift"]).otherwise(0.0))
    left = state["left"] - F.when(unit["waits"], unit["size"]).otherwise(0)
    up = F.when(_uniform(c["key"], F.lit(-2 - seed)) < c["x"], 1.0).otherwise(0.0)
    moved = state["shift"] - F.try_divide(c["size"] * (up - c["x"]), state["left"].cast("double"))
    can = unit["waits"] & (F.abs(moved) <= SLACK * F.least(unit["x"], 1 - unit["x"]))

    def build(done: Column, carry: Column, shift: Column) -> Column:
        return F.struct(done.alias("done"), carry.alias("carry"), shift.alias("shift"), left.alias("left"))

    rounded = F.transform(
        F.array(F.struct(up.alias("up"), moved.alias("shift"), can.alias("can"))),
        lambda v: F.when(v["can"], build(F.concat(state["done"], F.array(c.withField("x", v["up"]))), unit.withField("x", unit["x"] + v["shift"]), v["shift"])),
    )[0]
    paired = F.transform(F.array(_pivot(state, u, seed)), lambda p: build(p["done"], p["carry"], state["shift"]))[0]
    return F.when(c.isNull(), build(state["done"], u, state["shift"])).otherwise(F.coalesce(rounded, paired))


def _round_level(units: DataFrame, level: int) -> DataFrame:
    """One level of the tree: (source, block, unit, open) with one open unit for each block."""
    gathered = units.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    waiting = F.aggregate("units", F.lit(0).cast("long"), lambda n, u: n + F.when(u["waits"], u["size"]).otherwise(0))
    start = F.struct(
        F.array().cast(f"array<{_UNIT}>").alias("done"), F.lit(None).cast(_UNIT).alias("carry"), F.lit(0.0).alias("shift"), waiting.alias("left")
    )
    folded = gathered.select("source", "block", F.aggregate("units", start, lambda s, u: _step(s, u, level)).alias("s"))
    flagged = F.concat(
        F.transform("s.done", lambda u: F.struct(u.alias("unit"), F.lit(False).alias("open"))),
        F.array(F.struct(F.col("s.carry").alias("unit"), F.lit(True).alias("open"))),
    )
    return folded.select("source", "block", F.explode(flagged).alias("f")).select("source", "block", "f.unit", "f.open")


def _mixed(rows: DataFrame, weights: Sequence[float], boost: float, most: float, block: int) -> DataFrame:
    """Groups of equal rows(doc_id, source, size, key, twin), with how often the mix takes them.

    doc_id, key, twin, size, rows, source_size and target; each of the rows is taken base
    times, and more of them once more. Equal rows are one unit, as large as one of them:
    what their fractions make together is whole copies and one fraction.
    """
    grouped = rows.groupBy("doc_id", "source", "size", "key", "twin").agg(F.count("*").alias("rows")).checkpoint()
    targets = source_targets(grouped, weights, boost, most).checkpoint()
    seen = targets.agg(F.max("n").alias("n"), F.count("*").alias("sources"), F.sum("n").alias("all")).first()
    rest = seen["sources"] > BROADCAST_SOURCES
    often = F.col("n") * BROADCAST_SOURCES >= (seen["all"] or 0) if rest else F.lit(True)
    found = targets.select(F.col("source").alias("_source"), "n", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("_source"))

    def targeted(frame: DataFrame) -> DataFrame:
        """With the target of the source: of BROADCAST_SOURCES sources, the largest, by broadcast, of the others, none of which is large, by shuffle."""
        large = F.broadcast(found.where(often))
        out = frame.join(large, same)
        return out.unionByName(frame.join(large, same, "left_anti").join(found.where(~often), same)) if rest else out

    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(copies).cast("long")
    units = targeted(grouped).withColumn("base", base).withColumn("all", (copies - base) * F.col("rows"))
    more = F.least(F.floor("all").cast("long"), F.col("rows") - 1)
    units = units.withColumn("more", more).withColumn("x", F.least(F.col("all") - F.col("more"), F.lit(1 - 1e-12)))
    live = (F.col("x") > 0) & (F.col("size") > 0)
    blocks = F.ceil(F.col("n") / block).cast("long")
    at = F.pmod(F.xxhash64("key", F.lit(1)), blocks)
    unit = F.struct((at == 0).alias("waits"), (-F.col("size")).alias("order"), "key", "twin", "doc_id", "size", "rows", "base", "more", "x").cast(_UNIT)
    units = units.select("source", at.alias("block"), live.alias("live"), unit.alias("unit"))
    settled = [units.where("NOT live").select("source", F.col("unit").withField("x", F.lit(0.0)).alias("unit"))]
    waiting = units.where("live AND unit.waits").drop("live")
    units, left, level = units.where("live AND NOT unit.waits").drop("live"), -(-(seen["n"] or 0) // block), 0
    while left:
        if left == 1:
            units = units.unionByName(waiting)
        rounded = _round_level(units, level).checkpoint()
        settled.append(rounded.where("NOT open").select("source", "unit"))
        units = rounded.where("open").select("source", F.floor(F.col("block") / block).cast("long").alias("block"), "unit")
        left, level = (-(-left // block) if left > 1 else 0), level + 1
    last = F.when(_uniform("unit.key", F.lit(-1)) < F.col("unit.x"), 1.0).otherwise(0.0)
    settled.append(units.select("source", F.col("unit").withField("x", last).alias("unit")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = targeted(out)
    taken = (F.col("unit.more") + F.col("unit.x").cast("long")).alias("more")
    return out.select("unit.doc_id", "unit.key", "unit.twin", "unit.size", "unit.rows", "source_size", "target", "unit.base", taken)


def _spread(groups: DataFrame, count: str, place: str) -> DataFrame:
    """Each of groups(key, twin, …) as often as count says, numbered from 0 as place; a large count is dealt to several tasks first."""
    few, many = groups.where(F.col(count).between(1, EQUAL_ROWS)), groups.where(F.col(count) > EQUAL_ROWS)
    last = F.col(count) - 1
    parts = many.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / EQUAL_ROWS)))).repartition("key", "twin", "_part")
    start = F.col("_part") * EQUAL_ROWS
    spread = parts.withColumn(place, F.explode(F.sequence(start, F.least(last, start + (EQUAL_ROWS - 1))))).drop("_part")
    return few.withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), last))).unionByName(spread)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, boost: float = BOOST, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, key, size, source_size, target, copies and taken of every document.

    size is the number of words (a null text: 0), target the source's, copies how often
    the mix takes the document, and taken the words of all its copies. All randomness is
    a hash of doc_id and text, so reruns agree. A null source is a source. Documents
    without words are taken by their source's whole copies only, with no words. Rows with
    one doc_id and text are one unit of the tree, whose copies they share; each is a row
    of the result. Extra columns are ignored; an empty table gives no rows. A source with
    a third of all rows is dealt out over its blocks, so that no task has more of it than
    of others.
    """
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("twin"))
    out = _spread(_mixed(rows, weights, boost, most, block), "rows", "_place")
    copies = (F.col("base") + (F.col("_place") < F.col("more")).cast("long")).alias("copies")
    return out.select("doc_id", "key", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it.

    Rows are told apart by 128 bits of hash of all their columns, and rows that are equal
    in all of them are one whose copies they share. Columns may have any names. Null ids,
    texts and sources and empty tables are handled as by mix_sources.
    """
    prepare(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    plain = docs.toDF(*names)
    keyed = plain.withColumns({"key": F.xxhash64(*names), "twin": F.xxhash64(F.lit(1), *names)})
    size = F.coalesce(F.regexp_count(at["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rows = keyed.select(at["doc_id"].alias("doc_id"), at["source"].alias("source"), size.alias("size"), "key", "twin")
    mixed = _mixed(rows, WEIGHTS, BOOST, MOST, BLOCK).select("key", "twin", (F.col("base") * F.col("rows") + F.col("more")).alias("copies"))
    taken = keyed.dropDuplicates(["key", "twin"]).join(mixed, ["key", "twin"])
    return _spread(taken, "copies", "place").select(*names).toDF(*docs.columns)

"""Near-duplicate documents by SimHash, searched with a Gray-order hierarchical index.

Fingerprints that differ in at most two bits are linked. Two such fingerprints agree on
one of three blocks of bits, and outside that block on one of three parts of the rest, so
nine masked copies of a fingerprint bring every linked pair together. What shares a
masked pattern is sorted by Gray rank and put in a tree whose nodes hold the bits common
to all fingerprints below them; a search adds up the differences on the way down and
leaves a whole node as soon as they exceed two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import prepare
from cuelattice.llm.components import connected_components
from cuelattice.llm.textscan import Scan, slices, texts_of

SEED, SHINGLE, RADIUS, FANOUT = 42, 3, 2, 16
_U = np.uint64


def _masks() -> list[int]:
    """The nine masks: a block of bits, and a third of the other bits."""
    bits = list(range(64))
    blocks = [bits[0:22], bits[22:43], bits[43:64]]
    out = []
    for block in blocks:
        rest = [x for x in bits if x not in block]
        cut = (len(rest) + 2) // 3
        out += [sum(1 << x for x in block + rest[i * cut : (i + 1) * cut]) for i in range(3)]
    return out


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """SimHash of each text: bit i is set if it is set in over half the shingles' XXH64.

    A-Z count as lower case. Shingles are three consecutive words, with repeats; a text
    of one or two words is one shingle; a text without words gets zero.
    """
    scan = Scan(texts, lower=True)
    data, ws, we = scan.joined()
    words = np.diff(scan.ptr)
    first = np.repeat(scan.ptr[:-1], np.maximum(words - SHINGLE + 1, np.minimum(words, 1)))
    count = np.maximum(words - SHINGLE + 1, np.minimum(words, 1))
    ends = np.cumsum(count)
    start = first + np.arange(len(first)) - np.repeat(ends - count, count)
    last = np.minimum(start + SHINGLE, np.repeat(scan.ptr[1:], count)) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(data)
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(ws[start].tolist(), we[last].tolist(), strict=True)), np.uint64, len(start))
    out = np.zeros(len(texts), np.uint64)
    weights = _U(1) << np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero(count):
        own = hashes[ends[i] - count[i] : ends[i]]
        total = np.zeros(64, np.int64)
        for k in range(0, len(own), 1 << 15):
            total += np.unpackbits(own[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * total > count[i]].sum(dtype=np.uint64)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(shift))
    return x


class GrayIndex:
    """A forest over groups of fingerprints, each group sorted by Gray rank.

    group: the group of each fingerprint, not decreasing. levels[0] has the lowest nodes;
    a node never holds two groups, and the highest level has one node for each group.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray, fanout: int = FANOUT) -> None:
        order = np.lexsort((gray_rank(fps), group))
        self.order, self.fps, self.group = order, fps[order], group[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        ones, zeros, owner = self.fps, self.fps, self.group
        while True:
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
            size = np.diff(np.r_[head, len(owner)])
            if self.levels and (size <= 1).all():
                break
            place = np.arange(len(owner)) - np.repeat(head, size)
            start = np.flatnonzero(place % fanout == 0)
            ones, zeros = (np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(zeros, start)) if len(start) else (ones, zeros)
            shared = ~(ones ^ zeros)
            self.levels.append((start, np.diff(np.r_[start, len(owner)]), shared, ones & shared))
            owner = owner[start]
        self.roots = owner

    def links(self, radius: int = RADIUS, budget: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the input at most radius bits apart, each pair once, in blocks."""
        sizes = np.bincount(np.searchsorted(self.roots, self.group), minlength=len(self.roots))
        load = np.cumsum(np.repeat(sizes, sizes))
        a = 0
        while a < len(self.fps):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + budget, "right")))
            query = np.arange(a, b)
            node = np.searchsorted(self.roots, self.group[a:b])
            above = np.zeros(len(query), np.uint64)
            spent = np.zeros(len(query), np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                start, size, shared, pattern = self.levels[level]
                spent = spent + np.bitwise_count((self.fps[query] ^ pattern[node]) & shared[node] & ~above)
                near = spent <= radius
                query, node, spent = query[near], node[near], spent[near]
                n = size[node]
                above = np.repeat(shared[node], n)
                ends = np.cumsum(n)
                child = np.repeat(start[node] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                query, node, spent = np.repeat(query, n), child, np.repeat(spent, n)
            later = node > query
            query, node, spent, above = query[later], node[later], spent[later], above[later]
            near = spent + np.bitwise_count((self.fps[query] ^ self.fps[node]) & ~above) <= radius
            yield self.order[query[near]], self.order[node[near]]
            a = b


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place that the pairs connect it with."""
    root = np.arange(n)
    for u, v in pairs:
        while len(u):
            u, v = root[u], root[v]
            apart = u != v
            u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
            np.minimum.at(root, u, v)
            while (root[root] != root).any():
                root = root[root]
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key): links between what is near within each (part, key)."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        part, key, fp, rep = cols
        fresh = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1
        if several.any():
            fp, rep, group = fp[several].view(np.uint64), rep[several], group[several]
            root = forest(len(fp), GrayIndex(fp, group).links())
            tied = root != np.arange(len(fp))
            yield pa.RecordBatch.from_pydict({"u": rep[tied], "v": rep[root[tied]]})

    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
        rows += batch.num_rows
        if rows >= 1 << 17:
            cols = tuple(map(np.concatenate, zip(*held, strict=True)))
            part, key = cols[0], cols[1]
            whole = int(np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])[-1])
            if whole:
                yield from flush(tuple(c[:whole] for c in cols))
            held, rows = [tuple(c[whole:] for c in cols)], 0
    if held and sum(len(c[0]) for c in held):
        yield from flush(tuple(map(np.concatenate, zip(*held, strict=True))))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            prints = pa.array(fingerprints(texts_of(part)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), prints, *part.columns[2:]], names=["doc_id", "fp", *part.schema.names[2:]])


def _prints(docs: DataFrame, others: list[str]) -> DataFrame:
    """doc_id, fp and the other columns (long) of every document, checkpointed."""
    prepare(docs.sparkSession)
    kind = "doc_id long, fp long" + "".join(f", {c} long" for c in others)
    return docs.select("doc_id", "text", *others).mapInArrow(_fingerprint_batches, kind).checkpoint()


def _components(prints: DataFrame, node: str) -> DataFrame:
    """fp and component_id of every distinct fingerprint.

    node: doc_id or fp, whose smallest value names a fingerprint, and a component.
    """
    reps = prints.groupBy("fp").agg(F.min(node).alias("rep"))
    keyed = reps.where("rep IS NOT NULL").select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)])).alias("k"), "fp", "rep"
    )
    keyed = keyed.select("k.part", "k.key", "fp", "rep")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = keyed.repartition(parts, "part", "key").sortWithinPartitions("part", "key").mapInArrow(_stars, "u long, v long")
    component = connected_components(links).withColumnRenamed("id", "rep")
    return reps.join(component, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id reachable over links of two bits or fewer. A null
    or wordless text has fingerprint zero and links like any other. Repeated rows keep a
    row each; a null doc_id gets its fingerprint and the component its fingerprint is in.
    Extra columns are ignored; an empty table gives no rows. Only distinct fingerprints
    are searched, each with the smallest doc_id that has it, so that copies cost nothing.
    """
    prints = _prints(docs, [])
    labelled = prints.join(_components(prints, "doc_id"), "fp", "left")
    return labelled.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, a null one last, and of several the smallest hash.

    Rows are told apart by 128 bits of hash of all their columns, and components are those of
    the fingerprints, so that rows of one doc_id, or without any, go only if their own
    component has another row. Null and wordless texts are one component. Each task makes one
    row of the equal ones it has, and of those of a fingerprint, before anything is shuffled, so
    that no group of copies is in one task. Columns may have any names; an empty table gives no
    rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    keyed = docs.toDF(*names).withColumns({"one": F.xxhash64(*names), "two": F.xxhash64(F.lit(1), *names)})
    prints = _prints(keyed.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "one", "two"), ["one", "two"])
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "one", "two")).alias("k"))
    kept = first.join(_components(prints, "fp"), "fp").groupBy("component_id").agg(F.min("k").alias("k")).select("k.one", "k.two")
    return keyed.dropDuplicates(["one", "two"]).join(kept, ["one", "two"], "left_semi").select(*names).toDF(*docs.columns)

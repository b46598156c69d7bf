"""Near-duplicate vectors by a pivot-permutation index.

Pivots are unit vectors drawn from a bounded sample. A vector is described by
its ``nearest`` pivots; every set of ``shared`` of them is a key of an inverted
list, so two vectors meet where they have that many of their nearest pivots in
common. Candidates are verified by cosine in double precision. Vectors alike in
every bit (within a label) are one class and are indexed once.

A list may hold a third of all rows, so lists are cut into blocks of bounded
size, and pairs of blocks are compared, each on its own. A pair of vectors that
meets in several lists counts only in the one named by the smallest pivots they
share, so links are counted without a list of all pairs: a task returns each
vector's links in it, and a spanning forest of them.

The index is approximate: recall depends on ``pivots``, ``nearest`` and
``shared`` and is measured against brute force in the tests. The number of
pivots grows with the cube root of the rows, which keeps lists equally short.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, join_bounded, uniform_key
from vecloom.llm.components import connected_components

BLOCK = 512
#: Lists up to this long are compared many at a time.
SHORT = 48
KEYS_TO_BROADCAST = 500_000
_RUN = ["label", "key", "lo", "hi"]


def draw_pivots(vectors: DataFrame, pivots: int, seed: int) -> np.ndarray:
    """Unit vectors taken from the rows of lowest random key; fewer if there are fewer distinct ones."""
    rows = vectors.orderBy(uniform_key(seed, F.col("vector"))).limit(pivots).select("vector").collect()
    return np.unique(_unit(np.array([r[0] for r in rows], dtype=np.float64)), axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _describe(pivots: np.ndarray, nearest: int):
    """Add the sorted numbers of the nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                near = np.argsort(-(_unit(_matrix(part.column(3))) @ pivots.T), axis=1, kind="stable")[:, :nearest]
                near = np.sort(near, axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * nearest), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "near"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what the given links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _pairs_of_short(length: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each run."""
    row = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    later = np.repeat(start + length, length) - row - 1
    i = np.repeat(row, later)
    return i, i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)


def _links(t: pa.Table, threshold: float, base: int, shared: int) -> pa.RecordBatch | None:
    """Compare the rows of each run of one list and block pair; whole runs only."""
    key, lo, hi, side = (t[c].to_numpy() for c in ("key", "lo", "hi", "side"))
    cid, copies = t["cid"].to_numpy(), t["copies"].to_numpy()
    label = t["label"].combine_chunks().dictionary_encode()
    label = np.asarray((label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices)
    v, near = _unit(_matrix(t["vector"].combine_chunks())), np.asarray(t["near"].combine_chunks().flatten()).reshape(len(cid), -1)
    change = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(label) != 0)) + 1
    start = np.concatenate([[0], change])
    length = np.diff(np.concatenate([start, [len(cid)]]))
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        """Of linked pairs, those whose list is the one of their smallest shared pivots."""
        common = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
        common &= np.cumsum(common, axis=1) <= shared
        named = near[i][common].reshape(len(i), shared).astype(np.int64)
        number = np.zeros(len(i), dtype=np.int64)
        for c in range(shared):
            number = number * base + named[:, c]
        own = number == key[i]
        left.append(i[own])
        right.append(j[own])

    short = length <= SHORT
    i, j = _pairs_of_short(length[short], start[short])
    ok = (lo[i] == hi[i]) | (side[i] != side[j])
    i, j = i[ok], j[ok]
    for k in range(0, len(i), 100_000):
        a, b = i[k : k + 100_000], j[k : k + 100_000]
        near_enough = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
        keep(a[near_enough], b[near_enough])
    for s, n in zip(start[~short].tolist(), length[~short].tolist(), strict=True):
        one = np.arange(s, s + n)
        two = one
        if lo[s] != hi[s]:
            one, two = one[side[one] == 0], one[side[one] == 1]
        a, b = np.nonzero(v[one] @ v[two].T >= threshold)
        a, b = one[a], two[b]
        if lo[s] == hi[s]:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 100_000):
            keep(a[k : k + 100_000], b[k : k + 100_000])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return None
    who, where = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
    links = np.bincount(where, weights=np.concatenate([copies[j], copies[i]])).astype(np.int64)
    a, b = _forest(cid[i], cid[j])
    return pa.RecordBatch.from_arrays(
        [pa.array([*who.tolist(), *a], pa.int64()), pa.array([None] * len(who) + b, pa.int64()), pa.array([*links.tolist(), *[0] * len(a)], pa.int64())], names=["a", "b", "links"]
    )


def _compare(threshold: float, base: int, shared: int):
    """Rows come sorted by run; a run is bounded by two blocks, and only the last one is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                new = pa.Table.from_batches([batch.slice(k, 8192)])
                t = new if held is None else pa.concat_tables([held, new])
                last = [t[c][-1].as_py() for c in _RUN]
                at = t.num_rows
                keys, los, his = (t[c].to_numpy() for c in ("key", "lo", "hi"))
                labels = t["label"].to_pylist()
                while at and keys[at - 1] == last[1] and los[at - 1] == last[2] and his[at - 1] == last[3] and labels[at - 1] == last[0]:
                    at -= 1
                held = t.slice(at)
                if at and (out := _links(t.slice(0, at), threshold, base, shared)) is not None:
                    yield out
        if held is not None and (out := _links(held, threshold, base, shared)) is not None:
            yield out

    return run


def near_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, pivots: int | None = None, nearest: int = 8, shared: int = 3, seed: int = 5
) -> DataFrame:
    """Links between vectors of one label whose cosine is ``threshold`` or more.

    Returns id, n_links (other vectors linked directly), component_id (least id
    reachable by links, itself included) and kept, one row per vector. Without
    ``pivots``, six times the cube root of the number of distinct vectors.

    - A null vector or label, an empty or zero vector, or one with a null, NaN or
      infinite component links with nothing and is kept.
    - Vectors of unlike length are never compared; each length has its own index.
    - Repeated rows and equal vectors are linked. A null id never names a
      component unless all its members' ids are null.
    - An empty table gives an empty result. Other columns are ignored.
    """
    spark, space = df.sparkSession, Workspace(df.sparkSession, "pivots")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    plain = F.transform("vector", lambda x: x + F.lit(0).cast(dict(rows.dtypes)["vector"][6:-1]))  # -0 becomes 0
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), plain))
    rows = space.save(rows.withColumn("cid", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))), "rows")
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = space.save(classes, "classes")
    found = []
    for length, n in sorted(classes.groupBy(F.size("vector")).count().collect()):
        own = classes.filter(F.size("vector") == length).select("label", "cid", "copies", "vector")
        chosen = draw_pivots(own, pivots or max(nearest, round(6 * n ** (1 / 3))), seed)
        found.append(_compare_lists(space, own, chosen, min(nearest, len(chosen)), min(shared, len(chosen)), threshold, str(length)))
    both = spark.createDataFrame([], "a long, b long, links long")
    for x in found:
        both = both.union(x)
    counted = both.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(space, both.filter("b is not null").select("a", "b"), "parts")
    named = classes.select("cid", "rep", "copies").join(parts, F.col("cid") == F.col("node"), "left").join(counted, F.col("cid") == F.col("a"), "left")
    named = space.save(named.select("cid", "rep", F.coalesce("component", "cid").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = space.save(named.groupBy("part").agg(F.min("rep").alias("component_id")), "least")
    names = space.save(named.join(least, "part").select("cid", "component_id", "n_links"), "names")
    joined = rows.select("id", "cid").join(names, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _compare_lists(space: Workspace, own: DataFrame, pivots: np.ndarray, nearest: int, shared: int, threshold: float, name: str) -> DataFrame:
    """Fill the inverted lists and compare within each, block against block."""
    types = dict(own.dtypes)
    described = own.mapInArrow(_describe(pivots, nearest), f"label {types['label']}, cid long, copies long, vector {types['vector']}, near array<int>")
    described = space.save(described, f"near_{name}")
    number = lambda subset: sum((F.col("near")[p].cast("long") * len(pivots) ** (shared - 1 - c) for c, p in enumerate(subset)), F.lit(0).cast("long"))
    keys = F.array(*[number(s) for s in itertools.combinations(range(nearest), shared)])
    entries = described.select("label", F.explode(keys).alias("key"))
    lengths = entries.groupBy("label", "key").count().filter("count > 1").select("label", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    lengths = space.save(lengths, f"lists_{name}")
    met = join_bounded(described.withColumn("key", F.explode(keys)), lengths, ["label", "key"], "inner", KEYS_TO_BROADCAST)
    block = F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("lo"), F.greatest(block, o).alias("hi"), F.when(block <= o, 0).otherwise(1).alias("side")))
    dealt = met.withColumn("p", F.explode(pair)).select("label", "key", "p.lo", "p.hi", "p.side", "cid", "copies", "vector", "near")
    dealt = dealt.repartition(*_RUN).sortWithinPartitions(*_RUN)
    return space.save(dealt.mapInArrow(_compare(threshold, len(pivots), shared), "a long, b long, links long"), f"found_{name}")

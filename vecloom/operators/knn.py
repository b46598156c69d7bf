"""Exact nearest-neighbour search: one query, many queries, within a radius, per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import ALIASES, COSINE_EPSILON, METRICS

#: Queries sent to the executors at once; more are worked off in blocks of this size.
QUERY_BLOCK = 2_048


def metric_of(name: str):
    return METRICS[ALIASES.get(name, name)]


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(df: DataFrame, query, k: int, *, metric: str = "l2", id_col: str = "id", vector_col: str = "vec", where: Column | None = None, offset: int = 0, distance: str = "dist") -> DataFrame:
    """The ``k`` rows nearest to ``query`` (a sequence or a Column), after ``offset``; ties by id.

    ``where`` filters before the search, so it reaches the scan. Rows with a null
    vector never come up. The plan is one scan and a top-k merge, no full sort.
    """
    measure, ascending = metric_of(metric)
    rows = df if where is None else df.filter(where)
    query = query if isinstance(query, Column) else literal(query)
    rows = rows.withColumn(distance, measure(F.col(vector_col), query)).filter(F.col(distance).isNotNull())
    order = F.col(distance).asc_nulls_last() if ascending else F.col(distance).desc_nulls_last()
    top = rows.orderBy(order, F.col(id_col).asc_nulls_last()).limit(max(0, k) + max(0, offset))
    return top.offset(offset) if offset else top


def within(df: DataFrame, query, radius: float, *, metric: str = "l2", vector_col: str = "vec", distance: str = "dist") -> DataFrame:
    """All rows at most ``radius`` away (or at least as similar, where more is nearer)."""
    measure, ascending = metric_of(metric)
    rows = df.withColumn(distance, measure(F.col(vector_col), query if isinstance(query, Column) else literal(query)))
    return rows.filter(F.col(distance) <= radius if ascending else F.col(distance) >= radius)


def checked(rows: DataFrame, found: DataFrame, query, k: int, *, metric: str = "l2") -> DataFrame:
    """id, dist of the exact ``k`` nearest rows (id, vec), from a small table ``found`` of candidates (id).

    The candidates are measured; then every row that is no farther than the k-th of
    them is ranked, in one scan. So the result does not depend on the candidates,
    only on how many rows are ranked. Fewer than ``k`` candidates bound nothing.
    """
    best = knn(rows.join(F.broadcast(found.select("id")), "id", "left_semi"), query, k, metric=metric)
    n, far = best.agg(F.count("dist"), F.max("dist") if metric_of(metric)[1] else F.min("dist")).first()
    near = rows if n < k or not k else within(rows, query, far, metric=metric).drop("dist")
    return knn(near, query, k, metric=metric).select("id", "dist")


def knn_by_group(df: DataFrame, query, k: int, group: str, *, metric: str = "l2", id_col: str = "id", vector_col: str = "vec", distance: str = "dist") -> DataFrame:
    """The ``k`` nearest rows of every group; the rank filter lets each task keep k rows a group before the exchange."""
    measure, ascending = metric_of(metric)
    rows = df.withColumn(distance, measure(F.col(vector_col), query if isinstance(query, Column) else literal(query))).filter(F.col(distance).isNotNull())
    order = F.col(distance).asc() if ascending else F.col(distance).desc()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, F.col(id_col))))
    return ranked.filter(F.col("rank") <= k)


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows of q against rows of x, less is nearer."""
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        return 1 - dot / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1) + COSINE_EPSILON)
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * dot, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _block_topk(query_ids, queries: np.ndarray, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_d, held_i = np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                ids = part.column(0).to_numpy()
                d = np.hstack([held_d, distances(matrix(part.column(1)), queries, metric)])
                i = np.hstack([held_i, np.broadcast_to(ids, (len(queries), len(ids)))])
                if d.shape[1] > k:  # ties at the edge go to the smaller id
                    order = np.stack([np.lexsort((i[r], d[r]))[:k] for r in range(len(d))])
                    d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                held_d, held_i = d, i
        if held_d.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, held_d.shape[1])), pa.array(held_i.ravel()), pa.array(held_d.ravel())], names=["query_id", "id", "dist"])

    return run


def knn_join(base: DataFrame, queries: DataFrame, k: int, *, metric: str = "l2", id_col: str = "id", vector_col: str = "vec", query_id: str = "query_id", query_vector: str = "query_vec") -> DataFrame:
    """The ``k`` nearest base rows of every query row: query_id, id, dist (less is nearer), rank.

    Queries are worked off in blocks of bounded size; each task keeps k rows a
    query, by matrix products, and the parts are merged. Ids are integers; null
    vectors match nothing and are not matched.
    """
    metric = {"cos": "cosine", "negative_ip": "ip"}.get(ALIASES.get(metric, metric), ALIASES.get(metric, metric))
    rows = base.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).alias("v")).orderBy("q")
    parts, block_ids, block = None, [], []

    def search(ids: list, vectors: list) -> DataFrame:
        return rows.mapInArrow(_block_topk(np.array(ids), np.array(vectors, dtype=np.float64), k, metric), "query_id long, id long, dist double")

    for row in asked.toLocalIterator():
        block_ids.append(row[0])
        block.append(row[1])
        if len(block) == QUERY_BLOCK:
            parts = search(block_ids, block) if parts is None else parts.union(search(block_ids, block))
            block_ids, block = [], []
    if block or parts is None:
        last = search(block_ids, block) if block else base.sparkSession.createDataFrame([], "query_id long, id long, dist double")
        parts = last if parts is None else parts.union(last)
    best = Window.partitionBy("query_id").orderBy("dist", "id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def vector_avg(df: DataFrame, group: str, vector_col: str = "vec") -> DataFrame:
    """Mean vector of every group: group, mean."""
    items = df.filter(F.col(vector_col).isNotNull()).select(group, F.posexplode(vector_col).alias("pos", "x"))
    per = items.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))

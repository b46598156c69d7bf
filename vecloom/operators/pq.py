"""Product quantization: train on a bounded sample, encode, search by distance tables, refine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.knn import checked, knn, matrix

#: Rows that codebooks are trained on, at most.
SAMPLE_ROWS = 16_384
CENTROIDS = 256


@dataclass(frozen=True)
class Codebook:
    """centroids: sub-spaces x 256 x dimensions of each; metric l2, cosine or ip."""

    centroids: np.ndarray
    metric: str

    @property
    def m(self) -> int:
        return len(self.centroids)


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    """Lloyd's algorithm from k-means++ seeds. With at most k distinct points, these are the centroids."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return np.vstack([distinct, np.repeat(distinct[-1:], k - len(distinct), axis=0)])
    seeds = [distinct[rng.integers(len(distinct))]]
    gap = ((distinct - seeds[0]) ** 2).sum(1)
    for _ in range(k - 1):
        seeds.append(distinct[rng.choice(len(distinct), p=gap / gap.sum())] if gap.sum() > 0 else distinct[rng.integers(len(distinct))])
        gap = np.minimum(gap, ((distinct - seeds[-1]) ** 2).sum(1))
    c = np.array(seeds)
    for _ in range(rounds):
        own = nearest(x, c)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        moved = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if np.allclose(moved, c):
            break
        c = moved
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(axis=1)


def train(df: DataFrame, m: int, *, metric: str = "l2", id_col: str = "id", vector_col: str = "vec", seed: int = 1) -> Codebook:
    """Codebooks of ``m`` sub-spaces from the rows of lowest hashed id."""
    rows = df.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).collect()
    x = _prepared(np.array([r[0] for r in rows], dtype=np.float64), metric)
    if x.ndim != 2 or x.shape[1] % m:
        raise ValueError(f"{m} sub-spaces do not divide the vectors' dimensions")
    rng = np.random.default_rng(seed)
    return Codebook(np.stack([kmeans(part, CENTROIDS, rng) for part in np.split(x, m, axis=1)]), metric)


def encode(df: DataFrame, book: Codebook, *, id_col: str = "id", vector_col: str = "vec") -> DataFrame:
    """id, code (one byte for each sub-space); rows with a null vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _prepared(matrix(batch.column(1)), book.metric)
            codes = np.stack([nearest(p, c) for p, c in zip(np.split(x, book.m, axis=1), book.centroids, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in codes], pa.binary())], names=["id", "code"])

    rows = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector_col)
    return rows.mapInArrow(run, "id long, code binary")


def distance_table(book: Codebook, query: np.ndarray) -> np.ndarray:
    q = _prepared(np.asarray(query, dtype=np.float64)[None], book.metric)[0]
    parts = np.split(q, book.m)
    if book.metric == "l2":
        return np.stack([((c - p) ** 2).sum(1) for p, c in zip(parts, book.centroids, strict=True)])
    return np.stack([-(c @ p) for p, c in zip(parts, book.centroids, strict=True)])


def search(codes: DataFrame, book: Codebook, query, k: int, *, refine: DataFrame | None = None, factor: float = 1.0, exact: bool = False, id_col: str = "id", vector_col: str = "vec") -> DataFrame:
    """The ``k`` nearest by codes: id, dist. With ``refine`` (the vectors), k * factor candidates are measured exactly.

    With ``exact`` too, one scan of ``refine`` adds the rows that codes left out
    and that are no farther than the k-th candidate.
    """
    table = distance_table(book, query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes_ = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            d = table[np.arange(book.m), codes_].sum(axis=1)
            d = np.sqrt(np.maximum(d, 0)) if book.metric == "l2" else d + (book.metric == "cosine")
            top = np.lexsort((batch.column(0).to_numpy(), d))[: max(k, int(np.ceil(k * factor)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(top)), pa.array(d[top])], names=["id", "dist"])

    found = codes.mapInArrow(run, "id long, dist double").orderBy("dist", "id").limit(max(k, int(np.ceil(k * factor))))
    if refine is None:
        return found.limit(k)
    metric = {"ip": "negative_ip"}.get(book.metric, book.metric)
    if exact:
        rows = refine.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
        return checked(rows, found, query, k, metric=metric)
    candidates = refine.join(F.broadcast(found.select(F.col("id").alias("_id"))), F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    return knn(candidates, query, k, metric=metric).select("id", "dist")

"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt by hash to partitions. How many rows each partition sends to
each shard is drawn exactly from the multivariate hypergeometric law, given the
partition's size and what each shard still lacks. Each partition is permuted
locally and cut by its row of the matrix, rows are exchanged, and each shard is
permuted again, block by block. All of it is DataFrame operations; only the
matrix, one row per partition, is drawn on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import Workspace, join_bounded, uniform_key

ROWS_PER_PARTITION = 1 << 16
TO_BROADCAST = 200_000
#: Above this, numpy draws no hypergeometric numbers.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good; exact in law, up to floating point beyond 1e9."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left, u = rng.random() - at, mode
    below = above = at
    k, j = mode, mode
    while left > 0 and (k > low or j < high):
        if j < high:
            above *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
            j += 1
            left -= above
            u = j
        if left > 0 and k > low:
            below *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
            k -= 1
            left -= below
            u = k
    return u


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows: partitions; columns: how many rows go to each shard. Shard sizes differ by at most one."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    lacks = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for size in sizes:
        row, rest, others = [], size, sum(lacks)
        for lack in lacks:
            others -= lack
            got = hypergeometric(rng, lack, others, rest)
            row.append(got)
            rest -= got
        lacks = [a - b for a, b in zip(lacks, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, keys: list[Column], n_shards: int = 16, seed: int = 29) -> DataFrame:
    """``df`` with shard (0 to n_shards - 1) and slot (0, 1, ... within the shard).

    ``keys`` describe a row; rows alike in all of them are interchangeable and
    may repeat, nulls included. Counts of shards differ by at most one. An empty
    table stays empty. Columns of ``df`` named shard or slot are replaced; names
    that begin with ``_sh_`` are ours. Reruns agree.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    keyed = df.withColumn("_sh_first", uniform_key(seed, *keys)).withColumn("_sh_second", uniform_key(seed + 1, *keys))
    n = keyed.select("_sh_first").count()
    parts = max(1, -(-n // ROWS_PER_PARTITION))
    keyed = keyed.withColumn("_sh_part", F.pmod(F.col("_sh_first"), F.lit(parts)))
    sizes = dict(keyed.groupBy("_sh_part").count().collect())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], n_shards, seed)
    ends = [(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)]
    ends_of = spark.createDataFrame(ends, T.StructType([T.StructField("_sh_part", T.LongType()), T.StructField("_sh_ends", T.ArrayType(T.LongType()))]))
    local = Window.partitionBy("_sh_part").orderBy("_sh_first", "_sh_second")
    dealt = join_bounded(keyed.withColumn("_sh_at", F.row_number().over(local) - 1), ends_of, "_sh_part", "inner", TO_BROADCAST)
    dealt = dealt.withColumn("shard", F.size(F.filter("_sh_ends", lambda end: end <= F.col("_sh_at"))))
    bits = max(0, math.ceil(math.log2(max(1, n / n_shards / ROWS_PER_PARTITION))))
    block = F.shiftrightunsigned("_sh_second", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = dealt.withColumn("_sh_block", block)
    within = Window.partitionBy("shard", "_sh_block").orderBy("_sh_second", "_sh_first")
    placed = dealt.withColumn("_sh_at", F.row_number().over(within) - 1)
    if bits:
        counts = dealt.groupBy("shard", "_sh_block").count()
        before = F.sum("count").over(Window.partitionBy("shard").orderBy("_sh_block").rowsBetween(Window.unboundedPreceding, -1))
        placed = join_bounded(placed, counts.select("shard", "_sh_block", F.coalesce(before, F.lit(0)).alias("_sh_before")), ["shard", "_sh_block"], "inner", TO_BROADCAST)
    else:
        placed = placed.withColumn("_sh_before", F.lit(0))
    return placed.withColumn("slot", F.col("_sh_before") + F.col("_sh_at")).select(*df.columns, "shard", "slot")


def shard_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, seed: int = 29) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.

    A null text counts as an empty one, so its size is 1. Null ids, repeated rows
    and equal texts are dealt like any other row; other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    space = Workspace(df.sparkSession, "shard")
    narrow = space.save(df.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "rows")
    placed = shuffle_into_shards(narrow, [F.col("id"), F.col("text_crc32"), F.col("size")], n_shards, seed)
    return placed.withColumnRenamed("id", id_col)

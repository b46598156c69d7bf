"""Mixing sources to target weights by the cube method.

Every source gets a target number of words: the weights share a multiple of all
words, and no target exceeds ``cap`` times its source, what is above being
shared anew by weight. A document's inclusion probability is target over size
of its source, whose whole part is taken outright. The fractional part is
sampled by the cube method: a flight phase moves the probabilities through the
null space of two balancing constraints (number of documents and number of
words) until each is 0 or 1, but for at most two documents of a group.

Flights run in groups of bounded size, dealt by a hash of the document, so a
source with a third of all rows is many groups. What a group leaves open goes
to the next level, where groups are merged, until one group per source is left;
its at most two documents are the landing problem, solved by the rounding with
the least error in words. Each source lands at the level where it has one group,
whatever the size of the others.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import WORD, Workspace, join_bounded, uniform_key

GROUP_ROWS = 4096
MERGED_GROUPS = 1024
SOURCES_TO_BROADCAST = 100_000
_EPS = 1e-9


def word_count(text):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: rank (by code point, null last), source_size, n_docs, target.

    The targets are where the water level stands when every source is filled by
    weight up to its cap. Works on one row per source only.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", weight)
    by_ratio = everything.orderBy("ratio", "rank")
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = (
        per.withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    )
    open_level = F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank"))).over(everything)
    return per.withColumn("target", F.least(F.col("limit"), F.coalesce(open_level * F.col("weight"), F.col("limit")))).select("source", "rank", "source_size", "n_docs", "target")


def flight(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping their sum and their sum weighted by size; at most two stay open."""
    out = prob.astype(float).copy()
    sizes, draws = size.astype(float).tolist(), rng.random(len(out)).tolist()
    active: list[int] = []
    for i, draw in enumerate(draws):
        if not _EPS < out[i] < 1 - _EPS:
            out[i] = round(out[i])
            continue
        active.append(i)
        direction = _null_vector([sizes[j] for j in active])
        if direction is None:
            continue
        up = min((1 - out[j]) / d if d > 0 else -out[j] / d for j, d in zip(active, direction, strict=True) if d)
        down = min(out[j] / d if d > 0 else (out[j] - 1) / d for j, d in zip(active, direction, strict=True) if d)
        step = up if draw * (up + down) < down else -down
        for j, d in zip(active, direction, strict=True):
            out[j] += step * d
            if out[j] < _EPS or out[j] > 1 - _EPS:
                out[j] = round(out[j])
        active = [j for j in active if 0 < out[j] < 1]
    return out


def _null_vector(sizes: list[float]) -> list[float] | None:
    """A direction that changes neither the count nor the words, or None where there is none."""
    if len(sizes) == 2:
        return [1.0, -1.0] if sizes[0] == sizes[1] else None
    if len(sizes) == 3:
        a, b, c = sizes
        return [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
    return None


def landing(size: np.ndarray, prob: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Round the open probabilities so that words err least, then the count.

    A long document left open would still err by much in a small source, so the
    error is then paid back by turning over decided documents of the same group
    whose given probability was open, while each turn lowers it.
    """
    out, still = prob.copy(), [i for i in range(len(prob)) if 0 < prob[i] < 1]
    due = sum(prob[i] * float(size[i]) for i in still)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(still)),
        key=lambda y: (round(abs(sum(v * float(size[i]) for v, i in zip(y, still, strict=True)) - due), 6), abs(sum(y) - sum(prob[still])), y),
    )
    error = sum(v * float(size[i]) for v, i in zip(best, still, strict=True)) - due
    out[still] = best
    free = np.flatnonzero((given > 0) & (given < 1))
    while len(free):
        turned = error + np.where(out[free] > 0, -1.0, 1.0) * size[free]
        i = int(np.argmin(np.abs(turned)))
        if abs(turned[i]) >= abs(error) - _EPS:
            break
        out[free[i]], error = 1 - out[free[i]], float(turned[i])
    return out


def _level(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([seed, level, *(int(k) for k in key)])
        prob = flight(rows["size"].to_numpy(), rows["prob"].to_numpy(), rng)
        return rows.assign(prob=landing(rows["size"].to_numpy(), prob, rows["prob"].to_numpy()) if rows["groups"].iloc[0] <= 1 else prob)

    return run


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17
) -> DataFrame:
    """How often the mix takes each row.

    Returns ``id_col``, row (number among rows of one id, source and text), source,
    text_crc32, size, source_size, target, copies and taken, one row per input row.

    - Null and empty texts and texts of white space have size 0 and are taken 0 times.
    - A null source is a source of its own, last in rank; a null id is an id.
    - Rows that repeat are units of their own, told apart by ``row``.
    - An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    space = Workspace(df.sparkSession, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.crc32(text.cast("binary")).alias("text_crc32"), word_count(F.col(text_col)).alias("size"))
    sized = space.save(sized, "sized")
    stats = space.save(source_targets(sized, weights, share, cap).withColumn("groups", F.ceil(F.col("n_docs") / GROUP_ROWS).cast("long")), "stats")
    ties = Window.partitionBy("id", "source", "text_crc32", "size").orderBy(F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = join_bounded(sized.withColumn("row", F.row_number().over(ties)), stats.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "inner", SOURCES_TO_BROADCAST)
    order = uniform_key(seed, F.col("id"), F.col("text_crc32"), F.col("row"))
    units = units.select(
        "id", "row", "source", "text_crc32", "size", "source_size", "target", "rank", "groups", F.pmod(order, F.col("groups")).alias("group"), order.alias("order"),
        F.floor(rate).alias("base"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("prob"),
    )
    most = stats.agg(F.max("groups")).first()[0] or 1
    done, level = [], 0
    while True:
        moved = units.groupBy("rank", "group").applyInPandas(_level(seed, level), units.schema)
        moved = space.save(moved, f"level{level}")
        still = (F.col("prob") > 0) & (F.col("prob") < 1)
        done.append(moved.filter(~still))
        if most <= 1:
            break
        units = moved.filter(still).withColumn("group", F.floor(F.col("group") / MERGED_GROUPS)).withColumn("groups", F.ceil(F.col("groups") / MERGED_GROUPS))
        most, level = -(-most // MERGED_GROUPS), level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    space.drop("sized", "stats")
    copies = F.col("base") + F.when(F.col("size") > 0, F.col("prob").cast("long")).otherwise(0)
    return result.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "row", "source", "text_crc32", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )

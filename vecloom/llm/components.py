"""Connected components by distributed union-find: alternating large and small stars.

Each round hangs every node's neighbours under its smallest one, on DataFrames
only; no link or component reaches the driver. Smallest neighbours are
aggregated first (map-side) and written, so the join back is between two plain
exchanges and a node with very many neighbours can be split by the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, join_bounded

#: How often members of a list are compared with one member of it before pairs are made.
HUB_ROUNDS = 4
#: Rows of two or three 64-bit numbers up to which a table is sent to all tasks: under 20 MB.
KEYS_TO_BROADCAST = 200_000


def connected_components(space: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (its smallest node) for every node with an edge.

    Self-links and repeated links are allowed, links with a null are ignored.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = space.save(pairs, f"{label}_0")
    step = 0
    while not _are_stars(current):
        step += 1
        both = current.union(current.select("v", "u"))
        least = space.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}_least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = space.save(large, f"{label}_large")
        below = space.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}_below")
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below).distinct()
        current = space.save(small, f"{label}_{step}")
        space.drop(f"{label}_{step - 1}", f"{label}_least", f"{label}_large", f"{label}_below")
    roots = current.select(F.col("v").alias("u")).distinct()
    return space.save(current.union(roots.withColumn("m", F.col("u"))).toDF("node", "component"), f"{label}_components")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, which itself hangs under none."""
    several = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("u")
    inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return not several.union(inner).limit(1).count()


def linked_components(space: Workspace, keys: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]], possible: Callable[[str, str], Column] | None, across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of sets under verified links, where sets that may be linked share a key.

    ``keys``: key, cid, n, room, rank (long), no row twice; read twice. ``prepare`` gets
    the cids that may be compared and returns what makes the linked ones out of a
    table of pairs a, b; its second argument names scratch tables. ``possible`` says by n and room, under the two prefixes given, whether
    two members of a key may be linked; it must hold in at least one shared key of
    every linked pair, and still with a larger room; with None, any two may. ``across`` makes, from key, cid, part,
    the pairs a, b of different parts that may be linked, their parts one, two and how far they are
    apart, in place of a join on the key. If these are many for the parts, the nearest pair of each
    two parts is verified first, then what is still apart. Returns node, component as ``connected_components`` does; sets
    without links are left out.

    Lists with the same members are one. First each set is compared with one hub,
    the member of highest rank in one of its lists, the one that it meets most
    often; then with others drawn at random, while lists with members in several
    components remain and this helps. Then pairs are made of what lies in
    different components and may be linked. So a large group of near copies costs
    about one comparison a member, and no link that could join components goes unseen.
    """
    sign = [F.bit_xor(F.xxhash64(F.lit(seed), "cid")).alias(f"sign{seed}") for seed in (1, 2)]
    shared = keys.groupBy("key").agg(F.count("*").alias("rows"), *sign).filter("rows > 1")
    shared = space.save(shared, "shared")
    if not shared.limit(1).count():
        return space.spark.createDataFrame([], "node long, component long")
    names = shared.groupBy("rows", "sign1", "sign2").agg(F.min("key").alias("name"))
    named = space.save(shared.join(names, ["rows", "sign1", "sign2"]).select("key", "name"), "named")
    rows = join_bounded(keys, named, "key", "inner", KEYS_TO_BROADCAST).groupBy(F.col("name").alias("key"), "cid")
    rows = rows.agg(F.first("n").alias("n"), F.max("room").alias("room"), F.first("rank").alias("rank"), F.count("*").alias("times"))
    rows = space.save(rows, "rows_0")
    space.drop("shared", "named")
    verify = prepare(rows.select("cid").distinct())
    links, parts = space.spark.createDataFrame([], "a long, b long"), None
    open_rows, before, step = rows.withColumn("part", F.col("cid")), rows.count() if across else None, 0
    while step < HUB_ROUNDS:
        step += 1
        order = F.struct("rank", "cid") if step == 1 else F.struct(F.xxhash64(F.lit(step), "cid"), F.col("cid"))
        hubs = open_rows.groupBy("key").agg(F.max_by(F.struct("cid", "n", "room", "part"), order).alias("hub")).select("key", *[F.col(f"hub.{c}").alias(f"{c}_h") for c in ("cid", "n", "room", "part")])
        hubs = space.save(hubs, f"hubs_{step}")
        near = open_rows.toDF(*[c if c in ("key", "times") else f"{c}_m" for c in open_rows.columns]).join(hubs, "key").filter(F.col("part_m") != F.col("part_h"))
        near = near.filter(possible("m", "h")) if possible else near
        pairs = near.groupBy(F.col("cid_m").alias("b"), F.col("cid_h").alias("a")).agg(F.sum("times").alias("times")).groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
        links = links.union(verify(pairs.select("a", "b"), f"hub_{step}"))
        parts = connected_components(space, links, f"parts_{step}")
        labelled = space.save(_labelled(rows if step == 1 else open_rows.drop("part"), parts), f"labelled_{step}")
        mixed = space.save(labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("key", "members"), f"mixed_{step}")
        left = mixed.agg(F.sum("members")).first()[0] or 0
        open_rows = space.save(join_bounded(labelled, mixed.select("key"), "key", "left_semi", KEYS_TO_BROADCAST), f"rows_{step}")
        space.drop(f"rows_{step - 1}", f"labelled_{step}", f"mixed_{step}", f"hubs_{step}")
        if not left or (before is not None and left > 0.8 * before):
            break
        before = left
    if left:
        if across is not None:
            near = space.save(across(open_rows.select("key", "cid", "part")), "near")
            pairs = near.select("a", "b")
            best = near.groupBy("one", "two").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b")
            best = space.save(best, "best")
            if 2 * best.count() < near.count():
                links = links.union(verify(best.distinct(), "best"))
                parts = connected_components(space, links, "parts_best")
                of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
                left = near.join(of("a"), "a", "left").join(of("b"), "b", "left")
                pairs = left.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
        else:
            one, two = (open_rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "room", "part")]) for x in "ab")
            pairs = one.join(two, "key").filter(F.col("part_a") < F.col("part_b")).filter(possible("a", "b")).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
        links = links.union(verify(pairs.distinct(), "across"))
        parts = connected_components(space, links, "parts")
    space.drop(f"rows_{step}")
    return parts


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, rows["cid"] == parts["node"], "left").withColumn("part", F.coalesce("component", "cid")).drop("node", "component")

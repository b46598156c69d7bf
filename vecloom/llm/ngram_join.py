"""Jaccard self-join on word n-grams: size-aware, heavy and light.

A document is its set of distinct n-grams (64-bit hashes); equal sets are one
class. An n-gram that only one class has is private. A class with more private
n-grams than a similar set may differ by has no link and is done with: first by
the n-grams of lowest hash, counted for every document, then by all n-grams of
the classes left. Most documents go here, at the price of one count.

What is left is joined on prefixes under one order of n-grams, rare before
common: two sets similar enough share an n-gram within their prefixes, and two
n-grams within prefixes longer by one. Light sets (few n-grams) enumerate the
2-subsets of their prefix as keys; heavy ones are put into the inverted lists of
their prefix. Which size parts the two follows from the costs of both for sets
of each size. Sets next to the boundary do both, so no pair across it is lost.
A key carries how much the sets can still share from there on (room): pairs are
made only where that is enough.

Candidates are verified on the whole sets and joined by union-find, first with
hubs, then in pairs across components; see ``linked_components``.

A class is told by 128 bits: a 64-bit hash, and another that sets apart those
that agree in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, clashes, join_bounded, settled
from vecloom.llm.components import linked_components
from vecloom.llm.spans import NO_SPACE, hash_spans, lowered, mix, shingle_hashes, text_slices, word_spans

#: Rows of one 64-bit number up to which a table is sent to all tasks: under 64 MB.
REPS_TO_BROADCAST = 500_000
#: Sets that may differ in more n-grams than this are always heavy: 2-subsets would be too many.
LIGHT_SLACK = 64
#: Cost of one comparison, in keys written.
COMPARISON = 4.0
#: Share of a list of single n-grams that is left in one of 2-subsets.
PAIRED_SHARE = 0.25

_U = np.uint64


def need(size: int, percent: int) -> int:
    """The least overlap with any similar set."""
    return -(-percent * size // 100)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text."""
    for i, j, data, ends in text_slices(column):
        low = lowered(data)
        start, stop, doc = word_spans(low, ends, NO_SPACE)
        h, at = shingle_hashes(hash_spans(low, start, stop), doc, j - i, n)
        if len(at) and (np.diff(at) < 0).any():
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        cuts = np.searchsorted(at, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(h[cuts[k] : cuts[k + 1]])


def _class_of(grams: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits of a set: its class, of which the leading ``bits`` are used, and a check."""
    size = _U(len(grams))
    total = np.add.reduce(mix(grams), dtype=np.uint64)
    other = np.bitwise_xor.reduce(mix(grams * _U(0xD6E8FEB86659FD93)))
    cid, check = mix(np.array([total ^ mix(np.array([size]))[0], other + size]))
    return int((cid >> _U(64 - bits)).astype(np.int64)), int(check.astype(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)))


def _documents(n: int, share: float, bits: int):
    """Size and class of each text, and its n-grams of the lowest ``share`` of hashes."""
    limit = _U(min(2**64 - 1, int(share * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, checks, low = [], [], [], []
            for _, grams in _sets(batch.column(2), n):
                cid, check = _class_of(grams, bits) if len(grams) else (None, None)
                sizes.append(len(grams))
                classes.append(cid)
                checks.append(check)
                low.append(grams[: np.searchsorted(grams, limit, side="right")])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), _lists(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_crc32", "n", "cid", "check", "low"])

    return run


def _whole_sets(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams for _, grams in _sets(batch.column(0), n) if len(grams)]
            for k in range(0, len(found), 500):
                part = found[k : k + 500]
                ids = [_class_of(g, bits) for g in part]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in ids], pa.int64()), pa.array([c for _, c in ids], pa.int64()), _lists(part)], names=["cid", "check", "grams"])

    return run


def _few(percent: int) -> int:
    """The largest size that a similar set may share only one n-gram with; such sets cannot meet on 2-subsets."""
    return 100 // percent


def _is_light(size, percent: int, boundary: int):
    return (size <= boundary) & (size > _few(percent))


def _is_listed(size, percent: int, boundary: int):
    """Heavy sets, and light ones that a heavy one can be similar to."""
    return (size > boundary) | (size <= _few(percent)) | (100 * size >= percent * (boundary + 1)) | (percent * size <= 100 * _few(percent))


def _keys(percent: int, boundary: int):
    """From cid, n, grams (those shared with other classes, rarest first): key, cid, n, room, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                keys, rooms, rows = [], [], []
                part = batch.slice(k, 256)
                sizes, lists = part.column(1).to_pylist(), part.column(2)
                ranks = []
                for i, size in enumerate(sizes):
                    grams = lists[i].values.to_numpy().astype(np.uint64)
                    private, lax = size - len(grams), size - need(size, percent)
                    ranks.append((len(grams) - need(size, percent)) * 1_000_000 // size)
                    own, room = [], []
                    if _is_listed(size, percent, boundary) and lax + 1 > private:
                        own.append(mix(grams[: lax + 1 - private] ^ _U(0xA5A5A5A5)))
                        room.append(size - private - np.arange(len(own[-1])))
                    if _is_light(size, percent, boundary) and lax + 2 > private:
                        a, b = np.triu_indices(min(len(grams), lax + 2 - private), 1)
                        first, second = np.minimum(grams[a], grams[b]), np.maximum(grams[a], grams[b])
                        own.append(mix(mix(first) * _U(0x9E3779B97F4A7C15) ^ second))
                        room.append(size - private - b + 1)
                    keys += own
                    rooms += room
                    rows.append(sum(map(len, own)))
                if not sum(rows):
                    continue
                spread = lambda x: pa.array(np.repeat(np.array(x, np.int64), rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), spread(part.column(0).to_pylist()), spread(sizes), pa.array(np.concatenate(rooms).astype(np.int64)), spread(ranks)], names=["key", "cid", "n", "room", "rank"])

    return run


def choose_boundary(costs: list[tuple[int, float, float]], percent: int) -> int:
    """The size up to which sets enumerate 2-subsets, by the least cost; ``costs`` has for each size that of lists and that of subsets."""
    best, at = None, 0
    for b in [0, *sorted(n for n, _, _ in costs)]:
        cost = sum((light if _is_light(n, percent, b) else 0) + (heavy if _is_listed(n, percent, b) else 0) for n, heavy, light in costs)
        if best is None or cost < best:
            best, at = cost, b
    return at


def similar_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, class_bits: int = 64) -> DataFrame:
    """Groups of documents whose sets of ``words``-grams have a Jaccard similarity of ``percent`` / 100 or more, closed over links.

    Returns id, text_crc32, n_shingles, component_id (the least id reachable by
    links, itself included) for every row. ``percent`` is from 1 to 100.

    - Null texts, empty ones and ones of white space have no n-grams, are linked
      with nothing, not even each other, and are their own component.
    - Texts with fewer words than ``words`` have one n-gram, the whole sequence.
    - Repeated rows and equal texts are linked (similarity 1). A null id never
      names a component unless all its members' ids are null.
    - Texts are used whole, however long. An empty table gives an empty result.
    - Other columns are ignored, whatever their names.
    - Fewer ``class_bits`` make classes clash more often, which changes nothing but the work.
    """
    space = Workspace(df.sparkSession, "ngrams")
    rows = df.select(F.col(id_col).alias("id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    share = min(1.0, 1.5 * (1 - percent / 100) + 0.02)
    docs = space.save(rows.mapInArrow(_documents(words, share, class_bits), f"id {id_type}, text_crc32 long, n long, cid long, check long, low array<long>"), "docs")
    apart = clashes(docs.filter("n > 0"))
    docs = settled(docs, apart)

    rep = F.struct(F.col("id").isNull().alias("none"), "id", "text_crc32")
    classes = space.save(docs.filter("n > 0").groupBy("cid").agg(F.min(rep).alias("rep"), F.max("n").alias("n")), "classes")
    slack = F.expr(f"n - ({percent} * n + 99) div 100")
    alone = _private(docs.filter("n > 0").select("cid", F.explode("low").alias("gram")))
    left = classes.join(alone, "cid", "left").filter(F.coalesce("private", F.lit(0)) <= slack)
    left = space.save(left.select("cid", "n", F.xxhash64("rep.id", "rep.text_crc32").alias("at")), "left")

    # the sets of classes that are left, of one of their documents; which one it is does not matter
    chosen = join_bounded(rows.withColumn("at", F.xxhash64("id", "text_crc32")), left.select("at").distinct(), "at", "left_semi", REPS_TO_BROADCAST)
    sets = settled(chosen.select("text").mapInArrow(_whole_sets(words, class_bits), "cid long, check long, grams array<long>"), apart)
    sets = join_bounded(sets, left.select("cid"), "cid", "left_semi", REPS_TO_BROADCAST).groupBy("cid").agg(F.first("grams").alias("grams"))
    sets = space.save(sets.select("cid", F.size("grams").cast("long").alias("n"), "grams"), "sets")
    space.drop("left")
    alone = _private(sets.select("cid", F.explode("grams").alias("gram")))
    few = space.save(sets.join(alone, "cid", "left").filter(F.coalesce("private", F.lit(0)) <= slack).select("cid", "n", "grams"), "few")
    space.drop("sets")
    entries = few.select("cid", "n", F.explode("grams").alias("gram"))
    counts = space.save(entries.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    ordered = entries.join(counts, "gram").groupBy("cid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("x"))
    own = F.greatest(slack - (F.col("n") - F.size("x")), F.lit(-1))  # more than one shared n-gram in the prefix
    subsets, met = F.least(own + 2, F.size("x")), F.aggregate(F.slice("x", 1, F.least(own + 1, F.size("x")).cast("int")), F.lit(0.0), lambda s, e: s + e["df"] - 1)
    heavy = own + 1 + COMPARISON * met
    light = subsets * (subsets - 1) / 2 + COMPARISON * PAIRED_SHARE * (subsets - 1) / 2 * met
    ordered = ordered.select("cid", "n", F.transform("x", lambda e: e["gram"]).alias("grams"), heavy.alias("heavy"), light.alias("light"), slack.alias("slack"))
    ordered = space.save(ordered.filter(F.size("grams") >= F.col("n") - F.col("slack")), "ordered")
    space.drop("few", "counts")
    # sizes with so little slack are few, whatever the table's
    costs = [tuple(r) for r in ordered.filter(F.col("slack") < LIGHT_SLACK).groupBy("n").agg(F.sum("heavy"), F.sum("light")).collect()]
    boundary = choose_boundary(costs, percent)

    keys = ordered.select("cid", "n", "grams").mapInArrow(_keys(percent, boundary), "key long, cid long, n long, room long, rank long")
    keys = space.save(keys, "keys")

    def possible(a: str, b: str) -> Column:
        return (100 + percent) * F.least(f"room_{a}", f"room_{b}") >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))

    def verify(pairs: DataFrame, label: str) -> DataFrame:
        of = lambda x: ordered.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}"))
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        linked = pairs.join(of("a"), "a").join(of("b"), "b").filter((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))
        return space.save(linked.select("a", "b"), f"links_{label}")

    parts = linked_components(space, keys, lambda _: verify, possible)

    named = classes.select("cid", "rep").join(parts, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("component", "cid").alias("part"))
    least = space.save(named.groupBy("part").agg(F.min("rep").alias("least")), "least")
    names = space.save(named.join(least, "part").select("cid", F.col("least.id").alias("component_id")), "names")
    result = docs.select("id", "text_crc32", "n", "cid").join(names, "cid", "left")
    result = result.select(F.col("id").alias(id_col), "text_crc32", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    result = space.save(result, "result")
    space.keep("result")
    return result


def _private(grams: DataFrame) -> DataFrame:
    """From cid, gram: cid, private (how many n-grams it shares with no other class)."""
    seen = grams.groupBy("gram").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    return seen.filter("lo = hi").groupBy(F.col("lo").alias("cid")).agg(F.count("*").alias("private"))

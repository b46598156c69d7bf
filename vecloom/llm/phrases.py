"""Benchmark decontamination by a distributed positional inverted index.

Training texts are tokenised once into a stored table. The corpus frequency of
every benchmark term is counted, and each window of benchmark words is anchored
at the rarest of its terms that occur; one with fewer than ``near`` such terms is out. The index stores the postings of anchor terms: document,
position, and the tokens around it as far as a window can reach. Probing joins
windows with the postings of their anchor; the offset-adjusted comparison with
the window's other terms, rarest first by choice of the anchor, is local to the
posting, because the neighbouring tokens are stored in it. So common terms need
no lists of their own, and the join gives one row per posting, not one per
window and posting. All of it is DataFrame operations.

A proximity match is an anchor with at least ``near`` of the window's distinct
words within reach of a window, without being an exact match. A passage in which
just the anchor itself was replaced is not one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, join_bounded

#: What stands between words, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
TERMS_TO_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Words of letters and figures, those beyond ASCII included; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (words) with the ids of the items that have them; a shorter item is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def find_phrases(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near: int = 8
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Returns id, row_key, n_words, n_hit (words inside any occurrence of a window),
    items (ids, as sorted strings, of items with occurring windows), near_items
    (of those with proximity matches only), one row per document.

    - Null and empty texts have no words; items without words have no windows.
    - Repeated rows, equal texts and null ids each get their own full answer.
    - Texts are used whole, however long. Empty tables give empty or hitless
      results. Other columns are ignored, whatever their names.
    """
    space = Workspace(docs.sparkSession, "phrases")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), words_of(F.col(text_col)).alias("words"))
    store = space.save(source.withColumn("n_words", F.size("words").cast("long")), "tokens")
    windows = space.save(windows_of(items, item_col, item_text_col, window), "windows")

    terms = space.save(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counted = join_bounded(store.select(F.explode("words").alias("term")), terms, "term", "left_semi", TERMS_TO_BROADCAST).groupBy("term").count()
    counted = space.save(counted, "frequencies")
    placed = windows.select("words", "items", F.posexplode("words").alias("offset", "term")).join(counted, "term")
    rarest = F.min(F.struct("count", "offset", "term")).alias("rarest")
    anchored = placed.groupBy("words").agg(rarest, F.first("items").alias("items"), F.count_distinct("term").alias("present"))
    anchored = anchored.filter(F.col("present") >= F.least(F.lit(near), F.size(F.array_distinct("words"))))
    anchors = anchored.groupBy(F.col("rarest.term").alias("term")).agg(F.collect_list(F.struct("words", "items", F.col("rarest.offset").alias("offset"))).alias("windows"))
    anchors = space.save(anchors, "anchors")

    reach = window - 1
    at = store.select("row_key", "words", F.posexplode("words").alias("pos", "term"))
    before = F.least(F.col("pos"), F.lit(reach))
    postings = join_bounded(at, anchors.select("term"), "term", "left_semi", TERMS_TO_BROADCAST).select(
        "term", "row_key", "pos", before.alias("before"), F.slice("words", F.col("pos") - before + 1, before + window).alias("around")
    )
    postings = space.save(postings, "postings")

    probed = join_bounded(postings, anchors, "term", "inner", TERMS_TO_BROADCAST)
    fits = lambda w: (w["offset"] <= F.col("before")) & (F.slice("around", F.greatest(F.col("before") - w["offset"] + 1, F.lit(1)), F.size(w["words"])) == w["words"])
    close = lambda w: F.size(F.array_intersect(w["words"], "around")) >= F.least(F.lit(near), F.size(F.array_distinct(w["words"])))
    matched = probed.withColumn("exact", F.filter("windows", fits)).withColumn("close", F.filter("windows", close)).filter("size(close) > 0").select(
        "row_key",
        F.transform("exact", lambda w: F.struct((F.col("pos") - w["offset"]).alias("start"), F.size(w["words"]).alias("n"))).alias("spans"),
        F.flatten(F.transform("exact", lambda w: w["items"])).alias("items"),
        F.flatten(F.transform("close", lambda w: w["items"])).alias("close_items"),
    )
    gathered = matched.groupBy("row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("close_items"))).alias("close_items")
    )
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    hits = space.save(
        gathered.select("row_key", F.size(inside).cast("long").alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort(F.array_except("close_items", "items")).alias("near_items")), "hits"
    )
    space.drop("postings", "windows", "terms", "frequencies", "anchors")
    none = F.array().cast("array<string>")
    return store.select("id", "row_key", "n_words").join(hits, "row_key", "left").select(
        F.col("id").alias(id_col), "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )

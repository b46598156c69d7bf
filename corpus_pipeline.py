"""A corpus pipeline in five stages, each of which works on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import mixing, ngram_join, phrases, sharding, toxicity
from vecloom.llm.common import Workspace, join_bounded, table

#: Rows of a decision table up to which it is sent to the documents instead of moving them.
DECISIONS_TO_BROADCAST = 1_000_000


def _crc(text: str = "text"):
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay. The model learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.keep_below(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; documents without words all stay."""
    space = Workspace(spark, "near")
    # ids may be null or shared: id and text together name a document, and the least of a group names only that group
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), text.alias("text")).alias("_vl_doc"), "text")
    groups = space.save(ngram_join.similar_groups(keyed, id_col="_vl_doc", words=5, percent=80).filter("n_shingles > 0").select("_vl_doc.*", F.col("component_id").alias("best")), "groups")
    other = ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text") == F.col("best.text")))
    gone = space.save(groups.filter(other).select(F.col("id").alias("_vl_id"), F.col("text").alias("_vl_text")).distinct(), "gone")
    left = join_bounded(docs, gone, docs["doc_id"].eqNullSafe(gone["_vl_id"]) & (text == gone["_vl_text"]), "left_anti", DECISIONS_TO_BROADCAST)
    # rows alike in id and text are one group: all but one go
    repeats = groups.groupBy("id", "text").agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.limit(1).count():
        repeats = space.save(repeats.select(F.col("id").alias("_vl_id"), F.col("text").alias("_vl_text")), "repeats")
        same = left["doc_id"].eqNullSafe(repeats["_vl_id"]) & (text == repeats["_vl_text"])
        once = join_bounded(left, repeats, same, "left_semi", DECISIONS_TO_BROADCAST).withColumn("_vl_key", text)
        left = join_bounded(left, repeats, same, "left_anti", DECISIONS_TO_BROADCAST).unionByName(once.dropDuplicates(["doc_id", "_vl_key"]).drop("_vl_key"))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any occurrence of ten benchmark words in a row go."""
    space = Workspace(spark, "leaks")
    found = phrases.find_phrases(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = space.save(found.filter("n_hit > 0").select(F.col("row_key").alias("_vl_row_key")).distinct(), "hit")
    return join_bounded(docs, hit, F.xxhash64("doc_id", "text") == hit["_vl_row_key"], "left_anti", DECISIONS_TO_BROADCAST).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or more."""
    space = Workspace(spark, "mixed")
    taken = mixing.mix_sources(docs).filter("copies > 0")
    names = {"doc_id": "_vl_id", "source": "_vl_source", "text_crc32": "_vl_crc", "size": "_vl_size"}
    # rows alike in all these are alike in how they may be taken: their copies add up on one of them
    copies = taken.groupBy(*names).agg(F.sum("copies").alias("_vl_copies"), F.count("*").alias("_vl_rows"))
    copies = space.save(copies.withColumnsRenamed(names), "copies")
    same = docs["doc_id"].eqNullSafe(copies["_vl_id"]) & docs["source"].eqNullSafe(copies["_vl_source"]) & (_crc() == copies["_vl_crc"])
    alike = copies.filter("_vl_rows > 1").limit(1).count()
    joined = join_bounded(docs.dropDuplicates(["doc_id", "source", "text"]) if alike else docs, copies, same, "inner", DECISIONS_TO_BROADCAST)
    return joined.withColumn("_vl_copy", F.explode(F.sequence(F.lit(1), F.col("_vl_copies").cast("int")))).select(*[docs[c] for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard (0 to 15) and slot, uniformly shuffled into shards of equal counts."""
    return sharding.shuffle_into_shards(docs, [F.col("doc_id"), F.col("source"), _crc()], n_shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: A fitted classifier, a random mix and a random shuffle are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, applied to ``documents``."""
    space = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return docs

import collections

import corpus_pipeline
from vecloom.llm.common import Workspace

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, space, counts = docs.columns, Workspace(spark, "test"), [docs.count()]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = space.save(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        assert docs.columns == columns + (["shard", "slot"] if i == 4 else [])
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    sizes = collections.Counter(r.shard for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 0), (3, "one two three four five six", "en", "a", 0), (4, "one two three four five six", None, "b", None), (None, "x y", "en", "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
        some = docs.count() > 0
        assert sorted(map(str, (r.doc_id for r in near.collect()))) == (sorted(["1", "2", "2", "3", "None"]) if some else [])
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated, corpus_pipeline.mix, corpus_pipeline.shard):
            assert stage(spark, docs, DATA).count() <= 2 * len(rows)


def test_unrelated_texts_without_id_or_with_one_id_stay(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(None, texts[0]), (7, texts[4]), (8, texts[4]), (9, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted((str(i), t) for i, t in rows[:8])

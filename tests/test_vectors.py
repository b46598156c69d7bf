import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import codec, vectors
from vecloom.operators import graph, knn, pq
from vecloom.plans import operators
from vecloom.plans.options import OptionError, SearchSettings, auto_pq_m, validate
from vecloom.sources import files
from vecloom.sources.catalog import Catalog


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (vectors.l2_distance, math.sqrt(27)),
        (vectors.l2_squared_distance, 27),
        (vectors.inner_product, 32),
        (vectors.negative_inner_product, -32),
        (vectors.cosine_distance, 1 - 32 / math.sqrt(14 * 77)),
    ],
)
def test_distances(spark, f, want):
    assert value(spark, f(vec(1, 2, 3), vec(4, 5, 6))) == pytest.approx(want, abs=1e-6)
    assert value(spark, f(vec(1, 2, 3), F.lit(None).cast("array<double>"))) is None
    with pytest.raises(Exception, match="different vector dimensions"):
        value(spark, f(vec(1, 2, 3), vec(1, 2)))


def test_zero_vector_has_cosine_distance_one(spark):
    assert value(spark, vectors.cosine_distance(vec(0, 0), vec(1, 2))) == 1.0
    assert value(spark, vectors.l2_normalize(vec(0, 0))) == [0.0, 0.0]


def test_comparison_is_lexicographic_then_shorter_first(spark):
    got = [value(spark, vectors.vector_cmp(a, b)) for a, b in ((vec(1, 2), vec(1, 3)), (vec(1, 2), vec(1, 2)), (vec(2), vec(1, 9)), (vec(1), vec(1, 0)))]
    assert got == [-1, 0, 1, -1]


@pytest.mark.parametrize("bad", [(1, float("nan")), (1, float("inf")), (1, 2, 3)])
def test_cast_refuses(spark, bad):
    with pytest.raises(Exception, match="vector"):
        value(spark, vectors.to_vector(vec(*bad), 2))


@pytest.mark.parametrize("text", ["1,2", "[]", "[1,,2]", "[1,2", "[a]", "[1 2]", "[nan]", "[1e99]"])
def test_text_is_strict(text):
    with pytest.raises(ValueError):
        codec.parse_text(text)


def test_codecs():
    assert codec.parse_text(" [ 1, 2.5 ,-3e1] ") == [1.0, 2.5, -30.0]
    assert codec.vector_from_wire(codec.vector_to_wire([1.5, -2.0])) == [1.5, -2.0]
    assert codec.json_to_vector("[1, 2]") == [1.0, 2.0]
    with pytest.raises(ValueError):
        codec.json_to_vector("[true]")


def test_operators_are_rewritten(spark):
    assert "'a <-> b'" in operators.rewrite("SELECT 'a <-> b'")
    got = spark.sql(operators.rewrite("SELECT array(1.0D, 2.0D) <-> array(4.0D, 6.0D) AS d ORDER BY l2_distance(array(1.0D), array(2.0D))")).first()[0]
    assert got == 5.0


@pytest.mark.parametrize("options", [{"m": 1}, {"m": 200}, {"metric": "hamming"}, {"threads": 0}, {"pq_m": 3}, {"what": 1}, {"quantizer": "pq", "pq_m": 5}, {"m": 2.5}, {"m": True}])
def test_options_are_refused(options):
    with pytest.raises(OptionError):
        validate(8, **options)


def test_options_and_settings():
    assert auto_pq_m(64) == 16
    assert validate(8, memory_mode="compact").quantizer == "pq"
    assert SearchSettings(ef_search=40).effective_ef(50) == 100
    with pytest.raises(OptionError):
        validate(8, profile="row", m=50, ef_construction=64)
    with pytest.raises(OptionError):
        SearchSettings(ef_search=0)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(300, None, 0), (301, x[0].tolist(), 1)]
    return spark.createDataFrame(rows, "id long, vec array<float>, label int"), x


def nearest(x, q, k):
    return np.lexsort((np.arange(len(x)), np.linalg.norm(x.astype(float) - q, axis=1)))[:k].tolist()


def test_knn_ties_nulls_filter_offset(items):
    df, x = items
    got = [r["id"] for r in knn.knn(df, x[0].tolist(), 4).collect()]
    assert got[:2] == [0, 301]
    assert [r["id"] for r in knn.knn(df, x[0].tolist(), 2, offset=2).collect()] == got[2:]
    assert knn.knn(df, x[0].tolist(), 1000).count() == 301
    assert {r["label"] for r in knn.knn(df, x[0].tolist(), 5, where=F.col("label") == 2).collect()} == {2}


def test_knn_join_is_exact(items):
    df, x = items
    base = df.filter("id < 300")
    ask = base.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    got = {}
    for r in knn.knn_join(base, ask, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: nearest(x, x[q].astype(float), 5) for q in range(0, 300, 50)}


def test_graph_recall_and_duplicates(items):
    df, x = items
    built = graph.build(df, validate(8, m=8, ef_construction=64), rows_per_shard=150).cache()
    hits = 0
    for q in range(0, 100, 10):
        got = [r["id"] for r in graph.search(built, x[q].tolist(), 10, 64).collect()]
        hits += len({0 if g == 301 else g for g in got} & set(nearest(x, x[q].astype(float), 10)))
    assert hits >= 90
    assert {r["id"] for r in graph.search(built, x[0].tolist(), 2, 40).collect()} == {0, 301}
    assert 0 not in {r["id"] for r in graph.search(built, x[0].tolist(), 5, 40, deleted={0}).collect()}


def unlike_lengths(n, dims):
    """Vectors of lengths 1 to 10 in all directions: the short ones are near to all others."""
    x = np.random.default_rng(5).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None] * (1 + np.arange(n)[:, None] % 10)


def test_graph_recall_where_some_are_near_to_all():
    x = unlike_lengths(1200, 48)
    g, odd = graph.Graph(x, "l2", 8, 32), np.arange(1200) % 2 == 1
    for allowed in (None, odd):
        hits = 0
        for q in range(0, 1200, 20):
            far = np.linalg.norm(x - x[q], axis=1)
            exact = np.argsort(far if allowed is None else np.where(odd, far, np.inf))[:10]
            hits += len({n for _, n in g.search(x[q], 10, 40, None if allowed is None else odd.tolist())} & set(exact.tolist()))
        assert hits >= 0.95 * 600


def test_checked_search_of_a_changed_index_is_exact(spark, tmp_path):
    x = unlike_lengths(300, 48).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("i", df, table="t", m=2, ef_construction=4)
    c.insert("i", spark.createDataFrame([(1000 + i, x[i].tolist()) for i in range(5)], "id long, vec array<float>"))
    c.delete("i", {3, 1004})
    live, walked = c.rows("i"), SearchSettings(ef_search=1, brute_force_threshold=0, exact_check=True)
    assert c.plan(live, metric="l2", table="t", vector_col="vec", settings=walked)[0] == "graph"
    for q in (0, 3, 109):
        got = [tuple(r) for r in c.topk(live, x[q].tolist(), 10, table="t", settings=walked).collect()]
        assert got == [tuple(r) for r in knn.knn(live, x[q].tolist(), 10).select("id", "dist").collect()]
    assert c.topk(live, x[0].tolist(), 400, table="t", settings=walked).count() == 303  # 300 and 5, less 2


def test_graph_join_equals_single_searches(items, monkeypatch):
    monkeypatch.setattr(graph, "QUERY_BLOCK", 2)
    df, _ = items
    built = graph.build(df, validate(8, m=8, ef_construction=64), rows_per_shard=150).cache()
    ask = df.filter("id in (0, 40, 80)").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in graph.search_join(built, ask, 4, 40).collect()}
    for row in ask.collect():
        single = [r["id"] for r in graph.search(built, row["query_vec"], 4, 40).collect()]
        assert [got[row["query_id"], k] for k in range(1, 5)] == single


def test_graph_recall_is_measured_for_each_hundredth_row(spark):
    from vecloom.queries import index_graph_recall

    d = "/root/testdata/sf0.01"
    want = {r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 100 = 0").select("vec_id").collect()}
    got = {r["query_id"]: r["recall"] for r in index_graph_recall(spark, d).collect()}
    assert set(got) == want and sum(got.values()) >= 0.9 * len(want)


def test_pq_refined_is_near_exact(items):
    df, x = items
    book = pq.train(df, 4)
    codes = pq.encode(df, book)
    assert codes.count() == 301
    got = [r["id"] for r in pq.search(codes, book, x[5].tolist(), 5, refine=df, factor=20).collect()]
    assert set(got) == set(nearest(x, x[5].astype(float), 5))


def test_pq_refined_exactly_needs_no_wide_factor(items):
    df, x = items
    book = pq.train(df, 1)
    for q in range(0, 300, 60):
        got = [r["id"] for r in pq.search(pq.encode(df, book), book, x[q].tolist(), 5, refine=df, exact=True).collect()]
        assert got == [r["id"] for r in knn.knn(df, x[q].tolist(), 5).collect()]


def test_catalog_life(spark, items, tmp_path):
    df, x = items
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("i", df, table="t", m=8, ef_construction=32)
    fresh = SearchSettings(brute_force_threshold=0)
    assert c.explain(df, 3, metric="l2", table="t", vector_col="vec", settings=fresh).endswith("graph")
    assert c.explain(df, 3, metric="ip", table="t", vector_col="vec", settings=fresh).endswith("exact")
    c.insert("i", spark.createDataFrame([(900, x[1].tolist())], "id long, vec array<float>"))
    assert c.rows("i").count() == 302
    with pytest.raises(OptionError):
        c.insert("i", spark.createDataFrame([(901, [1.0])], "id long, vec array<float>"))
    c.delete("i", {900})
    assert c.rows("i").count() == 301
    assert c.delete("i", set(range(100))).rows == 201
    assert c.info().first()["n_rows"] == 201
    assert c.inspect("i").count() == 7
    c.drop_table("t")
    assert c.info().count() == 0


def test_csv_round_trip(spark, items, tmp_path):
    df, _ = items
    path = f"file://{tmp_path}/csv"
    files.write_csv(df, path)
    assert sorted(map(str, files.read_csv(spark, path, "id long, vec string, label int").collect())) == sorted(map(str, df.collect()))


def test_compaction_keeps_options(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), float(i % 7), 1.0, 0.0]) for i in range(300)], "id long, vec array<float>")
    c = Catalog(spark, f"file://{tmp_path}")
    for name, options in {"codes": {"quantizer": "pq", "pq_m": 2, "metric": "cosine"}, "small": {"profile": "embedded", "m": 8}}.items():
        made = c.create(name, rows, table=name, **options)
        again = c.delete(name, set(range(100)))
        assert again.options == made.options and again.path != made.path and again.rows == 200 and not again.deleted
        assert not os.path.exists(made.path.removeprefix("file://")) and os.path.exists(again.path.removeprefix("file://"))
    c.create("packed", rows, table="packed", memory_mode="compact")
    assert len(c.delete("packed", set(range(100))).deleted) == 100
    with pytest.raises(OptionError):
        c.compact("packed")


def test_changed_index_is_searched_by_graph(spark, items, tmp_path):
    df, x = items
    df = df.filter("id < 300")
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("i", df, table="t", m=8, ef_construction=64)
    c.insert("i", spark.createDataFrame([(900, x[1].tolist()), (901, x[2].tolist())], "id long, vec array<float>"))
    c.delete("i", {1, 901})
    live, by_graph = c.rows("i"), SearchSettings(ef_search=100, brute_force_threshold=0, filtered_search="graph")
    assert c.plan(live, metric="l2", table="t", vector_col="vec", settings=by_graph)[0] == "graph"
    assert c.plan(df, metric="l2", table="t", vector_col="vec", settings=by_graph)[0] == "exact"
    for q in (x[1], x[2], x[50]):
        got = {r["id"] for r in c.topk(live, q.tolist(), 10, table="t", settings=by_graph).collect()}
        want = {r["id"] for r in knn.knn(live, q.tolist(), 10).collect()}
        assert len(got & want) >= 9 and not got & {1, 901}
    assert c.topk(live, x[1].tolist(), 1, table="t", settings=by_graph).first()["id"] == 900
    few = F.col("id") % 20 == 7
    got = [r["id"] for r in c.topk(live, x[1].tolist(), 5, table="t", where=few, settings=by_graph).collect()]
    assert got == [r["id"] for r in knn.knn(live, x[1].tolist(), 5, where=few).collect()]
    again = Catalog(spark, f"file://{tmp_path}").open()
    assert again.indexes == c.indexes
    c.insert("i", spark.createDataFrame([(1, x[1].tolist())], "id long, vec array<float>"))  # comes back after its deletion
    assert c.rows("i").filter("id = 1").count() == 1 and not c.indexes["i"].deleted


def test_codes_of_a_changed_index_after_reopening(spark, items, tmp_path):
    df, x = items
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("i", df, table="t", quantizer="pq", pq_m=8)
    c.insert("i", spark.createDataFrame([(900, x[5].tolist())], "id long, vec array<float>"))
    c.delete("i", {5})
    codes = SearchSettings(brute_force_threshold=0, pq_search_mode="pq_only", pq_refine_k_factor=5.0)
    again = Catalog(spark, f"file://{tmp_path}").open()
    live = again.rows("i")
    assert again.plan(live, metric="l2", table="t", vector_col="vec", settings=codes)[0] == "pq"
    assert again.topk(live, x[5].tolist(), 1, table="t", settings=codes).first()["id"] == 900


@pytest.mark.parametrize("text", ["SELECT 'a <-> b'", 'SELECT 1 AS "a <-> b"', "SELECT 1 AS `a <-> b`", "SELECT 1 -- it's a <-> b\n", "SELECT /* a <-> b */ 1", r"SELECT 'it\'s a <-> b'"])
def test_operators_in_quotes_and_comments_stay(text):
    from vecloom.plans.operators import rewrite

    assert rewrite(text) == text
    assert "<->" not in rewrite("SELECT 1, a <-> b -- it's\n")

"""Vector indexes as directories of Parquet: base graph, delta of inserts, tombstones, a one-row manifest.

Every change writes new files and then a new manifest version, so readers see
one snapshot, and a new session can open what an older one made. A changed index
is searched as base graph less tombstones, plus the delta, which is searched
exactly. A table that does not match the fingerprint of the index's live rows is
searched exactly as a whole.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import graph, pq
from vecloom.operators.knn import checked, knn, metric_of
from vecloom.plans.options import IndexOptions, OptionError, SearchSettings, validate

#: Share of deleted rows from which on an index is rebuilt.
COMPACT_AT = 0.2


def fingerprint(df: DataFrame, id_col: str, vector_col: str) -> list[int]:
    """Count, greatest id, checksums of ids and of vectors, of rows that have a vector."""
    rows = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    got = rows.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("id")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("id", "vec")), F.lit(0))).first()
    return [int(x) for x in got]


def _joined(a: list[int], b: list[int]) -> list[int]:
    """Fingerprint of the rows of both."""
    return [a[0] + b[0], max(a[1], b[1]), a[2] ^ b[2], a[3] ^ b[3]]


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    id_col: str
    vector_col: str
    dims: int
    options: IndexOptions
    path: str
    rows: int
    mark: list[int]
    version: int = 1
    deleted: frozenset[int] = field(default_factory=frozenset)
    inserted: int = 0
    state: str = "ready"


class Catalog:
    """Indexes of a session, kept under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.indexes = spark, folder.rstrip("/"), {}

    def open(self) -> Catalog:
        """Take up all indexes of the folder that have a complete manifest, each at its latest version."""
        for path in self._children(self.folder):
            versions = [int(p.rsplit("-", 1)[1]) for p in self._children(path) if p.rsplit("/", 1)[1].startswith("manifest-") and self._exists(f"{p}/_SUCCESS")]
            if versions:
                kept = json.loads(self.spark.read.parquet(f"{path}/manifest-{max(versions)}").first()["manifest"])
                options = IndexOptions(**kept.pop("options"))
                index = Index(**kept | {"options": options, "deleted": frozenset(kept["deleted"])})
                self.indexes[index.name] = index
        return self

    def _fs(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), made

    def _exists(self, path: str) -> bool:
        fs, made = self._fs(path)
        return fs.exists(made)

    def _children(self, path: str) -> list[str]:
        fs, made = self._fs(path)
        return [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(made)] if fs.exists(made) else []

    def create(self, name: str, df: DataFrame, *, table: str, id_col: str = "id", vector_col: str = "vec", profile: str = "columnar", **options) -> Index:
        if name in self.indexes:
            raise OptionError(f"index {name!r} exists")
        dims = [r[0] for r in df.filter(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("n")).distinct().limit(2).collect()]
        if len(dims) > 1:
            raise OptionError("all vectors of an index need the same dimensions")
        checked = validate(dims[0] if dims else 1, profile, **options)
        return self._put(self._build(name, df, table, id_col, vector_col, dims[0] if dims else 0, checked))

    def _build(self, name: str, df: DataFrame, table: str, id_col: str, vector_col: str, dims: int, checked: IndexOptions) -> Index:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        index = Index(name, table, id_col, vector_col, dims, checked, path, df.filter(F.col(vector_col).isNotNull()).count(), fingerprint(df, id_col, vector_col))
        rows = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
        if checked.quantizer == "pq" and index.rows:
            book = pq.train(rows, checked.pq_m, metric=checked.metric)
            self._books[path] = book
            stored = (book.metric, list(book.centroids.shape), np.ascontiguousarray(book.centroids, dtype="<f8").tobytes())
            self.spark.createDataFrame([stored], "metric string, shape array<int>, centroids binary").coalesce(1).write.parquet(f"{path}/codebook")
            pq.encode(rows, book).write.parquet(f"{path}/codes")
        if checked.memory_mode != "compact":
            graph.build(rows, checked).write.parquet(f"{path}/graph")
            rows.write.parquet(f"{path}/base")
        return index

    @property
    def _books(self) -> dict:
        return self.__dict__.setdefault("_codebooks", {})

    def _book(self, index: Index) -> pq.Codebook:
        if index.path not in self._books:
            metric, shape, raw = self.spark.read.parquet(f"{index.path}/codebook").select("metric", "shape", "centroids").first()
            self._books[index.path] = pq.Codebook(np.frombuffer(bytes(raw), dtype="<f8").reshape(shape), metric)
        return self._books[index.path]

    def _put(self, index: Index) -> Index:
        self.indexes[index.name] = index
        manifest = asdict(index) | {"deleted": sorted(index.deleted)}
        self.spark.createDataFrame([(index.name, json.dumps(manifest))], "name string, manifest string").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/manifest-{index.version}")
        return index

    def insert(self, name: str, rows: DataFrame) -> Index:
        """Add rows (id, vector) to the delta, which is searched exactly. Null vectors are skipped."""
        index = self.indexes[name]
        if index.deleted and rows.filter(F.col(index.vector_col).isNotNull()).join(self._gone(index), F.col(index.id_col) == F.col("gone"), "left_semi").limit(1).count():
            index = self.compact(name)  # an id that comes back must not meet its own tombstone
        new = rows.filter(F.col(index.vector_col).isNotNull()).select(F.col(index.id_col).cast("long").alias("id"), F.col(index.vector_col).alias("vec"))
        if new.filter(F.size("vec") != index.dims).limit(1).count():
            raise OptionError(f"vectors of index {name!r} have {index.dims} dimensions")
        new = new.withColumn("vec", F.col("vec").cast(self._type(index)))
        new.write.parquet(f"{index.path}/delta-{index.version + 1}")
        new = self.spark.read.parquet(f"{index.path}/delta-{index.version + 1}")
        mark = fingerprint(new, "id", "vec")
        return self._put(replace(index, version=index.version + 1, inserted=index.inserted + mark[0], mark=_joined(index.mark, mark) if index.mark else []))

    def delete(self, name: str, ids: set[int]) -> Index:
        """Mark ids deleted; from a fifth of the rows on, rebuild, unless the index holds codes only."""
        index = self.indexes[name]
        index = self._put(replace(index, version=index.version + 1, deleted=index.deleted | frozenset(ids), mark=[]))
        if index.options.memory_mode != "compact":
            index = self._put(replace(index, mark=fingerprint(self.rows(name), "id", "vec")))
        return self.compact(name) if index.options.memory_mode != "compact" and len(index.deleted) >= COMPACT_AT * max(1, index.rows + index.inserted) else index

    def update(self, name: str, rows: DataFrame) -> Index:
        """Replace vectors: old ones deleted, new ones added, and the whole rebuilt."""
        index = self.indexes[name]
        fresh = rows.select(F.col(index.id_col).cast("long").alias("id"), F.col(index.vector_col).alias("vec"))
        kept = self.rows(name).join(fresh.select("id"), "id", "left_anti")
        return self._rebuild(index, kept.union(fresh.filter("vec is not null")))

    def rows(self, name: str) -> DataFrame:
        """Rows that are live."""
        index = self.indexes[name]
        if index.options.memory_mode == "compact":
            raise OptionError(f"index {name!r} holds codes only; create it anew from its table")
        live = self.spark.read.parquet(f"{index.path}/base")
        for part in self._deltas(index):
            live = live.union(part)
        return self._less(index, live)

    def _type(self, index: Index) -> str:
        return dict(self.spark.read.parquet(f"{index.path}/base").dtypes)["vec"] if index.options.memory_mode != "compact" else "array<float>"

    def _gone(self, index: Index) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in sorted(index.deleted)], "gone long")

    def _less(self, index: Index, rows: DataFrame) -> DataFrame:
        return rows.join(self._gone(index), F.col("id") == F.col("gone"), "left_anti") if index.deleted else rows

    def _deltas(self, index: Index) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for v in range(2, index.version + 1) if self._exists(p := f"{index.path}/delta-{v}")]

    def compact(self, name: str) -> Index:
        return self._rebuild(self.indexes[name], self.rows(name))

    def _rebuild(self, index: Index, rows: DataFrame) -> Index:
        """The index made anew with the same options; the old one goes once the new one is complete."""
        rows = rows.withColumnsRenamed({"id": index.id_col, "vec": index.vector_col})
        made = self._put(self._build(index.name, rows, index.table, index.id_col, index.vector_col, index.dims, index.options))
        self._delete(index)
        return made

    def _delete(self, index: Index) -> None:
        fs, path = self._fs(index.path)
        fs.delete(path, True)
        self._books.pop(index.path, None)

    def drop(self, name: str) -> None:
        self._delete(self.indexes.pop(name))

    def drop_table(self, table: str) -> None:
        for name in [n for n, i in self.indexes.items() if i.table == table]:
            self.drop(name)

    def stale(self, index: Index, df: DataFrame) -> bool:
        return fingerprint(df, index.id_col, index.vector_col) != index.mark

    def info(self) -> DataFrame:
        """One row for each index."""
        rows = [
            (i.name, i.table, i.vector_col, i.dims, i.options.metric, i.options.m, i.options.ef_construction, i.options.quantizer, i.options.pq_m, i.options.memory_mode, i.rows, i.inserted, len(i.deleted), i.version, i.state, i.path)
            for i in sorted(self.indexes.values(), key=lambda i: i.name)
        ]
        return self.spark.createDataFrame(rows, "index_name string, table_name string, column_name string, dims int, metric string, m int, ef_construction int, quantizer string, pq_m int, memory_mode string, n_rows long, n_inserted long, n_deleted long, version int, state string, path string")

    def inspect(self, name: str) -> DataFrame:
        """attribute, content of one index."""
        return self.info().filter(F.col("index_name") == name).selectExpr("stack(7, 'dims', string(dims), 'metric', metric, 'm', string(m), 'ef_construction', string(ef_construction), 'quantizer', quantizer, 'rows', string(n_rows), 'deleted', string(n_deleted)) as (attribute, content)")

    def topk(self, df: DataFrame, query, k: int, *, metric: str = "l2", table: str, id_col: str = "id", vector_col: str = "vec", where=None, settings: SearchSettings | None = None) -> DataFrame:
        """id and dist of the ``k`` nearest: by an index that fits and is fresh, else exactly.

        With the setting ``exact_check`` what the graph finds is checked by a scan
        of ``df``, and the result is exact.
        """
        settings, (plan, index) = settings or SearchSettings(), self.plan(df, metric=metric, table=table, vector_col=vector_col, where=where, settings=settings or SearchSettings())
        if plan == "exact":
            rows = df if where is None else df.filter(where)
            return knn(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")), query, k, metric=metric).select("id", "dist")
        base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
        if plan == "pq":
            book, factor = self._book(index), settings.pq_refine_k_factor
            codes = self.spark.read.parquet(f"{index.path}/codes")
            for part in self._deltas(index):
                codes = codes.union(pq.encode(part, book))
            refine = base if factor > 1 and index.options.memory_mode == "full" else None
            return pq.search(self._less(index, codes), book, query, k, refine=refine, factor=factor)
        allowed = None if where is None else df.filter(where).select(F.col(id_col).cast("long").alias("id"))
        gone = self._gone(index).withColumnRenamed("gone", "id") if index.deleted else None
        found = graph.search(self.spark.read.parquet(f"{index.path}/graph"), query, k, settings.effective_ef(k), allowed_ids=allowed, deleted=gone)
        found = found if metric_of(metric)[1] else found.withColumn("dist", -F.col("dist"))
        for part in self._deltas(index):
            part = self._less(index, part) if allowed is None else self._less(index, part).join(allowed, "id", "left_semi")
            found = found.union(knn(part, query, k, metric=metric).select("id", "dist"))
        if settings.exact_check:
            live = df if where is None else df.filter(where)
            return checked(live.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")), found.select("id"), query, k, metric=metric)
        nearer = F.col("dist").asc() if metric_of(metric)[1] else F.col("dist").desc()
        return found.orderBy(nearer, "id").limit(k)

    def plan(self, df: DataFrame, *, metric: str, table: str, vector_col: str, where=None, settings: SearchSettings) -> tuple[str, Index | None]:
        """exact, graph or pq, and the index used, the first that fits and is fresh.

        A filtered search is exact, over the rows that pass, unless the settings ask
        for the graph; then the walk passes over rows that the filter leaves out.
        """
        fits = [i for i in self.indexes.values() if i.table == table and i.vector_col == vector_col and i.options.metric == {"negative_ip": "ip"}.get(metric, metric)]
        codes = settings.pq_search_mode == "pq_only"
        if codes and fits and not any(i.options.quantizer == "pq" for i in fits):
            raise OptionError("pq_only needs an index with quantizer pq")
        fits = [i for i in fits if (i.options.quantizer == "pq" if codes else True) and i.rows + i.inserted >= settings.brute_force_threshold]
        if where is not None:
            fits = [i for i in fits if settings.filtered_search == "graph" and not codes and i.options.memory_mode != "compact"]
        for index in fits:
            if not self.stale(index, df):
                return ("pq" if codes or index.options.memory_mode == "compact" else "graph"), index
        return "exact", None

    def explain(self, df: DataFrame, k: int, **asked) -> str:
        settings = asked.pop("settings", None) or SearchSettings()
        plan, index = self.plan(df, settings=settings, **asked)
        return f"Index: {index.name if index else 'none'}, Top: {k}, Algorithm: {plan}"

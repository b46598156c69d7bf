"""Toxicity by a classifier with counterfactual regularisation.

Features of a text are which words, and which beginnings of words of four, five
and six letters, occur in it (lower-cased). Those that differ between the
classes in a bounded sample of labelled rows are kept, and a logistic model is
fitted on them. In labelled sentences that name a group, the identity term is
swapped for others, and the squared change of the model's score is part of the
loss. So what a group is called comes to weigh nothing, and neutral mentions
don't raise scores.

Scoring runs over every whole text, slice by slice, with the few thousand
weights at hand.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, join_bounded, uniform_key
from vecloom.llm.spans import ALNUM, hash_spans, lowered, text_slices, word_spans

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 16_000
MOST_FEATURES = 3_000
#: Least documents of a feature, and least likelihood-ratio statistic.
LEAST_DOCS, LEAST_GAIN = 5, 25.0
PREFIXES = (4, 5, 6)
SWAPS = 4

#: Terms for groups of people, by what they name. Fixed values.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "heterosexual", "homosexual"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("deaf", "blind", "disabled", "elderly", "young", "old"),
)

_U = np.uint64


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted feature hashes with their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def _features(data: np.ndarray, ends: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature hash of each occurrence; only of features in ``known`` (sorted) if given."""
    low = lowered(data)
    start, stop, doc = word_spans(low, ends, ALNUM)
    quick = None
    if known is not None:
        quick = np.zeros(1 << 16, dtype=bool)
        quick[(known & _U(0xFFFF)).astype(np.int64)] = True
    found, of = [], []
    for size in (0, *PREFIXES):
        own = slice(None) if size == 0 else np.flatnonzero(stop - start > size)
        s, e, d = start[own], stop[own] if size == 0 else start[own] + size, doc[own]
        h = hash_spans(low, s, e) ^ _U(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if known is not None:
            maybe = np.flatnonzero(quick[(h & _U(0xFFFF)).astype(np.int64)])
            h, d = h[maybe], d[maybe]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            h, d = h[known[at] == h], d[known[at] == h]
        found.append(h)
        of.append(d)
    return np.concatenate(of), np.concatenate(found)


def word_features(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return np.unique(_features(raw, np.array([len(raw)]))[1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, label, text to row, label, distinct features."""
    for batch in batches:
        for i, j, data, ends in text_slices(batch.column(2)):
            doc, h = _features(data, ends)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            doc, h = doc[first], h[first]
            offsets = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["row", "label", "features"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sparse(rows: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every feature that is known."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    h = np.concatenate([*rows, np.empty(0, np.uint64)]).astype(np.uint64)
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    keep = features[at] == h
    return row[keep], at[keep]


def fit(rows: list[np.ndarray], labels: np.ndarray, features: np.ndarray, *, swap_penalty: float = 4.0, ridge: float = 2e-4, steps: int = 400) -> ToxicityModel:
    """Logistic regression with ridge and counterfactual penalties, by accelerated gradient steps."""
    features = np.unique(features.astype(np.uint64))
    row, col = _sparse(rows, features)
    y, n, p = labels.astype(float), max(1, len(rows)), len(features)
    swap_row, swap_col, swap_sign, n_swaps = _swaps(rows, features)
    w, b = np.zeros(p), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v = np.zeros(p + 1), np.zeros(p + 1)
    for t in range(1, steps + 1):
        error = (_sigmoid(np.bincount(row, weights=w[col], minlength=n) + b) - y) / n
        grad = np.bincount(col, weights=error[row], minlength=p) + ridge * w
        if n_swaps:
            change = np.bincount(swap_row, weights=swap_sign * w[swap_col], minlength=n_swaps)
            grad += swap_penalty * np.bincount(swap_col, weights=swap_sign * change[swap_row], minlength=p) / n_swaps
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:p], b - step[p]
    return ToxicityModel(features, w, float(b))


def _swaps(rows: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each labelled text that names a group, and each of some swaps: which features go (-1) and come (+1)."""
    groups = [[word_features(term) for term in group] for group in IDENTITY_TERMS]
    whole = {int(hash_spans(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]))[0]): (g, i) for g, group in enumerate(IDENTITY_TERMS) for i, t in enumerate(group)}
    out_row, out_col, out_sign, n = [], [], [], 0
    for own in rows:
        have = own.astype(np.uint64)
        for h in [x for x in have.tolist() if x in whole]:
            g, i = whole[h]
            others = [k for k in range(len(groups[g])) if k != i]
            for k in itertools.islice((others[(h + j) % len(others)] for j in range(len(others))), SWAPS):
                change = [(f, -1.0) for f in groups[g][i] if f not in groups[g][k]] + [(f, 1.0) for f in groups[g][k] if f not in have]
                at = [(int(np.searchsorted(features, f)), s) for f, s in change]
                for c, s in at:
                    if c < len(features):
                        out_row.append(n)
                        out_col.append(c)
                        out_sign.append(s)
                n += 1
    return np.array(out_row, np.int64), np.array(out_col, np.int64), np.array(out_sign, float), n


def gain(n11: Column, n1: Column, n_1: Column, n: Column) -> Column:
    """Likelihood-ratio statistic of a feature: documents with it and label 1, with it, with label 1, all."""

    def cell(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    a, b, c = n11, n1 - n11, n_1 - n11
    d = n - n1 - c
    return 2 * (cell(a, n1 * n_1 / n) + cell(b, n1 * (n - n_1) / n) + cell(c, (n - n1) * n_1 / n) + cell(d, (n - n1) * (n - n_1) / n))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, swap_penalty: float = 4.0, seed: int = 3) -> ToxicityModel:
    """Fit on at most ``sample_rows`` rows of ``labels``, those of lowest random key.

    Null ids and labels are left out; of repeated ids of labels the largest label
    counts. With no label, or one class only, the model scores all texts alike.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("of").agg(F.max("label").alias("label"))
    known = space.save(known.orderBy(uniform_key(seed, F.col("of"))).limit(sample_rows), "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = join_bounded(rows, known, F.col("id") == F.col("of"), "inner", sample_rows).select(F.col("id").alias("row"), "label", "text")
    sample = space.save(rows.mapInArrow(_extract, f"row {dict(rows.dtypes)['row']}, label int, features array<long>"), "sample")
    n, n_1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    per = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n1"), F.sum("label").alias("n11")).filter(F.col("n1") >= LEAST_DOCS)
    scored = per.withColumn("gain", gain(F.col("n11").cast("double"), F.col("n1").cast("double"), F.lit(float(n_1)), F.lit(float(n)))).filter(F.col("gain") >= LEAST_GAIN)
    chosen = np.array([r[0] for r in scored.orderBy(F.col("gain").desc(), "feature").limit(MOST_FEATURES).select("feature").collect()], dtype=np.int64).astype(np.uint64)
    identity = np.concatenate([word_features(t) for group in IDENTITY_TERMS for t in group])
    wanted = docs.sparkSession.createDataFrame([([int(x) for x in np.unique(np.concatenate([chosen, identity])).astype(np.int64)],)], "wanted array<long>")
    # ties of the sort leave the fit as it is: rows come in order of id
    data = sample.crossJoin(F.broadcast(wanted)).select("row", "label", F.array_intersect("features", "wanted").alias("features")).orderBy("row", "label", F.hash("features")).collect()
    space.close()
    return fit([np.array(r["features"], dtype=np.int64).astype(np.uint64) for r in data], np.array([r["label"] for r in data]), np.concatenate([chosen, identity]), swap_penalty=swap_penalty)


def _scorer(spark, model: ToxicityModel):
    """A function from a column of texts to scores, with the model sent to the executors once."""
    order = np.argsort(model.features)
    shared = spark.sparkContext.broadcast((model.features[order], model.weights[order], model.intercept))

    def scores(texts: pa.Array) -> np.ndarray:
        features, weights, intercept = shared.value
        out = [np.empty(0)]
        for i, j, data, ends in text_slices(texts):
            if not len(features):
                out.append(np.full(j - i, _sigmoid(np.array([intercept]))[0]))
                continue
            doc, h = _features(data, ends, features)
            pair = np.unique(doc * len(features) + np.searchsorted(features, h))
            out.append(_sigmoid(np.bincount(pair // len(features), weights=weights[pair % len(features)], minlength=j - i) + intercept))
        return np.concatenate(out)

    return scores


def score(df: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_crc32 and score (0 to 1) of every row; null and empty texts get the score of a text without features."""
    scores = _scorer(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2)), pa.float64())], names=["id", "text_crc32", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, text_crc32 long, score double").withColumnRenamed("id", id_col)


def keep_below(df: DataFrame, model: ToxicityModel, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, with all their columns; no row moves."""
    scores, at = _scorer(df.sparkSession, model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold))

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", **names) -> DataFrame:
    """Train on the labels that are not held out, and score every document.

    Returns id, text_crc32, held_out, score, predicted (1 from ``threshold`` on).
    Repeated rows get equal scores. Empty tables give an empty result or equal
    scores. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels.filter(~held_out(F.col(id_col))), id_col=id_col, **names)
    scored = score(docs, model, id_col=id_col)
    return scored.select(id_col, "text_crc32", held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

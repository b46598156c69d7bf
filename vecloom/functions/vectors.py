"""Distance functions, vector arithmetic and comparison as Column expressions.

A vector is an array of float or double. All functions are built-in expressions,
so they stay in the JVM and push down like any other. A null argument gives
null; unlike lengths raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Added to the norms' product in the cosine, so that a zero vector is at distance 1. Fixed value.
COSINE_EPSILON = 1.1920929e-7
MAX_DIMS = 16384


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a), F.lit(" and "), F.size(b)))).otherwise(value)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_length(a, b, _dot(a, b))


def negative_inner_product(a, b) -> Column:
    """Minus the inner product; never minus zero."""
    return F.lit(0.0) - inner_product(a, b)


def cosine_similarity(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_length(a, b, _dot(a, b) / (F.sqrt(_dot(a, a) * _dot(b, b)) + COSINE_EPSILON))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def spherical_distance(a, b) -> Column:
    """Angle over pi, for vectors of length one."""
    return F.acos(F.least(F.greatest(inner_product(a, b), F.lit(-1.0)), F.lit(1.0))) / F.pi()


def vector_dims(v) -> Column:
    v = _col(v)
    return F.when(v.isNotNull(), F.size(v))


def vector_norm(v) -> Column:
    v = _col(v)
    return F.sqrt(_dot(v, v))


def l2_normalize(v) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    v = _col(v)
    return F.when(vector_norm(v) == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / vector_norm(v)))


def vector_add(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vector_sub(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vector_cmp(a, b) -> Column:
    """-1, 0 or 1: element by element, then the shorter first."""
    a, b = _col(a), _col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def vector_hash(v) -> Column:
    """Equal vectors have equal hashes; values are not those of other engines."""
    return F.xxhash64(F.transform(_col(v), lambda x: x + F.lit(0).cast("float")))


def subvector(v, start: int, length: int) -> Column:
    """``length`` elements from the one numbered ``start``, counted from 1."""
    return F.slice(_col(v), start, length)


def to_vector(v, dims: int | None = None) -> Column:
    """An array of numbers as array<float>: null elements, NaN, infinities, and a length other than ``dims``, raise errors."""
    v = _col(v)
    cast = v.cast("array<float>")
    bad = F.exists(cast, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wrong = (F.size(v) < 1) | (F.size(v) > MAX_DIMS) if dims is None else F.size(v) != dims
    return F.when(v.isNull(), F.lit(None).cast("array<float>")).when(wrong, F.raise_error(F.lit("wrong number of vector dimensions"))).when(bad, F.raise_error(F.lit("null, NaN or infinite vector element"))).otherwise(cast)


#: Metric: distance (or similarity) and whether less is nearer.
METRICS = {
    "l2": (l2_distance, True),
    "cosine": (cosine_distance, True),
    "ip": (inner_product, False),
    "negative_ip": (negative_inner_product, True),
    "cosine_similarity": (cosine_similarity, False),
    "spherical": (spherical_distance, True),
}
ALIASES = {"cos": "cosine", "inner_product": "ip", "l2_distance": "l2", "cosine_distance": "cosine", "negative_inner_product": "negative_ip"}

_DOT = "aggregate(zip_with({a}, {b}, (x_, y_) -> CAST(x_ AS DOUBLE) * CAST(y_ AS DOUBLE)), 0D, (s_, x_) -> s_ + x_)"
_SAME = "CASE WHEN size({{a}}) <> size({{b}}) THEN raise_error('different vector dimensions') ELSE {} END"
_L2 = "aggregate(zip_with({a}, {b}, (x_, y_) -> CAST(x_ AS DOUBLE) - CAST(y_ AS DOUBLE)), 0D, (s_, d_) -> s_ + d_ * d_)"
_NORM = "sqrt(aggregate({a}, 0D, (s_, x_) -> s_ + CAST(x_ AS DOUBLE) * CAST(x_ AS DOUBLE)))"
_COS = f"{_DOT} / ({_NORM} * {_NORM.replace('{a}', '{b}')} + {COSINE_EPSILON}D)"


def _pair(body: str) -> str:
    return _SAME.replace("{{", "{").replace("}}", "}").replace("{}", body)


#: SQL functions of two vectors: name to body, in which {a} and {b} stand for the arguments.
BODIES = {
    **{n: _pair(f"sqrt({_L2})") for n in ("l2_distance", "array_distance", "list_distance")},
    "l2_squared_distance": _pair(_L2),
    **{n: _pair(_DOT) for n in ("inner_product", "array_inner_product", "list_inner_product")},
    **{n: _pair(f"0D - {_DOT}") for n in ("negative_inner_product", "array_negative_inner_product", "list_negative_inner_product")},
    **{n: _pair(f"1D - {_COS}") for n in ("cosine_distance", "array_cosine_distance", "list_cosine_distance")},
    **{n: _pair(_COS) for n in ("array_cosine_similarity", "list_cosine_similarity")},
    "spherical_distance": _pair(f"acos(least(greatest({_DOT}, -1D), 1D)) / pi()"),
    **{name: _pair(f"zip_with({{a}}, {{b}}, (x_, y_) -> x_ {op} y_)") for name, op in (("vector_add", "+"), ("vector_sub", "-"))},
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session. Spark allows them in select lists and filters, not in ORDER BY; ``plans.operators.rewrite`` writes them out there."""
    for name, body in BODIES.items():
        kind = "ARRAY<DOUBLE>" if name in ("vector_add", "vector_sub") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS {kind} RETURN {body.format(a='a', b='b')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_dims(a ARRAY<DOUBLE>) RETURNS INT RETURN CASE WHEN a IS NOT NULL THEN size(a) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_NORM.format(a='a')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION engine_version() RETURNS STRING RETURN '0.1'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION simd_arch() RETURNS STRING RETURN 'jvm'")

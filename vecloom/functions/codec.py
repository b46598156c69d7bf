"""Vectors as text and as bytes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_text(text: str) -> list[float]:
    """A vector from ``[1, 2.5]``. White space is allowed; anything else raises ValueError."""
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        raise ValueError(f"a vector must stand in brackets: {text[:60]!r}")
    parts = [p.strip() for p in body[1:-1].split(",")]
    if parts == [""] or any(p == "" or any(c.isspace() or c == "_" for c in p) for p in parts):
        raise ValueError(f"a vector needs a number between commas: {text[:60]!r}")
    values = np.array([float(p) for p in parts]).astype(np.float32)
    if not np.isfinite(values).all():
        raise ValueError("NaN and infinities are not allowed in a vector")
    return values.tolist()


def vector_to_wire(v: list[float]) -> bytes:
    """Two big-endian int16 (dimensions, 0), then big-endian float32."""
    return struct.pack(">hh", len(v), 0) + np.asarray(v, ">f4").tobytes()


def vector_from_wire(raw: bytes) -> list[float]:
    n, unused = struct.unpack(">hh", raw[:4])
    if unused or len(raw) != 4 + 4 * n or n < 1:
        raise ValueError("malformed vector")
    return np.frombuffer(raw, ">f4", offset=4).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def parse_vector(texts: pd.Series) -> pd.Series:
    """Strict: malformed text raises, null stays null."""
    return texts.map(lambda t: None if t is None else parse_text(t))


def format_vector(v: Column) -> Column:
    """Text that ``parse_vector`` reads back to the same floats."""
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("float").cast("string")), ","), F.lit("]")))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes."""
    for part in vectors:
        yield part.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in blobs:
        yield part.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.StringType())
def blob_to_json(blobs: pd.Series) -> pd.Series:
    """JSON with six significant digits."""
    return blobs.map(lambda b: None if b is None else "[" + ",".join(f"{x:g}" for x in np.frombuffer(b, "<f4").tolist()) + "]")


def json_to_vector(text: str) -> list[float]:
    """Strict JSON array of numbers."""
    value = json.loads(text)
    if not isinstance(value, list) or not value or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
        raise ValueError("not a JSON array of numbers")
    return np.asarray(value, np.float32).tolist()

"""Vector arithmetic as Catalyst expressions, and the float32 byte codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def length(v: Column | str) -> Column:
    return F.size(v)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cos, from 0 to 2; null for zero vectors."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_distance(a: Column | str, b: Column | str) -> Column:
    """The cosine distance of unit vectors: one dot product."""
    return F.lit(1.0) - dot(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l1_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column | str) -> Column:
    """A vector over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: F.try_divide(x, n)))


@F.pandas_udf(BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

"""Vector operators on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column | str, floor: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(floor)))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def l1(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Different bits of two 64-bit numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: Column | str) -> Column:
    """64 bits from a vector of 64: bit i is set where element i is positive."""
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))


def bits_to_signs(h: Column | str) -> Column:
    """A 64-bit hash as a vector of 1 and -1, so that cosine = 1 - 2 * hamming / 64."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(h, i) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))

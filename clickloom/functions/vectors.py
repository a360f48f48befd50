"""Numbers, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucketise(value: Column, separators: list[float]) -> Column:
    """Number of separators at or below value; null for NaN."""
    seps = F.array(*[F.lit(float(s)) for s in sorted(separators)])
    return F.when(~F.isnan(value.cast("double")), F.size(F.filter(seps, lambda s: value >= s)))


def sigmoid(e: Column) -> Column:
    return F.when(e < -100, 0.0).otherwise(1 / (1 + F.exp(-e)))


def entropy(*shares: Column) -> Column:
    """Base 2; a share of 0 adds nothing."""
    total = F.lit(0.0)
    for p in shares:
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rounded(values: Column, digits: int = 2, kind: T.DataType | None = None) -> Column:
    """Fractions in values rounded, whatever they are nested in; kind: the column's type, array<double> if not given."""
    kind = kind or T.ArrayType(T.DoubleType())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(values, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(values, lambda x: rounded(x, digits, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(values, lambda k, v: rounded(k, digits, kind.keyType)), lambda k, v: rounded(v, digits, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(values.isNotNull(), F.struct(*[rounded(values[f.name], digits, f.dataType).alias(f.name) for f in kind]))
    return values


#: A tier's rows for one feature, and its rows at most.
TIERS = ((100, 1000), (200, 5000), (300, 30000), (400, 1000000))
MOST_BUDGET = sum(cap // a for a, cap in TIERS)


def budget(n: Column, amplify: float = 1) -> Column:
    """Tiered budget of a count: within each tier one for every a rows, up to a cap; all times amplify, less the fraction."""
    left, total = n.cast("long"), F.lit(0).cast("long")
    for a, cap in TIERS:
        total = total + F.greatest(F.lit(0), F.floor(F.least(left, F.lit(cap)) / a).cast("long"))
        left = left - cap
    return F.floor(total * amplify).cast("long") if amplify != 1 else total

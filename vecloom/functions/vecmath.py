"""Vector arithmetic as Column builders: everything stays in the JVM and computes in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as one, so a zero vector normalises to itself (fixed value of the data model).
TINY = 1e-10

#: Accepted spellings of each metric (fixed values).
METRICS = {"l2": "l2", "euclidean": "l2", "sqeuclidean": "sqeuclidean", "cosine": "cosine"}


def metric_name(alias: str) -> str:
    """The canonical metric of a spelling; case and outer blanks don't matter."""
    key = alias.strip().lower()
    if key not in METRICS:
        raise ValueError(f"unknown metric {alias!r}; use one of {sorted(METRICS)}")
    return METRICS[key]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sq_norm(v: Column | str) -> Column:
    return _total(F.transform(doubles(v), lambda x: x * x))


def norm(v: Column | str) -> Column:
    return F.sqrt(sq_norm(v))


def sq_l2(a: Column | str, b: Column | str) -> Column:
    """Squared distance by direct differences, so it is never negative."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


#: Beyond this length unrolled expressions no longer pay.
UNROLLED = 128


def sq_l2_at(a: Column | str, b: Column | str, d: int) -> Column:
    """The same for a known length, unrolled in order: one expression inside whole-stage code; null for shorter arrays."""
    if d > UNROLLED:
        return sq_l2(a, b)
    a, b = _col(a), _col(b)
    total = F.lit(0.0)
    for i in range(d):
        diff = F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)).cast("double")
        total = total + diff * diff
    return total


def dot_at(a: Column | str, b: Column | str, d: int) -> Column:
    if d > UNROLLED:
        return dot(a, b)
    a, b = _col(a), _col(b)
    total = F.lit(0.0)
    for i in range(d):
        total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
    return total


def normalise(v: Column | str) -> Column:
    n = norm(v)
    by = F.when(n < TINY, F.lit(1.0)).otherwise(n)
    return F.transform(doubles(v), lambda x: x / by)


def centre(v: Column | str, mu: Column | str) -> Column:
    return F.zip_with(doubles(v), doubles(mu), lambda x, m: x - m)


def from_sq(sq: Column | str, metric: str) -> Column:
    """Squared distance to the distance a metric returns (cosine expects normalised vectors)."""
    sq = _col(sq)
    kind = metric_name(metric)
    if kind == "l2":
        return F.sqrt(F.greatest(F.lit(0.0), sq))
    return sq if kind == "sqeuclidean" else sq * F.lit(0.5)


def usable(v: Column | str, d: int) -> Column:
    """Non-null, exactly ``d`` elements, none of them null or NaN; never null itself."""
    v = _col(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(v.isNotNull() & (F.size(v) == d) & ~bad, F.lit(False))

"""Null-aware value logic."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def when_only(cond: Column, value) -> Column:
    """``CASE WHEN cond THEN value END`` -- null otherwise."""
    return F.when(cond, value)


def nvl(x, default=0) -> Column:
    """``nvl(x, 0)``."""
    return F.coalesce(_c(x), F.lit(default))


def typed_null(dtype: str) -> Column:
    """P5: a typed null column (``lit(None)`` alone is ``void``)."""
    return F.lit(None).cast(dtype)


def false_or_null(x) -> Column:
    """F8: ``x is null or not x`` -- keeps the null rows ``not x`` would drop."""
    x = _c(x)
    return x.isNull() | ~x


def present_nonzero(x) -> Column:
    """``nullif(x, 0) is not null``."""
    return F.nullif(_c(x), F.lit(0)).isNotNull()


def any_true(*flags) -> Column:
    """``f1 = true or f2 = true or ...`` (null flags count as false)."""
    return reduce(or_, [F.coalesce(_c(f), F.lit(False)) for f in flags])


def at_most_flag(x, limit) -> Column:
    """``CASE WHEN x <= limit THEN 1 END`` -- inclusive; negatives pass."""
    return F.when(_c(x) <= F.lit(limit), F.lit(1))


def bands(x, low_below=1000, high_from=5000, labels=("low", "middle", "high")) -> Column:
    """``< low`` -> low; strictly between -> middle; everything else
    (exactly ``low_below``, ``>= high_from``, null) -> high, as in the source."""
    x = _c(x)
    lo, mid, hi = labels
    return (F.when(x < F.lit(low_below), F.lit(lo))
            .when((x > F.lit(low_below)) & (x < F.lit(high_from)), F.lit(mid))
            .otherwise(F.lit(hi)))


def to_int(x, dtype: str = "int") -> Column:
    """``text::int`` on keys that may be dirty -- null instead of a
    failed job when a value does not parse (ANSI casts raise)."""
    return _c(x).try_cast(dtype)


def ratio(num, den) -> Column:
    """``cast(a as float) / cast(b as float)``; null when ``b`` is null or 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))

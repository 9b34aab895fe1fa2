"""Column helpers that keep NaN, infinity and division by zero out of panels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when the divisor is zero (ANSI mode would raise)."""
    return F.try_divide(num, den)


def nullif_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def clean_float(c: Column) -> Column:
    """NaN and infinities become NULL, so SQL aggregates skip them."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def zero_is_missing(c: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(c) >= eps, c)


def corr_guarded(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; NULL when a
    side is constant or fewer than two pairs exist."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), spread))


def sign_match(x: Column, y: Column) -> Column:
    return F.signum(x) == F.signum(y)

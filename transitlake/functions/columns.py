"""Column expressions: null-safe arithmetic, phases, masks, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null, so comparisons with them are never true."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def logistic(x: Column, centre: float, scale: float) -> Column:
    """Null counts as 0."""
    return F.coalesce(1 / (1 + F.exp(-(x - centre) / scale)), F.lit(0.0))


def floor_mod(x: Column, p: Column) -> Column:
    return x - F.floor(x / p) * p


def phase_days(time: Column, period: Column, t0: Column) -> Column:
    """Days from the nearest event, in [-P/2, P/2)."""
    return floor_mod(time - t0 + period / 2, period) - period / 2


def event_number(time: Column, period: Column, t0: Column) -> Column:
    return F.floor((time - t0) / period + 0.5)


def transit_mask(time: Column, period: Column, t0: Column, duration: Column, width: float = 1.0) -> Column:
    ok = (period > 0) & (duration > 0)
    return F.coalesce(ok & (F.abs(phase_days(time, period, t0)) < duration * (0.5 * width)), F.lit(False))


def present(*flags: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))


def first_existing(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that is a column, whatever its values."""
    return next((a for a in aliases if a in columns), None)

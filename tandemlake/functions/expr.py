"""Column expressions used across operators. NaN and infinities become null here, as everywhere at a boundary."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(col(a), col(b))


def rows(order: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the present one included."""
    return order.rowsBetween(-(n - 1), 0)


def before(order: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the present one."""
    return order.rowsBetween(-n, -1)


def full(c: Column, value: Column | str, frame: WindowSpec, n: int) -> Column:
    """c, where the frame has n values."""
    return F.when(F.count(col(value)).over(frame) >= n, c)


def logret(c: Column | str, order: WindowSpec, k: int = 1) -> Column:
    return F.log(ratio(c, F.lag(col(c), k).over(order)))


def pct(c: Column | str, order: WindowSpec, k: int = 1) -> Column:
    return ratio(col(c), F.lag(col(c), k).over(order)) - 1


def zscore(c: Column | str, part: WindowSpec, ddof: int = 0) -> Column:
    """Against the whole partition; zero where the deviation is zero or unknown."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(col(c)).over(part)
    return F.when(sd > 0, (col(c) - F.avg(col(c)).over(part)) / sd).otherwise(0.0)


def rolling_zscore(c: Column | str, order: WindowSpec, n: int, min_periods: int | None = None, ddof: int = 0, zero: bool = True) -> Column:
    """Against the last n rows; zero (or null) where it isn't finite."""
    f = rows(order, n)
    sd = full((F.stddev_pop if ddof == 0 else F.stddev_samp)(col(c)).over(f), c, f, min_periods or n)
    z = F.when(sd > 0, (col(c) - F.avg(col(c)).over(f)) / sd)
    return F.coalesce(z, F.lit(0.0)) if zero else z


def median(c: Column | str, window: WindowSpec) -> Column:
    return F.percentile(col(c), F.lit(0.5)).over(window)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bounded below and above; null stays null."""
    c = col(c)
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def market_impact(shares: Column, price: Column, adv: Column, vol_bps: Column, eta: float = 0.14) -> Column:
    """Square-root impact of a whole order, in dollars: eta, daily volatility (a fraction of bps), price and root of participation, by shares."""
    if eta < 0:
        raise ValueError("eta must not be negative")
    return eta * (vol_bps / 1e4) * price * F.sqrt(ratio(F.abs(shares), adv)) * F.abs(shares)


def neg_log10(p: Column | str, floor: float = 1e-30) -> Column:
    return -F.log10(F.greatest(F.least(col(p), F.lit(1.0)), F.lit(floor)))


def midrank(part: WindowSpec, c: Column | str, *more: str) -> Column:
    """Average rank of ties. part: the partition without an order; more: its columns."""
    return F.rank().over(part.orderBy(col(c))) + (F.count(F.lit(1)).over(Window.partitionBy(*more, c)) - 1) / 2

"""Column helpers over the rows of one series: (symbol, interval) in the order of timestamp.

All use one partitioning, so Spark plans a single shuffle for any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS = ("symbol", "interval")
TIME = "timestamp"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(TIME)


def last_rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(series())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(col(x), k).over(series())


def row_index() -> Column:
    """0 for the first row of the series."""
    return F.row_number().over(series()) - 1


def roll(fn, x: Column | str, n: int) -> Column:
    """fn over the last n rows, null until all n of them have a value."""
    w = last_rows(n)
    return F.when(F.count(col(x)).over(w) == n, fn(col(x)).over(w))


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles are divided: infinite where b is 0, NaN where both are."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """The natural logarithm of doubles: -infinity at 0, NaN below."""
    return F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def half_up(x: Column | str, digits: int) -> Column:
    """x rounded, halves away from 0. Sums that are a half come out some last bits below it or above, by their order: four
    of these bits below count as a half."""
    return F.round(col(x) * (1 + 2**-50), digits)


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def pct_change(x: Column | str, k: int = 1) -> Column:
    return div(col(x), lag(x, k)) - 1


def add(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, all in one projection."""
    return df.withColumns(columns)


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation over the last n rows, null where one of the two does not vary or is not complete."""
    w = last_rows(n)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    px, py = F.when(both == 1, x), F.when(both == 1, y)
    sx, sy = F.stddev_samp(px).over(w), F.stddev_samp(py).over(w)
    return F.when(F.count(both).over(w) == n, div(F.covar_samp(px, py).over(w), sx * sy))

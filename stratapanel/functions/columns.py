"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ZERO_TOLERANCE = 1e-8


def near_zero(x: Column) -> Column:
    return F.abs(x) <= ZERO_TOLERANCE


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is (nearly) zero or NULL."""
    return F.when(~near_zero(b), F.try_divide(a, b))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL: a missing cell is NULL everywhere."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def flag(condition: Column) -> Column:
    """1.0 / 0.0 with NULL counted as not satisfied."""
    return F.when(condition, 1.0).otherwise(0.0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def share_if(condition: Column) -> Column:
    return F.avg(flag(condition))


def compound(r: Column) -> Column:
    return F.product(1.0 + r)


def annual_return(growth: Column, n: Column, worst: Column, periods: int = 12) -> Column:
    """Geometric annual rate; a total loss in any period gives -1."""
    return F.when(worst <= -1.0, F.lit(-1.0)).when(
        n > 0, F.pow(growth, F.lit(float(periods)) / n) - 1.0
    )


def annual_volatility(std: Column, periods: int = 12) -> Column:
    return std * float(periods) ** 0.5


def annual_ratio(mean: Column, std: Column, periods: int = 12) -> Column:
    """Sharpe-type ratio, NULL without dispersion."""
    return ratio(mean, std) * float(periods) ** 0.5


def pearson(x: Column, y: Column) -> Column:
    """Sample correlation as an aggregate, NULL when a side is constant.

    ``corr`` raises on a constant column under ANSI mode, hence this form.
    """
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def message_if(condition: Column, message: str, value: Column) -> Column:
    """``value``, but fail the job loudly when ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def checked(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, but the same job fails where ``violations`` has a row.

    The check is a node of the plan: one counted row that either raises or is
    filtered out.  So it also runs where ``df`` is empty, which no expression on
    a row of ``df`` can.
    """
    failed = F.when(F.col("_n") > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    none = violations.agg(F.count(F.lit(1)).alias("_n")).where(failed)
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(c, F.lit(t)) for c, t in pairs]), lambda x: x.isNotNull()
    )


def joined(array: Column, separator: str = "|") -> Column:
    """Delimited text, NULL for an empty array."""
    return F.when(F.size(array) > 0, F.array_join(array, separator))


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as scalar subqueries (no join)."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def sorted_json(map_column: Column) -> Column:
    """JSON text of a map with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(map_column))))

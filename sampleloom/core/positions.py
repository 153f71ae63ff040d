"""Exact integer arithmetic on sample positions. Positions are bigint; seconds are never floating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = Column | int


def as_column(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def div(a: ColumnLike, b: ColumnLike) -> Column:
    """Integer division toward zero, in bigint."""
    return F.call_function("div", as_column(a).cast("long"), as_column(b).cast("long"))


def floor_div(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = as_column(a), as_column(b)
    return div(a - F.pmod(a, b), b)


def ceil_div(a: ColumnLike, b: ColumnLike) -> Column:
    return -floor_div(-as_column(a), b)


def floor_to(a: ColumnLike, grid: ColumnLike) -> Column:
    a = as_column(a)
    return a - F.pmod(a, as_column(grid))


def ceil_to(a: ColumnLike, grid: ColumnLike) -> Column:
    return ceil_div(a, grid) * as_column(grid)


def output_length(samples: ColumnLike, rate_in: int, rate_out: int) -> Column:
    """Frames after a rate change: ceil(samples * L / M) with L/M in lowest terms."""
    from math import gcd

    g = gcd(rate_in, rate_out)
    return ceil_div(as_column(samples) * (rate_out // g), rate_in // g)


def sample_time_ns(sample: ColumnLike, rate: ColumnLike) -> Column:
    """Position on the stream's clock in nanoseconds, whole seconds apart so it cannot overflow."""
    sample, rate = as_column(sample), as_column(rate)
    return div(sample, rate) * 1_000_000_000 + div((sample % rate) * 1_000_000_000, rate)


def min_frames(duration_ns: int, rate: int) -> int:
    """The shortest number of whole frames that lasts ``duration_ns`` or longer."""
    whole, rest = divmod(duration_ns, 1_000_000_000)
    return whole * rate + -(-rest * rate // 1_000_000_000)


def prefix_sum(df: DataFrame, by: list[str], order: list[str], bucket: Column, amount: Column, name: str) -> DataFrame:
    """Add the exclusive running sum of ``amount`` within ``by``, in two levels.

    ``bucket`` must grow with ``order``.  Rows are summed within their bucket,
    buckets (far fewer) among themselves, so one long track is spread over as
    many tasks as it has buckets.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__amount", amount)
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = rows.groupBy(*by, "__bucket").agg(F.sum("__amount").alias("__sum"))
    bases = sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(across), zero).alias("__base"))
    local = rows.withColumn("__local", F.coalesce(F.sum("__amount").over(inside), zero))
    return local.join(bases, [*by, "__bucket"]).withColumn(name, F.col("__base") + F.col("__local")).drop("__bucket", "__amount", "__base", "__local")

"""Ordered rows: islands, sections, depth, carrying forward, idle times, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _w(on: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*on).orderBy(*order)


def islands(df: DataFrame, on: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """A number for each run of equal consecutive values (NULLs are equal)."""
    w = _w(on, order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", new.cast("int")).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def longest_run(df: DataFrame, on: list[str], order: list[str], flag: Column) -> DataFrame:
    """(on..., longest): the longest run of consecutive rows with ``flag``; 0 where there is none."""
    runs = islands(df.withColumn("__f", F.coalesce(flag, F.lit(False))), on, order, "__f", "__run")
    return runs.groupBy(*on, "__run", "__f").agg(F.count("*").alias("n")).groupBy(*on).agg(F.coalesce(F.max(F.when(F.col("__f"), F.col("n"))), F.lit(0)).alias("longest"))


def sections(df: DataFrame, on: list[str], order: list[str], starts: Column, out: str = "section") -> DataFrame:
    """Running number of the section a row lies in; 0 before the first start."""
    return df.withColumn(out, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_w(on, order).rowsBetween(Window.unboundedPreceding, 0)))


def clamped_depth(df: DataFrame, on: list[str], order: list[str], step: Column, out: str = "depth") -> DataFrame:
    """Bracket depth that never falls below 0: the running sum less its lowest value below 0 so far."""
    w = _w(on, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__s", F.sum(step).over(w)).withColumn(out, F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).drop("__s")


def carried(df: DataFrame, on: list[str], order: list[str], value: str, out: str, back: int | None = None) -> DataFrame:
    """The last non-NULL value before the row, at most ``back`` rows back."""
    first = Window.unboundedPreceding if back is None else -back
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_w(on, order).rowsBetween(first, -1)))


def idle_sessions(df: DataFrame, on: list[str], order: str, idle: float, out: str = "session") -> DataFrame:
    """A new session where the order value jumps by more than ``idle``."""
    w = _w(on, [order])
    gap = F.col(order) - F.lag(order).over(w) > idle
    return df.withColumn("__g", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(out, F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__g")


def next_anchor(df: DataFrame, on: list[str], order: str, flag: Column, out: str = "next_anchor", within: int | None = None) -> DataFrame:
    """The order value of the next flagged row, at most ``within`` rows ahead."""
    last = Window.unboundedFollowing if within is None else within
    return df.withColumn(out, F.min(F.when(flag, F.col(order))).over(_w(on, [order]).rowsBetween(1, last)))


def backtracks(df: DataFrame, on: list[str], order: list[str], number: str) -> DataFrame:
    """(on..., backtracks): how often a row's number falls more than one below that of the row before."""
    step = df.withColumn("__p", F.lag(number).over(_w(on, order)))
    return step.groupBy(*on).agg(F.count_if(F.col(number) < F.col("__p") - 1).alias("backtracks"))


def gaps(df: DataFrame, on: list[str], order: list[str], ply: str) -> DataFrame:
    """Rows whose ply is not one more than that of the row before: ``expected`` and ``jump``."""
    w = _w(on, order)
    return df.withColumn("expected", F.lag(ply).over(w) + 1).where(F.col("expected").isNotNull() & (F.col(ply) != F.col("expected"))).withColumn("jump", F.col(ply) - F.col("expected"))


def ahead(df: DataFrame, on: list[str], order: list[str], value: str, n: int, out: str = "ahead") -> DataFrame:
    """The values of the next ``n`` rows."""
    return df.withColumn(out, F.collect_list(value).over(_w(on, order).rowsBetween(1, n)))


def behind(df: DataFrame, on: list[str], order: list[str], value: str, n: int, out: str = "behind") -> DataFrame:
    """The values of the ``n`` rows before."""
    return df.withColumn(out, F.collect_list(value).over(_w(on, order).rowsBetween(-n, -1)))


def interpolated(df: DataFrame, on: list[str], order: list[str], value: str, out: str = "between") -> DataFrame:
    """The mean of the neighbours' values; one neighbour's if there is only one."""
    w = _w(on, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))


def sampled(df: DataFrame, on: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The middle row of each of ``n`` equal parts (all rows if there are fewer)."""
    w, all_ = _w(on, order), Window.partitionBy(*on)
    step = F.greatest(F.floor(F.col("__n") / n), F.lit(1))
    return df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(all_)).where(F.pmod(F.col("__i") - F.floor(step / 2), step) == 0).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__i", "__n", "__k")

"""Joins in time without inequality joins: the last state before a moment, moments in intervals, intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of time into which the rows of one key are split.
RANGES = 64
#: Bits between the lengths of cells: more lengths mean more rows of a point, fewer mean more pairs that do not hold.
LEVELS = 3


def as_number(df: DataFrame, name: str) -> Column:
    """A date, timestamp or whole number as a long that orders alike (days, microseconds, the number)."""
    kind, x = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return x.cast("long")
    raise TypeError(f"{name} is {kind.simpleString()}: a date, a timestamp or a whole number is needed")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], ties: list[str] = (), strict: bool = False, within: int | None = None, ranges: int = RANGES) -> DataFrame:
    """Each row of left with the values of the key's last row of right at or before it (strict: before it): left's columns, then values.

    ties: columns of right that decide among rows of one moment (the largest wins). within: right rows that lie further back (in
    days or microseconds, as at is) do not count. Rows of left without a match, with a null key or moment, have null values.

    Both sides go through one shuffle, by key and range of time; what a range's rows need from before comes as one row a key and range (the last
    right row of the ranges before), so a key with most of the rows is split. Rows of one key and moment stay together.
    """
    names = [f"_v{i}" for i in range(len(values))]
    right_row = F.struct(as_number(right, right_at).alias("_at"), *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    tie = lambda cols: F.struct(F.lit(0).alias("_0"), *[c.alias(f"_t{i}") for i, c in enumerate(cols)])
    r = right.dropna(subset=[*keys, right_at]).select(*keys, as_number(right, right_at).alias("_t"), F.lit(2 if strict else 0).alias("_side"), tie([F.col(c) for c in ties]).alias("_tie"), right_row.alias("_r"))
    no_tie = tie([F.lit(None).cast(right.schema[c].dataType) for c in ties])
    l_ = left.select(*keys, as_number(left, at).alias("_t"), F.lit(1).alias("_side"), no_tie.alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = l_.unionByName(r.withColumn("_l", F.lit(None).cast(l_.schema["_l"].dataType)))
    shares = F.lit([i / ranges for i in range(1, ranges)]) if ranges > 1 else None
    found = r.agg(F.percentile_approx("_t", shares, F.lit(20 * ranges)).alias("q")).first()["q"] if ranges > 1 else None
    bounds = sorted(set(found or []))
    place = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("_t"))) if bounds else F.lit(0)
    both = both.withColumn("_range", place)
    last = both.groupBy(*keys, "_range").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_r"))
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*keys, "_range", F.lit(None).cast("long").alias("_t"), F.lit(-1).alias("_side"), no_tie.alias("_tie"), before.alias("_r"), F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"))
    w = Window.partitionBy(*keys, "_range").orderBy(F.col("_side") != -1, "_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.unionByName(carried).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    if within is not None:
        usable = usable & (F.col("_t") - F.col("_m._at") <= within)
    return seen.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.when(usable, F.col(f"_m.{n}")).alias(v) for n, v in zip(names, values, strict=True)])


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval of its key with start <= at < end: keys, then the other columns of both (of different names).

    An interval lies in at most two cells of the least power of eight that holds its length; a point lies in one cell of each length that
    occurs (22 at most, read from the intervals). So the join is on key, length and cell, and each pair is met once,
    whatever the mix of long and short intervals. Intervals that are empty or have a null end hold nothing.
    What is told by other columns is made after the shuffle.
    """
    length = as_number(intervals, end) - as_number(intervals, start)
    sized = intervals.withColumn("_length", length).where("_length > 0")
    bits = F.when(F.col("_length") == 1, 0).otherwise(F.length(F.bin(F.col("_length") - 1)))
    level = (F.ceil(bits / LEVELS) * LEVELS).cast("int")
    leveled = sized.withColumns({"_level": level, "_from": as_number(intervals, start), "_to": as_number(intervals, end)})
    levels = sorted(r["_level"] for r in leveled.select("_level").distinct().collect())
    cells = F.expr("CASE WHEN _level > 62 THEN sequence(shiftright(_from, 63), shiftright(_to - 1, 63)) ELSE sequence(shiftright(_from, _level), shiftright(_to - 1, _level)) END")
    held = leveled.withColumn("_cell", F.explode(cells)).drop("_length", "_from", "_to")
    spread = points.withColumn("_at", as_number(points, at)).withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_cell", F.expr("shiftright(_at, least(_level, 63))")).drop("_at")
    inside = (as_number(points, at) >= as_number(intervals, start)) & (as_number(points, at) < as_number(intervals, end))
    return spread.join(held, [*keys, "_level", "_cell"]).where(inside).drop("_level", "_cell")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Pairs of intervals (end exclusive) of one key that share a moment, each once: either b starts in a, or a starts later and in b."""
    full_a, full_b = a.where(as_number(a, a_end) > as_number(a, a_start)), b.where(as_number(b, b_end) > as_number(b, b_start))
    first = within_intervals(full_b, full_a, keys, b_start, a_start, a_end)
    second = within_intervals(full_a, full_b, keys, a_start, b_start, b_end).where(F.col(a_start) > F.col(b_start))
    columns = [*keys, *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys]]
    return first.select(*columns).union(second.select(*columns))

"""Totals at several grains from one pass, and sketches that are stored and merged later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: a relative standard error of about 1.04 / sqrt(2 ** 12) = 1.6 %.
HLL_BITS = 12
#: Of the quantile sketch: ranks are off by less than 1.33 % (for 99 % of all queries).
KLL_SIZE = 200


def grain(df: DataFrame, dims: list[str], sums: list[str], member: str | None = None) -> DataFrame:
    """The finest totals: dims, a sum for each of sums, n, and with a member a row for each member seen (_member). Later grains are added up
    from here."""
    added = [F.sum(c).alias(c) for c in sums]
    if member is None:
        return df.groupBy(*dims).agg(*added, F.count(F.lit(1)).alias("n"))
    return df.groupBy(*dims, F.col(member).alias("_member")).agg(*added, F.count(F.lit(1)).alias("n"))


def totals(grained: DataFrame, dims: list[str], sets: list[list[str]], sums: list[str], distinct: str | None = None) -> DataFrame:
    """Totals of each grouping set: dims (null where summed over), grouping_id (a bit for each dim that is summed over, the first the
    highest), sums, n, and under the name distinct how many different members there are.

    Only the grained rows are expanded. Distinct counts are exact: a member's rows are shuffled once, as grained, and count one for each group where
    they lie, so that what is shuffled again is a row a group and task.
    """
    columns = [F.col(d) for d in dims]
    chosen = [[F.col(d) for d in s] for s in sets]
    names = [*sums, "n"]
    if distinct is None:
        out = grained.groupingSets(chosen, *columns).agg(F.grouping_id().alias("grouping_id"), *[F.sum(c).alias(c) for c in names])
        return out.select(*dims, "grouping_id", *names)
    member = F.col("_member")
    each = grained.repartition(member).groupingSets([[*s, member] for s in chosen], *columns, member).agg(F.shiftright(F.grouping_id(), 1).alias("grouping_id"), *[F.sum(c).alias(c) for c in names])
    return each.groupBy(*dims, "grouping_id").agg(*[F.sum(c).alias(c) for c in names], F.count("_member").alias(distinct))


def cube_sets(dims: list[str]) -> list[list[str]]:
    """All subsets."""
    return [[d for i, d in enumerate(dims) if m >> i & 1] for m in range(1 << len(dims))]


def rollup_sets(dims: list[str]) -> list[list[str]]:
    """All prefixes, the whole first."""
    return [dims[:n] for n in range(len(dims), -1, -1)]


def sketched(df: DataFrame, keys: list[str], member: str, measure: str) -> DataFrame:
    """A row of sketches a key (a case and day, say): distinct members (HLL and theta) and the distribution of a measure (KLL), with the exact n.
    Rows of any two tables of sketches can be merged."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(member, HLL_BITS).alias("members_hll"),
        F.theta_sketch_agg(member).alias("members_theta"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL_SIZE).alias("measure_kll"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys from those of more: no row of the data is read again."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("members_hll").alias("members_hll"), F.theta_union_agg("members_theta").alias("members_theta"), F.kll_merge_agg_double("measure_kll").alias("measure_kll")
    )


def estimates(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """keys, n, members (HLL), members_theta and for each share a quantile (q50 for 0.5)."""
    quantiles = [F.kll_sketch_get_quantile_double("measure_kll", F.lit(float(s))).alias(f"q{round(100 * s)}") for s in shares]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("members_hll").alias("members"), F.theta_sketch_estimate("members_theta").alias("members_theta"), *quantiles)


def in_both(sketches: DataFrame, keys: list[str], side: str, a: str, b: str) -> DataFrame:
    """keys, both: about how many members stand in the sketches of side a and of side b."""
    of = lambda v: sketches.where(F.col(side) == v).groupBy(*keys).agg(F.theta_union_agg("members_theta").alias(f"_{v}"))
    one, other = of(a), of(b)
    joined = one.join(other, keys) if keys else one.crossJoin(other)  # without keys each side is one row
    return joined.select(*keys, F.theta_sketch_estimate(F.theta_intersection(f"_{a}", f"_{b}")).alias("both"))

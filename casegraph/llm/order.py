"""The next row of a whole table without a one-task window.

Keys are dealt into buckets whose bounds are real key values (quantiles), so the row that follows the last row of a
bucket always has a bound as its key: it is enough to send rows with such keys to two buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds stand in an expression; beyond so many it only gets longer.
MAX_BUCKETS = 4096
#: Null keys become numbers below this, spread by a hash; keys themselves lie above it.
BELOW_ALL = -(1 << 62)


def bounds_of(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending values of key, about as many as buckets, the largest last. Empty for an empty table."""
    n = max(1, min(buckets, MAX_BUCKETS))
    shares = F.lit([i / n for i in range(1, n + 1)])
    row = df.agg(F.percentile_approx(key, shares, F.lit(20 * n)).alias("q"), F.max(key).alias("m")).first()
    return sorted({*row["q"], row["m"]}) if row["m"] is not None else []


def _array(values: list[int]) -> str:
    return "array(" + ",".join(f"cast('{v}' as bigint)" if v < -(1 << 62) else f"{v}L" for v in values) + ")"


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below key: bucket b holds the keys in (bounds[b - 1], bounds[b]]. Two short scans of bounds."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(F.expr(_array([b[-1] for b in blocks])), lambda x: x < key))
    inside = F.size(F.filter(F.get(F.expr(f"array({','.join(map(_array, blocks))})"), block), lambda x: x < key))
    return (block * step + inside).cast("int")


def with_following(docs: DataFrame, key: str, derive: dict[str, Column], carry: list[str], following: str = "following") -> DataFrame:
    """docs with the columns of derive, and a struct of carry from the next row in descending key (after the last: the first).

    One shuffle of the rows; derive is computed after it, so it is never shuffled. Rows with equal keys stand in the
    order of carry[0]; rows with a null key come last, in an order fixed by their carry[0]. A table of one row is
    followed by itself.
    """
    spark = docs.sparkSession
    numbered = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(BELOW_ALL) - F.pmod(F.xxhash64(carry[0]), F.lit(1 << 32))))
    bounds = bounds_of(numbered, "_key", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        placed = numbered.withColumns({"_bucket": F.lit(0), "_copy": F.lit(0)})
    else:
        own, top = F.col("_bucket"), len(bounds) - 1
        real = F.struct(own.alias("b"), F.lit(0).alias("c"))
        # a bucket's largest keys also close the bucket above; the largest of all close the lowest, as its very last
        ghost = F.struct(F.when(own == top, F.lit(0)).otherwise(own + 1).alias("b"), F.when(own == top, F.lit(2)).otherwise(F.lit(1)).alias("c"))
        edge = F.col("_key") == F.get(F.expr(_array(bounds)), own)
        placed = (
            numbered.withColumn("_bucket", bucket_of(F.col("_key"), bounds))
            .withColumn("_place", F.explode(F.when(edge, F.array(real, ghost)).otherwise(F.array(real))))
            .withColumns({"_bucket": F.col("_place.b"), "_copy": F.col("_place.c")})
        )
    order = Window.partitionBy("_bucket").orderBy(F.col("_copy") == 2, F.col("_key").desc(), F.col(carry[0]))
    return (
        placed.repartition("_bucket")
        .withColumns(derive)
        .withColumn(following, F.lead(F.struct(*carry)).over(order))
        .where(F.col("_copy") == 0)
        .drop("_key", "_bucket", "_copy", "_place")
    )

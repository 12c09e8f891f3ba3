"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Sources share the total of all sizes by weight; none gets more than so many times its own size, and what is above goes to the others by
weight until none is above. A source first takes all its documents as many whole times as its target holds (complete epochs). The rest
is a weighted sample without replacement: a document's key is exponential with its quality weight as the rate, documents stand in the order of their keys, and
those whose running size stays within the rest (the last one by more than half) are taken once more.

Keys come from hashes of the seed, the document's key and its text: reruns agree, at any partitioning. A source may hold most rows, so no
task sorts a source: positions in [0, 1) follow the keys, sizes are summed by 1024 ranges of positions, and the range in which the rest
ends is divided again until it holds few documents; only those are ordered. Sums combine before the shuffle.

Edge cases: null texts have size 0 and nothing is taken from them. The null source is one of its own and the last. Null keys are
hashed as such. Rows alike in key and text stand side by side in that order; which of them is taken once more makes no difference.
A table without rows, or without words, gives zeros. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import SYMBOL, WORD
from .workspace import Workspace

#: Ranges of positions that a range is divided into, and documents that a last range holds about.
FAN, FEW = 1024, 256
#: Plans of up to so many sources and bytes of names go to all tasks; larger ones are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 1 << 20
MAX_ROUNDS = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cleanliness(text: Column, size: Column) -> Column:
    """A quality weight in (0, 1]: less the more symbols a text has for its words."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.when(size > 0, size / (size + 10 * symbols)).otherwise(F.lit(1.0))


def uniform(seed: int, key: Column, text: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighed(sources: DataFrame, weights: tuple[int, ...], work: Workspace) -> DataFrame:
    """sources (source, ...) with weight: the weights repeat along the sources in the order of their code points, null last.

    Ranks are a range's offset and the place within it, so sources are not ordered in one task.
    """
    ranges = work.table(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id()), "sources")
    counts = ranges.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")) - 1
    ranked = ranges.withColumn("_at", at).join(F.broadcast(counts.select("_range", "_before")), "_range")
    place = F.pmod(F.col("_before") + F.col("_at"), F.lit(len(weights))).cast("int")
    return ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).drop("_range", "_before", "_at")


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (source, source_size, weight) with target. A round shares what the full sources leave; each round's sums are one row."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    for _ in range(MAX_ROUNDS):
        row = sources.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        then = (total - row["c"]) / row["w"] if row["w"] else level
        if then == level:
            break
        level, full = then, F.lit(then) * F.col("weight") > most * F.col("source_size")
    else:
        raise RuntimeError("targets did not settle")
    own = F.lit(level if level is not None else 0.0).cast("double") * F.col("weight")
    return sources.withColumn("target", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(own))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, quality: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 13) -> DataFrame:
    """key, source, size, source_size, target, taken, epochs (long): taken is size times how often the mix takes the document.

    size defaults to words, quality (a positive rate; more is likelier) to cleanliness.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sized = docs.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("_text"), (n_words(F.col(text)) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), *([] if quality is None else [quality.cast("double").alias("_quality")]))
    rate = cleanliness(F.col("_text"), F.col("size")) if quality is None else F.greatest(F.coalesce("_quality", F.lit(1.0)), F.lit(1e-6))
    rows = work.table(sized.select(key, "source", "size", (-F.log(uniform(seed, F.col(key), F.col("_text"))) / rate).alias("_key")), "rows")
    position = F.least(1 - F.exp(-F.col("_key")), F.lit(1 - 1e-12))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = with_targets(weighed(sources, weights, work), most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    plan = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = work.table(plan.withColumns({"before": F.lit(0).cast("long"), "range": F.lit(0).cast("long")}), "plan")
    stats = plan.agg(F.count(F.lit(1)).alias("s"), F.sum(F.octet_length("source")).alias("b"), F.max("n").alias("n")).first()
    small = stats["s"] <= BROADCAST_SOURCES and (stats["b"] or 0) <= BROADCAST_BYTES

    def with_plan(plan: DataFrame) -> DataFrame:
        own = plan.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest", "before", "range")
        return rows.join(F.broadcast(own) if small else own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    parts, deep = 1, 1
    while parts * FEW < (stats["n"] or 0) or deep == 1:
        inside = with_plan(plan).where(F.floor(position * parts) == F.col("range"))
        parts, deep = parts * FAN, deep + 1
        sums = inside.groupBy("source", F.floor(position * parts).alias("_range")).agg(F.sum("size").alias("s"), F.first("before").alias("_from"), F.first("rest").alias("_rest"))
        running = F.col("_from") + F.sum("s").over(Window.partitionBy("source").orderBy("_range"))
        reached = sums.withColumn("_to", running).where(F.col("_to") >= F.col("_rest")).groupBy("source").agg(F.min_by(F.struct("_range", (F.col("_to") - F.col("s")).alias("_before")), "_range").alias("e"))
        edges = reached.select(F.col("source").alias("_source"), F.col("e._range").alias("_range"), F.col("e._before").alias("_before"))
        after = plan.drop("before", "range").join(edges, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        # a source whose sizes do not reach the rest (by rounding) is taken whole
        plan = work.table(after.select("*", F.coalesce("_before", F.lit(0)).alias("before"), F.coalesce("_range", F.lit(parts)).cast("long").alias("range")).drop("_before", "_range"), "plan")
    found = with_plan(plan).withColumn("_range", F.floor(position * parts))
    edge = found.where(F.col("_range") == F.col("range"))
    ordered = Window.partitionBy("source").orderBy("_key", key, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once_more = 2 * (F.col("before") + F.sum("size").over(ordered)) - F.col("size") <= 2 * F.col("rest")
    taken = lambda more: ((F.col("epochs") + more.cast("long")) * F.col("size")).alias("taken")
    out = [key, "source", "size", "source_size", "target"]
    away = found.where(F.col("_range") != F.col("range"))
    return away.select(*out, taken(F.col("_range") < F.col("range")), "epochs").union(edge.select(*out, taken(once_more), "epochs"))

"""Operators that the record pipelines share, as windows, joins and aggregates.

Ordering columns decide every "first" and "last"; give ones that are unique within a key, or results may vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A map-side aggregate: only the leading row of each key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(row).select(*[F.col(k) for k in keys], *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark turns the rank filter into a group limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_wins_merge(df: DataFrame, keys: list[str], order: str, fields: list[str], lists: list[str] = ()) -> DataFrame:
    """One row a key: of each field the first non-empty value in order, of each list the ordered union, and merged_count.

    Elements of lists are reduced to distinct ones (with their first place) before a key's come together, so a key with many rows
    sends what its result holds, not what its rows hold.
    """
    # min_by passes over rows whose ordering value is null
    filled = [F.min_by(c, F.when(F.trim(F.col(c).cast("string")) != "", F.col(order))).alias(c) for c in fields]
    out = df.groupBy(*keys).agg(F.min(order).alias(order), *filled, F.count(F.lit(1)).alias("merged_count"))
    for c in lists:
        long = df.select(*keys, F.col(order).alias("_o"), F.posexplode(c).alias("_at", "_v"))
        first = long.groupBy(*keys, "_v").agg(F.min(F.struct("_o", "_at")).alias("_first"))
        united = F.transform(F.array_sort(F.collect_list(F.struct("_first", "_v"))), lambda x: x["_v"])
        per = first.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(united.alias(c))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(per, same, "left").drop(*[f"_k{i}" for i in range(len(keys))]).withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return out.select(*keys, order, *fields, *lists, "merged_count")


def new_by_signature(batch: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of batch whose signature is neither in known nor earlier in batch."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
    return first.join(known.select(*keys), keys, "left_anti").select(*batch.columns)


def only_new(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been handled yet."""
    return df.join(done.select(*keys), keys, "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: str, first: str = "first_at") -> DataFrame:
    """One row a key: the values of its last row in order, at the place (first) of its first one. Combines before the shuffle.
    Of rows with equal order the one with the greatest values is the last; columns that have no order (maps) do not decide."""
    rest = [c for c in df.columns if c not in keys]
    decides = [c for c, kind in df.dtypes if c in rest and c != order and "map<" not in kind]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *decides)).alias("_last"), F.min(order).alias(first))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest if c != order], first)


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: Column, most: int) -> DataFrame:
    """Rows of each key while their running cost stays within most; the first one always stays. Costs are not negative."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"running_cost": running, "_rank": F.row_number().over(w)}).where((F.col("_rank") == 1) | (F.col("running_cost") <= most)).drop("_rank")


def chunk_by_cost(df: DataFrame, keys: list[str], order: str, cost: str, target: int, hard: int, most_items: int = 2_147_483_647) -> DataFrame:
    """Next-fit chunks of each key in order: a chunk ends before it would pass target (or most_items), or once it reaches hard.

    The fold is sequential by nature, so a key's (order, cost) pairs are folded as one array: a key's items, not a
    table's, have to fit a row. It gives the places where chunks start; the items take the last one before them. Orders
    are unique within a key. Adds chunk_no, from 1.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    nothing = F.array().cast(f"array<{dict(df.dtypes)[order]}>")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("items"), nothing.alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["items"] == 0) | (acc["used"] + x["c"] > F.lit(min(target, hard))) | (acc["items"] >= most_items)
        used = F.when(full, x["c"]).otherwise(acc["used"] + x["c"])
        count = F.when(full, F.lit(1)).otherwise(acc["items"] + 1)
        return F.struct(
            used.alias("used"),
            F.when(used >= hard, F.lit(0)).otherwise(count).alias("items"),
            F.when(full, F.array_append(acc["starts"], x["o"])).otherwise(acc["starts"]).alias("starts"),
        )

    starts = df.groupBy(*keys).agg(F.aggregate(items, start, step, lambda acc: acc["starts"]).alias("_starts")).select(*keys, F.posexplode("_starts").alias("_no", order))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(starts, [*keys, order], "left").withColumn("chunk_no", (F.last("_no", ignorenulls=True).over(w) + 1).cast("int")).drop("_no")


def islands(df: DataFrame, keys: list[str], order: list[str], joins_previous: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; joins_previous (a condition that may use lag) tells whether a row goes on with the run before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_starts", F.when(F.coalesce(joins_previous, F.lit(False)), 0).otherwise(1))
        .withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_starts")
    )


def stitch(df: DataFrame, keys: list[str], chunk: str, position: str, text: str, into_next: str, from_previous: str) -> DataFrame:
    """Clauses that were cut at chunk boundaries, joined again: a chunk's first clause goes on with the last one before it
    if that one continues and it says so too. Adds clause_no; text is joined by line breaks in order."""
    w = Window.partitionBy(*keys).orderBy(chunk, position)
    last = F.lead(chunk).over(w)
    marked = df.withColumn("_last", last.isNull() | (last != F.col(chunk)))
    w2 = Window.partitionBy(*keys).orderBy(chunk, position)
    first = F.coalesce(F.lag(chunk).over(w2) != F.col(chunk), F.lit(True))
    before = F.lag(F.col("_last") & F.coalesce(F.col(into_next), F.lit(False))).over(w2)
    marked = marked.withColumn("_joins", first & F.coalesce(F.col(from_previous), F.lit(False)) & F.coalesce(before, F.lit(False)))
    numbered = islands(marked, keys, [chunk, position], F.col("_joins"), "clause_no")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("c"), F.col(position).alias("p"), F.col(text).alias("t"))))
    return numbered.groupBy(*keys, "clause_no").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(text), F.count(F.lit(1)).alias("parts"))


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], head: int = 30, middle: int = 30, tail: int = 20, limit: int = 80, place: str = "place") -> DataFrame:
    """Of each key's rows, if they are more than limit, the first head, a stride through the middle and the last tail; all
    otherwise. Adds place, from 0. A key is something of bounded size, such as a document with its pages."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.col(place)
    stride = F.greatest(F.lit(1), F.floor((F.col("_total") - head - tail) / middle))
    inside = (at >= head) & (F.pmod(at - head, stride) == 0) & (F.floor((at - head) / stride) < middle)
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("_total", total)
    return numbered.where((F.col("_total") <= limit) | (at < head) | (at >= F.col("_total") - tail) | inside).drop("_total")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to the row itself."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def fingerprint(df: DataFrame, keys: list[str], fields: list[str], digits: int = 16) -> DataFrame:
    """A hash of each key's rows, as a multiset: it does not depend on their order. Row hashes are added up (two sums of 60 bits each, and
    the count), so rows of a key combine before the shuffle and never stand together."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    whole = F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(16))
    return df.groupBy(*keys).agg(F.substring(F.sha2(whole, 256), 1, digits).alias("fingerprint"))


def fallback_table(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """preferred, or other where preferred has no row at all."""
    some = preferred.limit(1).select(F.lit(1).alias("_some"))
    return preferred.unionByName(other.join(F.broadcast(some), F.lit(True), "left_anti"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, distinct."""
    return edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour"))).distinct()


def known_ids(df: DataFrame, keys: list[str], ids: str, known: DataFrame, id_column: str) -> DataFrame:
    """df with array column ids cut to those in known (order kept) and the others as unverified; both joined on exploded ids."""
    long = df.select(*keys, F.posexplode(ids).alias("_at", "_id")).join(known.select(F.col(id_column).alias("_id"), F.lit(True).alias("_known")).distinct(), "_id", "left")
    in_order = lambda hit: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("_at", "_id")))), lambda x: x["_id"]))
    sorted_out = long.groupBy(*keys).agg(in_order(F.col("_known").isNotNull()).alias("_good"), in_order(F.col("_known").isNull()).alias("unverified"))
    none = F.array().cast(df.schema[ids].dataType)
    return df.join(sorted_out, keys, "left").withColumns({ids: F.coalesce("_good", none), "unverified": F.coalesce("unverified", none)}).drop("_good")

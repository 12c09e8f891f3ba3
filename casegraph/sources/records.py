"""One current record a key, kept as Parquet in versions: writers that read an old version notice and merge again.

A version is a small manifest: where each bucket's records lie, and the last batch of each writer. A writer writes the records of
the buckets that it touches, then claims the next version by creating its manifest, which fails if another writer was faster; then
it reads what that one wrote and merges once more. So updates of different fields of one record are all kept, and a batch that is
replayed changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


class Conflict(RuntimeError):
    """Other writers were faster each time."""


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last version and its manifest."""
    p, fs = _folder(spark, f"{path}/versions")
    found = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    found = [n for n in found if n.isdigit()]
    if not found:
        return 0, {"buckets": {}, "applied": {}}
    text = spark.read.text(f"{path}/versions/{found[-1]}").first()
    return int(found[-1]), json.loads(text["value"])


def _claim(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Writes a version's manifest whole, under its name only if there is none: a link of names that only one writer gets."""
    p, fs = _folder(spark, f"{path}/versions/{version:012d}")
    hold, _ = _folder(spark, f"{path}/claims/{version:012d}")
    if not fs.createNewFile(hold):  # atomic: one writer a version
        return False
    part, _ = _folder(spark, f"{path}/claims/{version:012d}-manifest")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    return fs.rename(part, p) if fs.mkdirs(p.getParent()) else False


def read_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The current records; None before the first version."""
    _, manifest = _manifest(spark, path)
    folders = sorted(set(manifest["buckets"].values()))
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def update_records(spark: SparkSession, path: str, changes: DataFrame, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str = "", batch: int | None = None, tries: int = 20, pause: float = 0.2) -> bool:
    """Replaces the records of the keys in changes by merge(current records of the touched buckets, changes); False if this writer's batch
    was applied before. changes is read once more for each lost race, so it has to be repeatable (a table, a micro-batch).

    merge gets and gives one row a key; keys that changes does not name have to come back as they are.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    for n in range(tries):
        version, manifest = _manifest(spark, path)
        if batch is not None and manifest["applied"].get(writer, -1) >= batch:
            return False
        touched = sorted(r["b"] for r in changes.select(bucket.alias("b")).distinct().collect())
        old = sorted({manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]})
        current = spark.read.parquet(*[f"{path}/{f}" for f in old]) if old else None
        data = f"data/{uuid.uuid4().hex}"
        merged = merge(current, changes).withColumn("_bucket", bucket)
        merged.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{data}")
        then = {"buckets": manifest["buckets"] | {str(b): f"{data}/_bucket={b}" for b in touched}, "applied": manifest["applied"] | ({writer: batch} if batch is not None else {})}
        if _claim(spark, path, version + 1, then):
            return True
        p, fs = _folder(spark, f"{path}/{data}")
        fs.delete(p, True)
        time.sleep(pause * (n + 1))
    raise Conflict(f"{tries} tries of {path}")


def upsert_stream(stream: DataFrame, path: str, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str, checkpoint: str):
    """Each micro-batch as one update under its batch id: replays are recognised, other writers' updates are kept."""

    def put(batch: DataFrame, batch_id: int) -> None:
        update_records(batch.sparkSession, path, batch.persist(), key, merge, writer, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

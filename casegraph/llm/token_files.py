"""Token ids in files: one zstandard frame a document, a dictionary trained on serialized ids, an offset index.

A token file set is a folder with two Parquet tables. "dictionary" has one row: the dictionary's bytes, their SHA-256
and the width of an id. "shards" has a row of about SHARD_BYTES of frames: bucket (ranges of keys, ascending), shard
(ascending in a bucket), dictionary_sha256, keys, offsets (where each frame starts, and the end of the last), n_tokens,
first_token (tokens of the bucket before the shard) and data. Keys ascend through buckets, shards and within shards, so
one short document is found by its key's statistics and read alone.

Edge cases: a null text is empty; its ids are the end id alone. Null keys come last, in any order; equal keys stand in
the order of their frames. An empty table gives files without shards and an empty result. Too few or too alike
samples give no dictionary (its bytes are then empty, frames are plain). Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, in_batches
from .order import BELOW_ALL, bounds_of, bucket_of
from .words import library_encoder, read_model

SHARD_BYTES = 1 << 19
#: The dictionary is trained on so many documents at most, on so many bytes of each at most; it only affects sizes.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 14
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


def train(docs: DataFrame, text: str, path: str, width: int) -> bytes:
    """The dictionary's bytes; empty where none can be trained."""
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in batches:
            for texts in in_batches(batch.column(0).to_pylist()):
                serial = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()[:SAMPLE_BYTES] for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(serial, pa.binary())], ["ids"])

    share = min(1.0, 2.0 * SAMPLE_ROWS / max(total, 1))
    sample = [bytes(r["ids"]) for r in docs.select(text).sample(fraction=share, seed=7).limit(SAMPLE_ROWS).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in sample if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0) -> None:
    """Encode every text of docs, append end_id, and write the token files to folder in ascending key."""
    path = path or default_path()
    model = read_model(path)
    width = 2 if max([*model["vocab"].values(), *model["special"].values(), end_id]) < 1 << 16 else 4
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dictionary = train(rows, "text", path, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha, width)], "dictionary binary, sha256 string, width int").coalesce(1).write.parquet(f"{folder}/dictionary")
    end = np.array([end_id], f"<u{width}").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        press = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            at = 0
            for texts in in_batches(batch.column(2).to_pylist()):
                serial = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + end for x in encoder.encode(texts)]
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) // width for s in serial], pa.int64()), pa.array([press.compress(s) for s in serial], pa.binary())],
                    ["bucket", "key", "n_tokens", "frame"],
                )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        names = ["bucket", "shard", "dictionary_sha256", "keys", "offsets", "n_tokens", "first_token", "data"]
        bucket, shard, first, held, keys, counts, pieces = None, 0, 0, 0, [], [], []

        def out() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(p) for p in pieces]).tolist()]
            values = [bucket, shard, sha, list(keys), offsets, list(counts), first, b"".join(pieces)]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for b, k, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pieces and (b != bucket or held >= SHARD_BYTES):
                    yield out()
                    shard, first = (shard + 1, first + sum(counts)) if b == bucket else (0, 0)
                    held, keys, counts, pieces = 0, [], [], []
                bucket = b
                keys.append(k)
                counts.append(n)
                pieces.append(frame)
                held += len(frame)
        if pieces:
            yield out()

    # null keys are spread over buckets above all others: negated numbers below all keys
    spread = F.lit(-BELOW_ALL) + F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    placed = rows.withColumn("_order", F.coalesce("key", spread))
    bounds = bounds_of(placed, "_order", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = bucket_of(F.col("_order"), bounds) if bounds else F.lit(0)
    (
        placed.select(bucket.alias("bucket"), "key", "text")
        .mapInArrow(frames, "bucket int, key bigint, n_tokens bigint, frame binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket", F.col("key").asc_nulls_last(), "frame")
        .mapInArrow(shards, "bucket int, shard int, dictionary_sha256 string, keys array<bigint>, offsets array<bigint>, n_tokens array<bigint>, first_token bigint, data binary")
        .write.option("compression", "none")
        .parquet(f"{folder}/shards")
    )


def _dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    found = bytes(row["dictionary"])
    if hashlib.sha256(found).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary's hash doesn't match")
    return found, row["sha256"], row["width"]


def _documents(shard: dict, press: zstandard.ZstdDecompressor, sha: str, width: int, only: set | None = None) -> Iterator[tuple]:
    """(key, token where it starts in the bucket, ids) of a shard's documents, or of those in only."""
    if shard["dictionary_sha256"] != sha:
        raise ValueError("a shard was written with another dictionary")
    at = shard["first_token"]
    for i, (key, n) in enumerate(zip(shard["keys"], shard["n_tokens"], strict=True)):
        if only is None or key in only:
            raw = press.decompress(shard["data"][shard["offsets"][i] : shard["offsets"][i + 1]])
            yield key, at, np.frombuffer(raw, f"<u{width}").astype("<u4")
        at += n


def read(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """key, start (tokens of all documents before), n_tokens and ids (array<int>), or ids_crc32 instead of ids."""
    dictionary, sha, width = _dictionary(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    last = "ids_crc32 bigint" if checksums else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.slice(i, 1).to_pylist()[0]
                found = list(_documents(shard, press, sha, width))
                ids = pa.array([zlib.crc32(d.tobytes()) for _, _, d in found], pa.int64()) if checksums else pa.array([d.astype(np.int32) for _, _, d in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard["bucket"]] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int64()), pa.array([s for _, s, _ in found], pa.int64()), pa.array([len(d) for _, _, d in found], pa.int64()), ids],
                    ["bucket", "key", "start_in_bucket", "n_tokens", last.split()[0]],
                )

    # as many rows as there are buckets (order.MAX_BUCKETS and one at most), whatever the number of documents
    sizes = shards.groupBy("bucket").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    columns = "bucket int, key bigint, start_in_bucket bigint, n_tokens bigint, " + last
    return (
        shards.mapInArrow(run, columns)
        .join(F.broadcast(starts), "bucket")
        .select("key", (F.col("_start") + F.col("start_in_bucket")).alias("start"), "n_tokens", last.split()[0])
    )


def fetch(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents: only their shards are read, only their frames are decompressed."""
    dictionary, sha, width = _dictionary(spark, folder)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    wanted = F.array(*[F.lit(k).cast("long") for k in keys])
    rows = spark.read.parquet(f"{folder}/shards").where(F.arrays_overlap("keys", wanted)).collect()
    return {key: ids.tolist() for r in rows for key, _, ids in _documents(r.asDict(), press, sha, width, set(keys))}

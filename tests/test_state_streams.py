"""Streams in several micro-batches against the batch operators; records with two writers."""

import threading

import pytest
from pyspark.sql import functions as F

from casegraph.operators import workflow
from casegraph.sources import records
from casegraph.streaming import folds

EVENTS = "case_id long, stage string, status string, error string, job_id string, at long"


def stage_events(n=240):
    kinds = ["running", "completed", "error", "ready", None]
    return [(i % 7, f"s{i % 3}", kinds[(i * i + i // 5) % 5], "failed" if (i * i + i // 5) % 5 == 2 else None, f"j{i}" if i % 4 else None, (i * 37) % n) for i in range(n)]


def in_batches(spark, rows, schema, folder, parts):
    for p in range(parts):
        spark.createDataFrame(rows[p::parts], schema).coalesce(1).write.parquet(f"{folder}/part{p}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_stage_fold_of_three_batches(spark, tmp_path):
    folds.state_store(spark)
    rows = stage_events()
    stream = folds.folded_stages(in_batches(spark, rows, EVENTS, tmp_path / "in", 3), ["case_id"])
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, b: seen.extend((b, r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None and {b for b, _ in seen} == {0, 1, 2}
    last = {(r["case_id"], r["stage"]): r for _, r in seen}
    want = workflow.merge_stage_events(spark.createDataFrame(rows, EVENTS), ["case_id"], ["at"]).collect()
    fields = ["status", "started_at", "finished_at", "updated_at", "error", "job_id"]
    assert {k: tuple(r[f] for f in fields) for k, r in last.items()} == {(r["case_id"], r["stage"]): tuple(r[f] for f in fields) for r in want}


def test_a_run_that_nothing_ends_is_interrupted(spark, tmp_path):
    folds.state_store(spark)
    rows = [(1, "s", "running", None, "j", 1), (2, "s", "completed", None, None, 1), (3, "s", "completed", None, None, 2)]
    stream = folds.folded_stages(in_batches(spark, rows, EVENTS, tmp_path / "in", 3), ["case_id"], run_ms=0)
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, b: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    of_first = [r for r in seen if r["case_id"] == 1]
    assert [r["status"] for r in of_first] == ["running", "error"] and of_first[-1]["error"] == workflow.INTERRUPTED and of_first[-1]["job_id"] is None


def test_stream_join_equals_batch_join(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 {(i * 7 % 600) // 60:02d}:{i * 7 % 60:02d}:00") for i in range(120)]
    rows.sort(key=lambda r: r[2])
    schema = "id long, k long, ts string"
    for side, pick in (("a", 0), ("b", 1)):
        for p in range(3):
            chunk = [r for r in rows[p * 40 : (p + 1) * 40] if r[0] % 2 == pick]
            spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / side / f"part{p}"))
    read = lambda side: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / side))
    shape = lambda df, i, t: df.select(F.col("id").alias(i), "k", F.col("ts").cast("timestamp").alias(t))
    a, b = shape(read("a"), "a", "at"), shape(read("b"), "b", "bt")
    seen = []
    q = folds.followed(a, b, ["k"], "at", "bt", "40 MINUTES", "20 minutes").writeStream.foreachBatch(lambda df, n: seen.extend((r["a"], r["b"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    whole = spark.createDataFrame(rows, schema)
    batch = folds.followed(shape(whole.where("id % 2 = 0"), "a", "at"), shape(whole.where("id % 2 = 1"), "b", "bt"), ["k"], "at", "bt", "40 MINUTES", "20 minutes")
    assert sorted(seen) == sorted((r["a"], r["b"]) for r in batch.collect()) and len(seen) > 20
    assert kept < len(rows) / 2  # the bound and the watermark let go of what can't match any more


def put(current, changes):
    if current is None:
        return changes
    both = current.alias("o").join(changes.alias("n"), "k", "full_outer")
    return both.select("k", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("a", "b")])


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "state"), []
    shape = "k long, a long, b long"

    def write(name):
        try:
            for n in range(4):
                rows = [(k, n if name == "a" else None, n if name == "b" else None) for k in range(3)] + [(100 + 10 * n + (name == "b"), n, n)]
                assert records.update_records(spark, path, spark.createDataFrame(rows, shape), "k", put, name, n)
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(200)
    assert not failed
    found = {r["k"]: (r["a"], r["b"]) for r in records.read_records(spark, path).collect()}
    assert found == {0: (3, 3), 1: (3, 3), 2: (3, 3)} | {100 + 10 * n + s: (n, n) for n in range(4) for s in (0, 1)}
    # a batch that comes again changes nothing
    assert not records.update_records(spark, path, spark.createDataFrame([(0, 9, 9)], shape), "k", put, "a", 3)
    assert records.read_records(spark, path).where("k = 0").first()["a"] == 3
    with pytest.raises(records.Conflict):
        records.update_records(spark, path, spark.createDataFrame([(0, 9, 9)], shape), "k", put, "a", 4, tries=0)


def test_upsert_stream_replays(spark, tmp_path):
    rows, path = [(i % 5, i, None) for i in range(30)], str(tmp_path / "state")
    shape = "k long, a long, b long"
    latest = lambda current, changes: (changes if current is None else current.unionByName(changes)).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    for attempt in range(2):  # the second run has lost its checkpoint: the same batch ids come again
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")) if attempt else in_batches(spark, rows, shape, tmp_path / "in", 2)
        q = records.upsert_stream(stream, path, "k", latest, "w", str(tmp_path / f"check{attempt}"))
        q.awaitTermination(200)
        assert q.exception() is None
    assert {r["k"]: r["a"] for r in records.read_records(spark, path).collect()} == {k: 25 + k for k in range(5)}
    assert records._manifest(spark, path)[0] == 2

"""Streams in several micro-batches against their batch forms."""

import random

from pyspark.sql import functions as F

from glyphfold.operators import sequences as S
from glyphfold.plans import views
from glyphfold.sources.corpus import read_table
from glyphfold.streaming import commands as C
from glyphfold.streaming import timeouts as T

from conftest import SMALL


def drained(spark, stream, folder):
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_command_stream_in_micro_batches(spark, tmp_path):
    events = read_table(spark, SMALL, "events")
    source = str(tmp_path / "in")
    # Files in time order; the file source reads the oldest first, one per batch.
    for part in range(4):
        events.filter(F.floor(F.col("event_id") * 4 / 1000) == part).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKSDB)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drained(spark, C.command_stream(views.commands_of(stream)), tmp_path)
    want = C.replay_commands(views.commands_of(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_timeout_stream(spark, tmp_path):
    rng = random.Random(8)
    # Event time 0 would count as late: watermarks start there.
    reqs = [(1, i, 1000 + i * 10) for i in range(40)] + [(1, 999, 100_000)]
    resp = [(i, 1000 + i * 10 + rng.choice([5, 29, 30, 45])) for i in range(40) if i % 3] + [(998, 100_000)]
    spark.createDataFrame(reqs, "worker bigint, req_id bigint, s bigint").select(
        "worker", "req_id", F.timestamp_seconds("s").alias("ts")
    ).coalesce(1).write.parquet(str(tmp_path / "req"))
    spark.createDataFrame(resp, "req_id bigint, s bigint").select(
        "req_id", F.timestamp_seconds("s").alias("resp_ts")
    ).coalesce(1).write.parquet(str(tmp_path / "resp"))
    r = spark.readStream.schema("worker bigint, req_id bigint, ts timestamp").parquet(str(tmp_path / "req"))
    a = spark.readStream.schema("req_id bigint, resp_ts timestamp").parquet(str(tmp_path / "resp"))
    got = drained(spark, T.timeout_stream(r, a), tmp_path)
    seen = {x.req_id: x.resp_ts is not None for x in got.filter("req_id < 900").collect()}
    answer = dict(resp)
    assert seen == {i: i in answer and answer[i] < 1000 + i * 10 + 30 for i in range(40)}


def test_admission_limits_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 3 t", "id o", "id hash", "1.0D size", "true allowed")
    out = S.admit(df, "t", "o", 10.0, 32, 1000.0)
    assert out.filter("outcome = 'ADMITTED'").count() == 96
    from pyspark.sql import Window

    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy("o"))).filter("_r <= 1000")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def batches_of(spark, rows, ddl, folder, parts):
    """A stream of ``rows``, as many micro-batches as ``parts``, in their order."""
    size = -(-len(rows) // parts)
    for part in range(parts):
        some = rows[part * size : (part + 1) * size]
        if some:
            spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


def test_worker_timeouts_in_micro_batches(spark, tmp_path):
    rng = random.Random(12)
    traffic, answers = [], {}
    for i in range(240):
        worker, sent = rng.choice([1, 1, 2, 3]), 1_000 + i * 4 + rng.randint(0, 3)
        traffic.append((worker, i, sent, False))
        if rng.random() < 0.8:
            answers[i] = sent + rng.choice([0, 3, 17, 29, 30, 31])
            traffic.append((worker, i, answers[i], True))
    # Answers may arrive before their requests, and all kinds may be late by less than the watermark allows.
    traffic.sort(key=lambda r: r[2] + rng.randint(0, 50))
    traffic.append((9, 9_999, 900_000, True))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKSDB)
    stream = batches_of(spark, traffic, "worker bigint, req_id bigint, s bigint, answer boolean", str(tmp_path / "in"), 5)
    timed = stream.select("worker", "req_id", F.timestamp_seconds("s").alias("at"), "answer")
    got = drained(spark, T.worker_timeouts(timed, "60 seconds", 30), tmp_path)
    requests = spark.createDataFrame([r[:3] for r in traffic if not r[3]], "worker bigint, req_id bigint, s bigint")
    responses = spark.createDataFrame(list(answers.items()), "req_id bigint, s bigint")
    want = T.detect_timeouts(
        requests.select("worker", "req_id", F.timestamp_seconds("s").alias("ts")),
        responses.select("req_id", F.timestamp_seconds("s").alias("resp_ts")),
        30,
    )
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect()))
    assert {r[2] for r in rows} == {"ANSWERED", "TIMEOUT", "WORKER_TIMEOUT"}


COMMAND_DDL = (
    "doc_id bigint, seq bigint, ts bigint, op string, expected_revision bigint, candidate string, content_hash string, "
    "command_hash string, valid boolean"
)


def test_a_replaced_candidate_is_stale(spark, tmp_path):
    def row(seq, op, expected=0, candidate=None, content=None, valid=True):
        return (1, seq, seq, op, expected, candidate, content, "c", valid)

    rows = [
        row(0, "stage"),
        row(1, "open", content="h0"),
        row(2, "stage", content="h1"),
        row(3, "stage", content="h2"),
        row(4, "validate", 0, "candidate:1:h1", "h1"),  # replaced
        row(5, "validate", 0, "candidate:1:h2", "h1"),  # the old content under the new id
        row(6, "validate", 0, "candidate:1:h2", "h2", False),
        row(7, "validate", 0, "candidate:1:h2", "h2"),  # gone with its failure
        row(8, "stage", content="h3"),
        row(9, "validate", 0, "candidate:1:h3", "h3"),
        row(10, "export", 0),
        row(11, "export", 1),
        row(12, "export", 1),
        row(13, "close", 1),
        row(14, "stage", 1),
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKSDB)
    got = drained(spark, C.staging_stream(batches_of(spark, rows, COMMAND_DDL, str(tmp_path / "in"), 4)), tmp_path)
    seen = {r.seq: r for r in got.collect()}
    stale = "STALE_REVISION"
    want = [stale, "OPENED", "STAGED", "STAGED", stale, stale, "VALIDATION_FAILURE", stale, "STAGED", "VALIDATED", stale, "EXPORTED", "VALIDATION_FAILURE", "CLOSED", stale]
    assert [seen[i].outcome for i in range(15)] == want
    assert (seen[3].candidate, seen[3].content_hash) == ("candidate:1:h2", "h0") and (seen[9].revision, seen[9].content_hash) == (1, "h3")


class Kept:
    """A map state in memory, which counts what it holds at most."""

    def __init__(self):
        self.held, self.most, self.cleared = {}, 0, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.most = max(self.most, len(self.held))

    def getValue(self, key):
        return self.held[key]

    def clear(self):
        self.held, self.cleared = {}, self.cleared + 1


def test_rows_of_a_key_are_ordered_without_being_held_together():
    import pandas as pd

    rng = random.Random(2)
    rows = [(rng.randint(0, 500), i, f"x{i}") for i in range(9_500)]
    frames = [pd.DataFrame(rows[i : i + 700], columns=["ts", "seq", "v"]) for i in range(0, len(rows), 700)]
    spill = Kept()
    got = list(C.rows_in_order(iter(frames), ["ts", "seq"], spill, held=1_500))
    assert got == sorted(rows) and spill.most > 5 and not spill.held
    small = Kept()
    assert list(C.rows_in_order(iter(frames[:1]), ["ts", "seq"], small)) == sorted(rows[:700]) and not small.most
    assert list(C.rows_in_order(iter([]), ["ts"], small)) == []


def test_stale_results_in_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), i, rng.randint(0, 40) if i % 5 else i // 20) for i in range(400)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKSDB)
    stream = batches_of(spark, rows, "k bigint, o bigint, g bigint", str(tmp_path / "in"), 3)
    got = drained(spark, T.drop_stale_stream(stream, "k", "g", ["o"]), tmp_path)
    want = T.drop_stale(spark.createDataFrame(rows, "k bigint, o bigint, g bigint"), ["k"], ["o"], "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_copies_pass_again_beyond_the_horizon(spark, tmp_path):
    """State of a content ends with the horizon: a copy inside it is dropped, one after the watermark has passed it is not."""
    rows = [("a", 1_000), ("b", 1_010), ("a", 1_500), ("a", 4_000), ("c", 9_000), ("c", 9_001), ("a", 60_000), ("z", 200_000), ("y", 200_500), ("a", 200_501)]
    stream = batches_of(spark, rows, "text string, s bigint", str(tmp_path / "in"), len(rows))
    timed = stream.select("text", F.timestamp_seconds("s").alias("at"))
    got = drained(spark, T.dedupe_stream(timed, "text", "at", "3600 seconds"), tmp_path)
    seen = sorted((r.text, int(r.at.timestamp())) for r in got.collect())
    assert seen == [("a", 1_000), ("a", 60_000), ("a", 200_501), ("b", 1_010), ("c", 9_000), ("y", 200_500), ("z", 200_000)]

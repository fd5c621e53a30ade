"""Request timeouts (STR2), stale results (STR3), content de-duplication (STR4)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphfold.operators.ordered import HOT_ROWS, Sequence, assign_blocks, block_starts, fold_sorted
from glyphfold.session import broadcast_if_small
from glyphfold.streaming.commands import ROWS_OUT, SPILL_KEY, SPILL_VALUE, rows_in_order

LIMIT_SECONDS = 30


def answered(requests: DataFrame, responses: DataFrame, limit_seconds: int = LIMIT_SECONDS) -> DataFrame:
    """STR2: requests with the first answer inside the limit (null when none).

    requests: worker, req_id, ts; responses: req_id, resp_ts.  A plain equality
    join, so it runs as it is on streams with watermarks on both times.
    """
    r = responses.select(F.col("req_id").alias("_id"), "resp_ts")
    span = F.expr(f"INTERVAL {limit_seconds} SECONDS")
    return requests.join(
        r, (F.col("req_id") == F.col("_id")) & (F.col("resp_ts") >= F.col("ts")) & (F.col("resp_ts") < F.col("ts") + span), "left"
    ).drop("_id")


def timeout_stream(requests: DataFrame, responses: DataFrame, delay: str = "1 minute", limit_seconds: int = LIMIT_SECONDS) -> DataFrame:
    """STR2 on streams: left outer interval join; an unanswered request comes out
    with a null ``resp_ts`` once the watermark has passed its limit."""
    return answered(requests.withWatermark("ts", delay), responses.withWatermark("resp_ts", delay), limit_seconds)


def detect_timeouts(
    requests: DataFrame, responses: DataFrame, limit_seconds: int = LIMIT_SECONDS, max_group_rows: int = HOT_ROWS
) -> DataFrame:
    """STR2: outcome per request: ANSWERED, TIMEOUT or WORKER_TIMEOUT.

    A timeout ends the worker and with it every request pending there; those
    never reach a timeout of their own.  So the timeouts that take effect form
    a chain per worker: the next one belongs to the first unanswered request
    sent at or after the last one.  Only the send times of unanswered requests
    are folded.  A worker with very many of them is cut into blocks of time; a
    block is described by its first ``limit`` seconds, because an incoming
    timeout cannot reach further.
    """
    span = limit_seconds * 1_000_000
    first = answered(requests, responses, limit_seconds).groupBy("worker", "req_id").agg(
        F.min("ts").alias("ts"), F.min("resp_ts").alias("resp_ts")
    )
    timed = first.withColumns(
        {
            "t": F.unix_micros(F.col("ts").cast("timestamp")),
            "answer": F.unix_micros(F.col("resp_ts").cast("timestamp")),
        }
    )
    silent = timed.filter("answer is null").select("worker", "t").distinct()
    worker_type = dict(requests.dtypes)["worker"]

    def advance(last: int | None, t: int) -> tuple[int | None, tuple]:
        if last is None or t >= last:
            return t + span, (t + span,)
        return last, (None,)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = sorted(pdf["t"].tolist())
        # Where the chain ends when it starts at position i, from the back.
        ends, nxt = [0] * len(times), len(times)
        for i in range(len(times) - 1, -1, -1):
            while nxt > i + 1 and times[nxt - 1] >= times[i] + span:
                nxt -= 1
            ends[i] = ends[nxt] if nxt < len(times) else times[i] + span
        near = sum(1 for t in times if t < times[0] + span)
        text = json.dumps([[times[i], ends[i]] for i in range(min(near + 1, len(times)))])
        return pd.DataFrame([[pdf["worker"].iloc[0], pdf["_block"].iloc[0], text]], columns=["worker", "_block", "jumps"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        last, rows = None, []
        for worker, block, jumps in pdf.sort_values("_block")[["worker", "_block", "jumps"]].itertuples(index=False):
            rows.append((worker, block, json.dumps(last)))
            last = next((end for t, end in json.loads(jumps) if last is None or t >= last), last)
        return pd.DataFrame(rows, columns=["worker", "_block", "last"])

    blocked, hot = assign_blocks(silent, ["worker"], ["t"], max_group_rows)
    outputs = "at bigint"
    if not hot:
        folded = fold_sorted(silent, ["worker"], ["t"], ["worker"], ["t"], advance, outputs)
    else:
        starts = block_starts(
            blocked,
            ["worker"],
            summarise,
            f"worker {worker_type}, _block int, jumps string",
            chain,
            f"worker {worker_type}, _block int, last string",
        )
        joined = blocked.join(broadcast_if_small(starts), ["worker", "_block"], "left")
        folded = fold_sorted(
            joined,
            ["worker", "_block"],
            ["t"],
            ["worker"],
            ["t"],
            advance,
            outputs,
            start=lambda text: json.loads(text) if text else None,
            start_col="last",
        )
    # The first effective timeout after a request was sent, by a merge in time order.
    marks = folded.filter("at is not null").select(
        "worker", F.col("at").alias("_t"), F.lit(0).alias("_side"), F.col("at").alias("_at")
    )
    asked = timed.select("worker", F.col("t").alias("_t"), F.lit(1).alias("_side"), "req_id", "answer")
    merged = asked.unionByName(marks, allowMissingColumns=True)
    seq = Sequence(merged, ["worker"], ["_t", "_side", "req_id"], max_group_rows).next_known("_next", F.col("_at"))
    hit = F.col("_next")
    own = F.col("answer").isNull() & (hit == F.col("_t") + span)
    return seq.done().filter("_side = 1").select(
        "worker",
        "req_id",
        F.when(own, "TIMEOUT")
        .when(hit.isNotNull() & (F.col("answer").isNull() | (F.col("answer") > hit)), "WORKER_TIMEOUT")
        .otherwise("ANSWERED")
        .alias("outcome"),
    )


def drop_stale(results: DataFrame, keys: list[str], order: list[str], generation: str, max_group_rows: int | None = None) -> DataFrame:
    """STR3 in batch: keep results of the newest generation seen so far."""
    seq = Sequence(results, keys, order, max_group_rows).running_max("_newest", F.col(generation))
    return seq.done().filter(F.col(generation) == F.col("_newest")).drop("_newest")


class NewestProcessor(StatefulProcessor):
    """STR3: the newest generation of a key is its state."""

    def __init__(self, columns: list[str], generation: str, order: list[str]) -> None:
        self._columns, self._generation, self._order = columns, generation, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "generation bigint")
        self._spill = handle.getMapState("spill", SPILL_KEY, SPILL_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self._newest.get()[0] if self._newest.exists() else None
        at = self._columns.index(self._generation)
        out: list[tuple] = []
        for row in rows_in_order((pdf[self._columns] for pdf in rows), self._order, self._spill):
            if newest is None or row[at] >= newest:
                newest = int(row[at])
                out.append(row)
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=self._columns)
                    out = []
        if newest is not None:
            self._newest.update((newest,))
        yield pd.DataFrame(out, columns=self._columns)

    def close(self) -> None:
        pass


def drop_stale_stream(results: DataFrame, key: str, generation: str, order: list[str]) -> DataFrame:
    """STR3 on a stream: state per key is the newest generation.  Needs the RocksDB state store."""
    processor = NewestProcessor(results.columns, generation, list(order))
    return results.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=results.schema, outputMode="Append", timeMode="None"
    )


class TimeoutProcessor(StatefulProcessor):
    """STR2: what is pending at a worker, and one timer for the earliest limit among it.

    Requests and answers wait in the state until the watermark has passed them,
    so that they take effect in the order of their times, however they arrive.
    An answer inside the limit resolves its request.  When the limit of a pending
    request is reached the worker is gone: that request is a TIMEOUT, all others
    pending there are WORKER_TIMEOUT, and the next request starts a new worker.
    """

    def __init__(self, span: int) -> None:
        self._span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # What is known of each undecided request; an answer may come before its request.
        self._known = handle.getMapState("known", "req_id bigint", "sent bigint, answer bigint")
        self._timer = handle.getValueState("timer", "due bigint")

    def _decide(self, key: tuple, upto: int) -> tuple[list[tuple], int | None]:
        """Outcomes that are settled at ``upto``, and when to look again.

        Nothing that happened until then can still arrive.
        """
        waiting: list[tuple[int, int, int | None]] = []
        ahead: list[int] = []
        for (req,), (sent, answer) in list(self._known.iterator()):
            if sent is None:
                # An answer to nothing: a request is not sent after it.
                if answer <= upto:
                    self._known.removeKey((req,))
                else:
                    ahead.append(answer)
            else:
                inside = answer is not None and sent <= answer < sent + self._span
                waiting.append((sent, req, answer if inside else None))
        waiting.sort(key=lambda w: w[:2])
        out: list[tuple] = []

        def settle(req: int, outcome: str) -> None:
            out.append((*key, req, outcome))
            self._known.removeKey((req,))

        while True:
            fires = next((sent + self._span for sent, _, answer in waiting if answer is None), None)
            if fires is None or fires > upto:
                break
            for sent, req, answer in [w for w in waiting if w[0] < fires]:
                if answer is None and sent + self._span == fires:
                    settle(req, "TIMEOUT")
                else:
                    settle(req, "ANSWERED" if answer is not None and answer <= fires else "WORKER_TIMEOUT")
            waiting = [w for w in waiting if w[0] >= fires]
        # No timer fires before the earliest limit of what is silent so far, so earlier answers stand.
        safe = upto if fires is None else min(upto, fires)
        for _, req, answer in waiting:
            if answer is not None and answer <= safe:
                settle(req, "ANSWERED")
        ahead += [sent + self._span if answer is None else answer for sent, _, answer in waiting if answer is None or answer > safe]
        return out, min(ahead) if ahead else None

    def _rest(self, out: list[tuple], at: int | None) -> pd.DataFrame:
        if self._timer.exists():
            self._handle.deleteTimer(int(self._timer.get()[0]))
            self._timer.clear()
        if at is not None:
            # Timers count milliseconds; a millisecond too late does no harm.
            due = at // 1_000 + 1
            self._handle.registerTimer(due)
            self._timer.update((due,))
        return pd.DataFrame(out, columns=["worker", "req_id", "outcome"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for req, at, is_answer in pdf[["req_id", "micros", "answer"]].itertuples(index=False, name=None):
                name = (int(req),)
                sent, answer = self._known.getValue(name) if self._known.containsKey(name) else (None, None)
                if is_answer:
                    answer = int(at) if answer is None else min(int(answer), int(at))
                else:
                    sent = int(at) if sent is None else min(int(sent), int(at))
                self._known.updateValue(name, (sent, answer))
        yield self._rest(*self._decide(key, timerValues.getCurrentWatermarkInMs() * 1_000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.clear()
        yield self._rest(*self._decide(key, timerValues.getCurrentWatermarkInMs() * 1_000))

    def close(self) -> None:
        pass


def worker_timeouts(traffic: DataFrame, delay: str = "1 minute", limit_seconds: int = LIMIT_SECONDS) -> DataFrame:
    """STR2 on a stream: the outcomes of :func:`detect_timeouts`, each once the watermark has passed it.

    traffic: worker, req_id, at (timestamp), answer (boolean: an answer to the
    request, else the request itself).  Both kinds are one stream, so that a
    worker's state sees them all.  Needs the RocksDB state store.
    """
    sides = traffic.withWatermark("at", delay).select("worker", "req_id", "at", F.unix_micros("at").alias("micros"), "answer")
    worker = dict(traffic.dtypes)["worker"]
    return sides.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=TimeoutProcessor(limit_seconds * 1_000_000),
        outputStructType=f"worker {worker}, req_id bigint, outcome string",
        outputMode="Append",
        timeMode="EventTime",
    )


def dedupe_by_hash(df: DataFrame, content: str, order: str) -> DataFrame:
    """STR4 in batch: the first registration of each content, by digest.

    A minimum per digest combines map-side, so very many copies of one content
    cost one row per task; the winners' rows come back by a join on their id.
    """
    digests = df.select(order, F.sha2(content, 256).alias("sha256"))
    firsts = digests.groupBy("sha256").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
    return df.join(firsts, order)


def dedupe_stream(df: DataFrame, content: str, time: str, horizon: str) -> DataFrame:
    """STR4 on a stream: bounded state, so a copy later than the horizon passes again."""
    return df.withColumn("sha256", F.sha2(content, 256)).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["sha256"])

"""Revision-gated commands in batch (RDX12) and as a stream (STR1)."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphfold.operators.ordered import HOT_ROWS, assign_blocks, fold_sorted
from glyphfold.session import broadcast_if_small, cut_lineage
from glyphfold.streaming.machine import State, describe, step

OUTCOMES = "doc_id bigint, seq bigint, op string, outcome string, revision bigint"
OUTCOME_NAMES = [part.split()[0] for part in OUTCOMES.split(",")]
#: Rows that a stateful task hands on at once.
ROWS_OUT = 10_000


def _rows(pdf: pd.DataFrame) -> list[tuple[str, int, bool]]:
    return list(zip(pdf["op"], pdf["expected_revision"].astype(int), pdf["valid"].astype(bool)))


#: States as one number: no session, and the rule for all states that a block does not name.
_NONE, _ANY = -1, -2


def _code(state: State) -> int:
    return _NONE if state is None else state[0] * 4 + state[1] * 2 + state[2]


def _state(code: int | None) -> State:
    return None if code is None or code == _NONE else (code // 4, bool(code & 2), bool(code & 1))


def _block_functions(blocked: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, _block, s, t: what a block makes of state ``s``, one row each; other states go to the ``_ANY`` row's or stay."""

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        fate, rest = describe(_rows(pdf.sort_values(order)))
        pairs = [(_code(s), _code(t)) for s, t in fate.items()]
        if rest != "same":
            pairs.append((_ANY, _code(rest)))
        out = pd.DataFrame(pairs, columns=["s", "t"], dtype="int64")
        out.insert(0, "_block", int(pdf["_block"].iloc[0]))
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out

    return blocked.groupBy("doc_id", "_block").applyInPandas(rows_of, "doc_id bigint, _block int, s bigint, t bigint")


def _start_states(blocked: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, _block, start: the state that each block of a hot document starts from.

    The functions of all blocks are a graph: a state leads from the block it
    leaves to the next block that changes it.  Steps are doubled (two, four,
    eight blocks), so that the one path from the first block is found in as many
    rounds as the number of blocks has binary digits.  All of it is joins of
    narrow rows; no task holds a document's functions.  States that no block
    leaves in are dropped first, which leaves a few for each block where revisions follow each other.
    """
    hot = blocked.filter("_block >= 0")
    functions = cut_lineage(_block_functions(hot, order))
    blocks = cut_lineage(hot.select("doc_id", "_block").distinct())
    # What never comes out of a block cannot go into one.
    images = functions.select("doc_id", F.col("t").alias("s")).distinct()
    alive = functions.filter(F.col("s") >= 0).join(images, ["doc_id", "s"], "left_semi").unionByName(functions.filter(F.col("s") < 0))
    nodes = cut_lineage(alive.select("doc_id", "_block", "s", "t"))
    # The next block that names a state, by a merge of those that name it and those that ask.
    before = blocks.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("_block"), F.lit(_NONE).cast("long").alias("t"))
    asked = nodes.select("doc_id", "_block", "t").distinct().unionByName(before)
    named = nodes.filter(F.col("s") != _ANY).select("doc_id", "_block", F.col("s").alias("t"), F.lit(0).alias("_side"))
    merged = named.unionByName(asked.withColumn("_side", F.lit(1)))
    ahead = Window.partitionBy("doc_id", "t").orderBy("_block", "_side").rowsBetween(1, Window.unboundedFollowing)
    naming = F.first(F.when(F.col("_side") == 0, F.col("_block")), ignorenulls=True).over(ahead)
    # The next block with a rule for all states: one row for each block.
    rules = nodes.filter(F.col("s") == _ANY).select("doc_id", F.col("_block").alias("_rule"))
    all_blocks = blocks.unionByName(before.select("doc_id", "_block"))
    following = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    ruled = all_blocks.join(rules.withColumnRenamed("_rule", "_block").withColumn("_r", F.lit(True)), ["doc_id", "_block"], "left")
    ruled = ruled.select("doc_id", "_block", F.first(F.when(F.col("_r"), F.col("_block")), ignorenulls=True).over(following).alias("_rule"))
    next_of = merged.withColumn("_named", naming).filter("_side = 1").join(ruled, ["doc_id", "_block"])
    by_name = F.col("_named").isNotNull() & (F.col("_rule").isNull() | (F.col("_named") <= F.col("_rule")))
    target = F.when(by_name, F.struct(F.col("_named").alias("b"), F.col("t").alias("s"))).when(
        F.col("_rule").isNotNull(), F.struct(F.col("_rule").alias("b"), F.lit(_ANY).cast("long").alias("s"))
    )
    steps = cut_lineage(next_of.withColumn("_to", target).filter("_to is not null").select("doc_id", "_block", "t", "_to.b", F.col("_to.s").alias("s1")))
    path = cut_lineage(steps.filter("_block = -1").select("doc_id", F.col("b").alias("_block"), F.col("s1").alias("s")))
    jump = nodes.join(steps, ["doc_id", "_block", "t"]).select("doc_id", "_block", "s", "b", "s1")
    longest = blocks.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    jumps = []
    for k in range(longest.bit_length()):
        jumps.append(cut_lineage(jump))
        if k + 1 < longest.bit_length():
            onward = jumps[-1].select("doc_id", F.col("_block").alias("b"), F.col("s").alias("s1"), F.col("b").alias("b2"), F.col("s1").alias("s2"))
            jump = jumps[-1].join(onward, ["doc_id", "b", "s1"]).select("doc_id", "_block", "s", F.col("b2").alias("b"), F.col("s2").alias("s1"))
    # Every distance along the path is a sum of powers of two; one node for each block at most.
    for jump in reversed(jumps):
        on = jump.join(broadcast_if_small(path), ["doc_id", "_block", "s"]).select("doc_id", F.col("b").alias("_block"), F.col("s1").alias("s"))
        path = cut_lineage(path.unionByName(on).distinct())
    left = nodes.join(broadcast_if_small(path), ["doc_id", "_block", "s"]).select("doc_id", "_block", "t")
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    joined = blocks.join(left, ["doc_id", "_block"], "left")
    return cut_lineage(joined.select("doc_id", "_block", F.last("t", ignorenulls=True).over(earlier).alias("start")))


def replay_commands(commands: DataFrame, max_group_rows: int = HOT_ROWS) -> DataFrame:
    """RDX12: outcome and revision (-1 = no session) after every command.

    commands: doc_id, ts, seq (unique), op, expected_revision, valid.  The
    commands of a document are one fold in order.  A document with more than
    ``max_group_rows`` commands is cut into blocks that are folded apart: a
    block is first described as a function of the states its commands name, the
    functions are composed by doubling, and every block then starts from its own state.
    """
    order = ["ts", "seq"]
    blocked, hot = assign_blocks(commands, ["doc_id"], order, max_group_rows)
    inputs, keep = ["op", "expected_revision", "valid"], ["doc_id", "seq", "op"]

    def advance(state: State, op: str, expected: int, valid: bool) -> tuple[State, tuple]:
        state, outcome = step(state, op, expected, valid)
        return state, (outcome, -1 if state is None else state[0])

    outputs = "outcome string, revision bigint"
    if not hot:
        return fold_sorted(commands, ["doc_id"], order, keep, inputs, advance, outputs)
    starts = _start_states(blocked, order)
    joined = blocked.join(broadcast_if_small(starts), ["doc_id", "_block"], "left")
    return fold_sorted(joined, ["doc_id", "_block"], order, keep, inputs, advance, outputs, start=_state, start_col="start")


#: Rows of one key that are sorted in memory, and rows of a stretch of those kept in the state store.
HELD, STRETCH = 50_000, 1_000
SPILL_KEY, SPILL_VALUE = "run int, part int", "rows binary"


def rows_in_order(batches: Iterator[pd.DataFrame], order: list[str], spill, held: int = HELD) -> Iterator[tuple]:
    """The rows of a key as tuples, in ascending order; at most ``held`` rows are sorted in memory.

    A micro-batch may hold any number of rows of one key.  Beyond ``held`` they
    are kept as sorted runs in ``spill``, a map state that is empty before and after,
    and merged from there, a stretch of each run at a time.
    """
    runs: list[int] = []
    some: list[tuple] = []
    place: list[int] = []

    def key(row: tuple) -> tuple:
        return tuple(row[i] for i in place)

    def put_away() -> None:
        some.sort(key=key)
        for part in range(0, len(some), STRETCH):
            spill.updateValue((len(runs), part // STRETCH), (pickle.dumps(some[part : part + STRETCH]),))
        runs.append(-(-len(some) // STRETCH))
        some.clear()

    def run(number: int) -> Iterator[tuple]:
        for part in range(runs[number]):
            yield from pickle.loads(bytes(spill.getValue((number, part))[0]))

    for pdf in batches:
        place = place or [pdf.columns.get_loc(c) for c in order]
        for row in pdf.itertuples(index=False, name=None):
            some.append(row)
            if len(some) >= held:
                put_away()
    some.sort(key=key)
    yield from heapq.merge(*[run(i) for i in range(len(runs))], some, key=key)
    if runs:
        spill.clear()


class CommandProcessor(StatefulProcessor):
    """STR1: one small value per document; ``close`` clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._session = handle.getValueState("session", "revision bigint, pending boolean, exportable boolean")
        self._spill = handle.getMapState("spill", SPILL_KEY, SPILL_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state: State = None
        if self._session.exists():
            kept = self._session.get()
            state = (int(kept[0]), bool(kept[1]), bool(kept[2]))
        out: list[tuple] = []
        columns = ["doc_id", "seq", "ts", "op", "expected_revision", "valid"]
        for doc, seq, _, op, expected, valid in rows_in_order((pdf[columns] for pdf in rows), ["ts", "seq"], self._spill):
            state, outcome = step(state, op, int(expected), bool(valid))
            out.append((doc, seq, op, outcome, -1 if state is None else state[0]))
            if len(out) >= ROWS_OUT:
                yield pd.DataFrame(out, columns=OUTCOME_NAMES)
                out = []
        if state is None:
            self._session.clear()
        else:
            self._session.update(state)
        yield pd.DataFrame(out, columns=OUTCOME_NAMES)

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def command_stream(commands: DataFrame) -> DataFrame:
    """STR1: the same outcomes as :func:`replay_commands`, continuously.

    The session must use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return commands.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=CommandProcessor(), outputStructType=OUTCOMES, outputMode="Append", timeMode="None"
    )


Candidate = tuple[int, str, str, str]  # revision it leads to, id, hash of its content, hash of its command


def candidate_id(revision: int, candidate_hash: str) -> str:
    return f"candidate:{revision}:{candidate_hash}"


class Staging:
    """A session with its staged candidate: what one document's commands do to it.

    ``stage`` replaces the candidate before it, under an id of revision and
    content; ``validate`` names the candidate it means by that id and its
    content's hash, so an earlier one is stale whatever its revision; a
    candidate that passes becomes the content, and is exported once.
    """

    FIELDS = "revision bigint, content_hash string, next bigint, candidate string, candidate_hash string, command_hash string, exported boolean"

    def __init__(self, kept: tuple | None = None):
        self.open = kept is not None
        self.revision, self.content, self.staged, self.exported = 0, "", None, True
        if kept is not None:
            self.revision, self.content, self.exported = int(kept[0]), kept[1], bool(kept[6])
            self.staged = (int(kept[2]), kept[3], kept[4], kept[5]) if kept[3] is not None else None

    def kept(self) -> tuple:
        return (self.revision, self.content, *(self.staged or (None, None, None, None)), self.exported)

    def handle(self, op: str, expected: int, candidate: str | None, content_hash: str | None, command_hash: str | None, valid: bool) -> str:
        if op == "open":
            self.open, self.revision, self.content, self.staged, self.exported = True, 0, content_hash or "", None, True
            return "OPENED"
        if not self.open or expected != self.revision:
            return "STALE_REVISION"
        if op == "stage":
            following = self.revision + 1
            self.staged = (following, candidate_id(following, content_hash or ""), content_hash or "", command_hash or "")
            return "STAGED"
        if op == "validate":
            if self.staged is None or (candidate, content_hash) != (self.staged[1], self.staged[2]):
                return "STALE_REVISION"
            following, _, content, _ = self.staged
            self.staged = None
            if not valid:
                return "VALIDATION_FAILURE"
            self.revision, self.content, self.exported = following, content, False
            return "VALIDATED"
        if op == "export":
            if self.exported:
                return "VALIDATION_FAILURE"
            self.exported = True
            return "EXPORTED"
        if op == "close":
            self.open, self.staged = False, None
            return "CLOSED"
        return "UNKNOWN_COMMAND"


STAGED = "doc_id bigint, seq bigint, op string, outcome string, revision bigint, candidate string, content_hash string"


class StagingProcessor(StatefulProcessor):
    """STR1 with candidates: revision, content and the staged candidate's id, content hash and command hash are the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._session = handle.getValueState("staging", Staging.FIELDS)
        self._spill = handle.getMapState("spill", SPILL_KEY, SPILL_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Staging(self._session.get() if self._session.exists() else None)
        names = [part.split()[0] for part in STAGED.split(",")]
        columns = ["doc_id", "seq", "ts", "op", "expected_revision", "candidate", "content_hash", "command_hash", "valid"]
        out: list[tuple] = []
        for doc, seq, _, op, expected, *named, valid in rows_in_order((pdf[columns] for pdf in rows), ["ts", "seq"], self._spill):
            outcome = session.handle(op, int(expected), *[v if isinstance(v, str) else None for v in named], bool(valid))
            shown = (session.revision, session.staged[1] if session.staged else None, session.content) if session.open else (-1, None, None)
            out.append((doc, seq, op, outcome, *shown))
            if len(out) >= ROWS_OUT:
                yield pd.DataFrame(out, columns=names)
                out = []
        if session.open:
            self._session.update(session.kept())
        else:
            self._session.clear()
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def staging_stream(commands: DataFrame) -> DataFrame:
    """STR1: doc_id, seq, op, outcome, revision, candidate (id of what is staged now), content_hash.

    commands: doc_id, seq, ts, op (open, stage, validate, export, close),
    expected_revision, candidate and content_hash (of what is staged or meant),
    command_hash, valid.  Needs the RocksDB state store.
    """
    return commands.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=StagingProcessor(), outputStructType=STAGED, outputMode="Append", timeMode="None"
    )

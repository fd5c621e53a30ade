"""Hot keys: block-wise results equal plain ones, and brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphfold.operators import aggregates as A
from glyphfold.operators import sequences as S
from glyphfold.operators.ordered import Sequence, assign_blocks
from glyphfold.streaming.commands import replay_commands
from glyphfold.streaming.machine import describe, run_block, step
from glyphfold.streaming.timeouts import detect_timeouts, drop_stale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = 1 if i % 3 == 0 else 2 + i % 40
        rows.append((key, i, rng.choice([None, 1, 2, 3]), rng.choice("abc"), float(rng.randint(-3, 3))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, o bigint, v int, s string, d double").cache()


def both(skewed, build):
    plain = build(Sequence(skewed, ["k"], ["o"]))
    hot = Sequence(skewed, ["k"], ["o"], 40)
    assert hot.blocked
    a = sorted(map(tuple, plain.done().select("k", "o", "out").collect()), key=repr)
    b = sorted(map(tuple, build(hot).done().select("k", "o", "out").collect()), key=repr)
    assert a == b


@pytest.mark.parametrize(
    "build",
    [
        lambda q: q.running_sum("out", F.col("v")),
        lambda q: q.running_sum("out", F.col("v"), inclusive=False),
        lambda q: q.running_min("out", F.col("d")),
        lambda q: q.running_max("out", F.col("v")),
        lambda q: q.row_number("out"),
        lambda q: q.lag("out", F.col("v")),
        lambda q: q.lead("out", F.col("s")),
        lambda q: q.last_known("out", F.col("v")),
        lambda q: q.last_known("out", F.when(F.col("o") % 50 == 0, F.col("o")), inclusive=False),
        lambda q: q.next_known("out", F.when(F.col("o") % 50 == 0, F.col("o"))),
    ],
)
def test_sequence_blocks(skewed, build):
    both(skewed, build)


def test_blocks_are_ordered_and_bounded(skewed):
    blocked, hot = assign_blocks(skewed, ["k"], ["o"], 40)
    assert hot
    pdf = blocked.toPandas()
    assert set(pdf[pdf.k != 1]._block) == {-1}
    one = pdf[pdf.k == 1].sort_values("o")
    assert one._block.is_monotonic_increasing and one._block.nunique() > 3
    assert one.groupby("_block").size().max() <= 80


def test_operators_with_blocks(skewed):
    def same(fn):
        a, b = (sorted(map(tuple, fn(n).collect()), key=repr) for n in (None, 40))
        assert a == b

    same(lambda n: S.style_runs(skewed, ["k"], "o", ["s"], "s", max_group_rows=n))
    step_ = F.when(F.col("s") == "a", 1).when(F.col("s") == "b", -1).otherwise(0)
    same(lambda n: S.scope_balance(skewed, ["k"], ["o"], step_, max_group_rows=n))
    same(lambda n: S.resolve_scopes(skewed, ["k"], ["o"], step_, F.col("v"), n).select("k", "o", "depth", "in_force"))
    same(lambda n: S.bracket_blocks(skewed, ["k"], "o", step_, n))
    same(lambda n: drop_stale(skewed.filter("v is not null"), ["k"], ["o"], "v", n))
    ranges = skewed.select("k", "o", (F.col("o") % 5).alias("s"), (F.col("o") % 5 + 1).alias("e"))
    same(lambda n: S.coalesce_ranges(ranges, ["k"], ["o"], "s", "e", n))
    same(lambda n: S.carry_state(skewed, ["k"], ["o"], ["v"], F.col("s") == "a", ["d"], n))


def test_exact_quantiles_of_hot_groups(skewed):
    pdf = skewed.toPandas()
    got = {r.k: (r.p90, r.p10) for r in A.exact_quantiles(skewed, ["k"], F.col("o"), {"p90": 0.9, "p10": 0.1}, 40).collect()}
    med = {r.k: r.median for r in A.exact_median(skewed, ["k"], F.col("o"), max_group_rows=40).collect()}
    for k, g in pdf.groupby("k"):
        values = sorted(g.o)
        at = lambda q: values[max(1, -(-round(q * 10) * len(values) // 10)) - 1]
        assert got[k] == (at(0.9), at(0.1))
        assert med[k] == pd.Series(values).median()


OPS = ["open", "apply", "validate", "preview", "export", "close", "apply", "validate"]


def commands(seed, n, keys):
    rng = random.Random(seed)
    return [
        (rng.choice(keys), i, float(i), rng.choices(OPS, [1, 4, 4, 2, 2, 1, 4, 4])[0], rng.randint(0, 2), rng.random() < 0.8)
        for i in range(n)
    ]


def replayed(rows):
    state, out = {}, []
    for doc, seq, _, op, expected, valid in rows:
        state[doc], outcome = step(state.get(doc), op, expected, valid)
        out.append((doc, seq, op, outcome, -1 if state[doc] is None else state[doc][0]))
    return sorted(out)


def test_replay_plain_and_in_blocks(spark):
    rows = commands(3, 1200, [1, 1, 1, 2, 3, 4, 5])
    df = spark.createDataFrame(rows, "doc_id bigint, seq bigint, ts double, op string, expected_revision bigint, valid boolean")
    want = replayed(rows)
    for limit in (10_000, 60):
        got = sorted(map(tuple, replay_commands(df, limit).collect()))
        assert got == want
    assert {"VALIDATED", "EXPORTED", "VALIDATION_FAILURE", "STAGED", "CLOSED"} <= {w[3] for w in want}


def test_replay_of_a_long_log_with_a_new_revision_at_each_commit(spark):
    """Revisions go up all along one document; commands that come late or never name one, and a session that starts anew."""
    rng = random.Random(6)
    rows, revision = [], 0
    for i in range(900):
        if i in (5, 600):
            op, expected, revision = "open", 0, 0
        else:
            op = ("apply", "validate")[i % 2]
            expected = revision if rng.random() < 0.9 else rng.randint(0, 400)
            revision += op == "validate" and expected == revision
        rows.append((1, i, float(i), op, expected, True))
    rows += [(2, 2000 + i, float(i), "apply", i, True) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, seq bigint, ts double, op string, expected_revision bigint, valid boolean")
    got = sorted(map(tuple, replay_commands(df, 50).collect()))
    assert got == replayed(rows) and max(g[4] for g in got) > 30


def test_block_functions_are_rows_of_states_that_can_come_in(spark):
    from glyphfold.operators.ordered import assign_blocks
    from glyphfold.streaming import commands as C

    rows = [(1, i, float(i), "open" if not i else ("apply", "validate")[i % 2], max(0, i - 1) // 2, True) for i in range(801)]
    df = spark.createDataFrame(rows, "doc_id bigint, seq bigint, ts double, op string, expected_revision bigint, valid boolean")
    blocked, _ = assign_blocks(df, ["doc_id"], ["ts", "seq"], 100)
    starts = {r["_block"]: C._state(r["start"]) for r in C._start_states(blocked, ["ts", "seq"]).collect()}
    state, want = None, {}
    for r in sorted(blocked.collect(), key=lambda r: r.seq):
        want.setdefault(r["_block"], state)
        state = step(state, r.op, r.expected_revision, r.valid)[0]
    assert starts == want and len(want) > 5


def test_block_description_is_the_fold():
    for seed in range(60):
        block = [(op, e, v) for _, _, _, op, e, v in commands(seed, 30, [1])]
        described = describe(block)
        for state in [None, *[(r, p, x) for r in range(5) for p in (False, True) for x in (False, True)]]:
            end = state
            for op, e, v in block:
                end = step(end, op, e, v)[0]
            assert run_block(described, state) == end


def brute_admit(rows, max_item, max_count, max_total):
    got, out = {}, []
    for tenant, o, h, size, allowed in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = got.setdefault(tenant, [])
        total = sum(s for _, s in mine)
        if size <= 0:
            verdict = "EMPTY"
        elif size > max_item:
            verdict = "ITEM_LIMIT"
        elif h in [x for x, _ in mine]:
            verdict = "DUPLICATE"
        elif len(mine) >= max_count:
            verdict = "COUNT_LIMIT"
        elif size > max_total - total:
            verdict = "TOTAL_LIMIT"
        elif not allowed:
            verdict = "PROHIBITED"
        else:
            verdict = "ADMITTED"
            mine.append((h, size))
        out.append((tenant, o, verdict))
    return sorted(out)


@pytest.mark.parametrize("candidates", [1, 3, 10_000])
def test_admission(spark, candidates):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        h = rng.randint(0, 80)
        rows.append((rng.choice([1, 1, 2, 3]), i, h, float(h % 23), h % 11 != 5))
    df = spark.createDataFrame(rows, "t bigint, o bigint, hash bigint, size double, allowed boolean")
    got = S.admit(df, "t", "o", 20.0, 6, 61.0, candidates).select("t", "o", "outcome")
    assert sorted(map(tuple, got.collect())) == brute_admit(rows, 20.0, 6, 61.0)


@pytest.mark.parametrize("limit", [10_000, 15])
def test_timeouts(spark, limit):
    rng = random.Random(4)
    rows, answers = [], []
    for i in range(300):
        worker, t = rng.choice([1, 1, 1, 2]), rng.randint(0, 2500)
        rows.append((worker, i, t))
        if rng.random() < 0.6:
            answers.append((i, t + rng.randint(0, 29)))
    reqs = spark.createDataFrame(rows, "worker bigint, req_id bigint, s bigint").select(
        "worker", "req_id", F.timestamp_seconds("s").alias("ts")
    )
    resp = spark.createDataFrame(answers, "req_id bigint, s bigint").select("req_id", F.timestamp_seconds("s").alias("resp_ts"))
    answer = dict(answers)
    want = []
    for w in (1, 2):
        mine = sorted((t, i) for worker, i, t in rows if worker == w)
        marks, last = [], -1
        for t, i in mine:
            if i not in answer and t >= last:
                last = t + 30
                marks.append(last)
        for t, i in mine:
            hit = next((m for m in marks if m > t), None)
            if i not in answer and hit == t + 30:
                want.append((w, i, "TIMEOUT"))
            elif hit is not None and (i not in answer or answer[i] > hit):
                want.append((w, i, "WORKER_TIMEOUT"))
            else:
                want.append((w, i, "ANSWERED"))
    got = sorted(map(tuple, detect_timeouts(reqs, resp, 30, limit).collect()))
    assert got == sorted(want)
    assert len({g[2] for g in got}) == 3

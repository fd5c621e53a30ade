"""Range questions on runs (AGG12, AGG13): against plain Python, from one reading of the runs."""

import random

from pyspark.sql import functions as F

from glyphfold.operators import aggregates as A

RUN = "line bigint, char_start bigint, char_end bigint, name_key string, family string, weight int, italic boolean, angle double, underline boolean, strike boolean"
ASKED = "req_id bigint, line bigint, start bigint, end bigint"


def tables(seed):
    rng = random.Random(seed)
    runs, asked = [], []
    for line in (1, 2, 3, None):
        at = 0
        for _ in range(rng.randrange(1, 7)):
            size = rng.randrange(4)
            name = rng.choice(["sans", "serif", None])
            runs.append((line, at, at + size, name, name, rng.choice([400, 700]), False, rng.choice([0.0, -12.0, None]), rng.random() < 0.5, False))
            at += size
    for i in range(60):
        start = rng.randrange(14)
        asked.append((i, rng.choice([1, 2, 3, 4, None]), start, start + rng.choice([0, 0, 1, 2, 5, 20])))
    return runs, [*asked, (None, 1, 0, 3)]


def met(runs, line, start, end, clamped):
    own = [r for r in runs if line is not None and r[0] == line]
    size = max((r[2] for r in own), default=0)
    lo = max(0, min(start, size))
    hi = max(lo, min(end, size))
    if lo == hi if clamped else start == end:
        lo, hi = 0, size
    solid = sorted(r for r in own if r[2] > r[1]) if own else []
    found = [r for r in solid if r[1] < hi and r[2] > lo]
    return found if lo < hi else []


def test_ranges_against_python(spark):
    for seed in range(3):
        runs, asked = tables(seed)
        frames = spark.createDataFrame(runs, RUN), spark.createDataFrame(asked, ASKED)
        states = {r.req_id: (r.bold, r.italic, r.underline, r.strike) for r in A.format_state(*frames, ["line"]).collect()}
        kinds = {(r.req_id, r.line): (r.kind, r.name_key) for r in A.uniform_requirement(*frames, ["line"]).collect()}
        assert len(kinds) == len(asked) and kinds[(None, 1)] == ("empty", None)
        for i, line, start, end in asked[:-1]:
            seen = met(runs, line, start, end, True)
            flags = [[r[5] >= 600 for r in seen], [bool(r[7]) for r in seen], [r[8] for r in seen], [r[9] for r in seen]]
            assert states.get(i) == (tuple("on" if all(f) else "mixed" if any(f) else "off" for f in flags) if seen else None)
            fonts = {r[3:7] for r in met(runs, line, start, end, False)}
            want = "empty" if not fonts else "ready" if len(fonts) == 1 else "mixed"
            assert kinds[(i, line)] == (want, min(fonts)[0] if want == "ready" else None)


def test_runs_are_worked_out_once(spark):
    runs, asked = (spark.createDataFrame(rows, kind) for rows, kind in zip(tables(0), (RUN, ASKED)))
    costly = runs.withColumn("weight", F.length(F.repeat("name_key", F.col("weight"))))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for question in (A.format_state, A.uniform_requirement):
        text = question(costly, asked, ["line"])._jdf.queryExecution().explainString(mode)
        assert text.count("repeat(") == 1, text

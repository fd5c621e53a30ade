"""The next known value of a key of many rows, with and without blocks."""

import random

from pyspark.sql import functions as F

from glyphfold.operators.ordered import Sequence


def test_next_known_reads_each_row_once(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(40)]), i, rng.choice([None, None, i])) for k in (1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, a bigint, i bigint, v bigint")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for limit in (None, 20):
        found = Sequence(df, ["k"], ["a", "i"], limit).next_known("n", F.col("v")).done()
        if limit is None:
            # A frame from the row to the end is read again for each row.
            assert "unboundedfollowing" not in found._jdf.queryExecution().explainString(mode).lower()
        got = {(r.k, r.i): r.n for r in found.collect()}
        for k in (1, None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            for at, r in enumerate(own):
                assert got[(k, r[2])] == next((o[3] for o in own[at + 1 :] if o[3] is not None), None)

"""Results that must not be cut, lost or claimed: depth, size, order, nulls and whole selections."""

import random

import pytest
from pyspark.sql import functions as F

from glyphfold.operators import joins as J
from glyphfold.operators import sequences as S
from glyphfold.operators import spatial as X
from glyphfold.operators.ordered import Sequence, assign_blocks, fold_sorted
from glyphfold.plans import redaction as R
from glyphfold.session import broadcast_if_small


@pytest.mark.parametrize("limit", [None, 30])
def test_scopes_of_any_depth(spark, limit):
    rng, rows, want = random.Random(3), [], {}
    for key in range(4):
        stack = [None]
        for i in range(200):
            up = rng.random() < (0.75 if i < 120 else 0.3)
            move = "push" if up and rng.random() < 0.6 else "pop" if rng.random() < 0.4 else "set" if rng.random() < 0.3 else "other"
            value = float(i) if move == "set" else None
            if move == "push":
                stack.append(None)
            elif move == "pop" and len(stack) > 1:
                stack.pop()
            elif move == "set":
                stack[-1] = value
            rows.append((key, i, {"push": 1, "pop": -1}.get(move, 0), value))
            want[key, i] = (len(stack) - 1, next((v for v in reversed(stack) if v is not None), None))
    assert max(depth for depth, _ in want.values()) > 15
    frame = spark.createDataFrame(rows, "k long, o long, step int, v double").repartition(3)
    out = S.resolve_scopes(frame, ["k"], ["o"], F.col("step"), F.col("v"), limit).collect()
    assert {(r.k, r.o): (r.depth, r.in_force) for r in out} == want


def test_value_far_outside_is_inherited(spark):
    rows = [(1, 0, 0, 7.0)] + [(1, i, 1, None) for i in range(1, 40)] + [(1, 40, 0, None)]
    frame = spark.createDataFrame(rows, "k long, o long, step int, v double")
    out = S.resolve_scopes(frame, ["k"], ["o"], F.col("step"), F.col("v"))
    assert {r.in_force for r in out.collect()} == {7.0} and out.agg(F.max("depth")).first()[0] == 39


def test_code_tables_are_whole_or_refused(spark):
    rows = [
        (1, 1, 0, 40_000, 100, None),
        (1, 2, 0, 40_000, 200, None),  # the same codes again: 40,001 of them, not 80,002
        (2, 1, 5, 3, 100, None),
        (3, 1, 0, 70_000, 100, None),
        (4, 1, 0, 60_000, 100, None),
        (4, 2, 60_001, 66_000, 100, None),
        (5, 1, 0, 2, 100, ["a", "b"]),
        (6, 1, 0, 1, 100, ["a", "b"]),
    ]
    frame = spark.createDataFrame(rows, "font_id long, ordinal long, first long, last long, target long, targets array<string>")
    outcomes = {r.font_id: r.outcome for r in J.code_outcomes(frame).collect()}
    assert outcomes == {1: "ok", 2: "inverted-range", 3: "range-limit", 4: "code-limit", 5: "short-list", 6: "ok"}
    table = J.code_table(frame)
    assert {r.font_id: r["count"] for r in table.groupBy("font_id").count().collect()} == {1: 40_001, 6: 2}
    assert table.filter("font_id = 1 and code = 0").first().text == chr(200)


def test_codes_of_other_lengths_are_other_codes(spark):
    frame = spark.createDataFrame(
        [(1, 1, 1, 65, 65, 97, None), (1, 2, 2, 65, 66, 98, None)],
        "font_id long, code_len int, ordinal long, first long, last long, target long, targets array<string>",
    )
    widths = J.width_table(spark.createDataFrame([(1, 1, 60, 70, 5.0)], "font_id long, ordinal long, first long, last long, width double"))
    codes = spark.createDataFrame([(1, 1, 65), (1, 2, 65), (1, 3, 65)], "font_id long, code_len int, code long")
    got = {r.code_len: (r.text, r.width) for r in J.decode_codes(codes, J.code_table(frame), widths, 1.0).collect()}
    assert got == {1: ("a", 5.0), 2: ("b", 5.0), 3: (None, 5.0)}


def test_slices_of_ranges_of_many_lengths(spark):
    rng, rows, want = random.Random(4), [], []
    for key in range(60):
        slices, s, e = [], 0, 2
        for i in range(30):
            kind = rng.random()
            if kind < 0.3:
                s, e = e, e + rng.randint(1, 3)
            elif kind < 0.6:
                s = rng.choice([s, max(0, s - 1), slices[-1][0] if slices else s])
            elif kind < 0.9:
                s, e = rng.randint(0, 5), rng.randint(6, 9)
            rows.append((key, i, s, e))
            if slices and slices[-1][:2] == [s, e]:
                slices[-1][2] += 1
            elif slices and slices[-1][1] == s:
                slices[-1][1] = e
                slices[-1][2] += 1
            else:
                slices.append([s, e, 1])
        want += [(key, n) for *_, n in slices]
    frame = spark.createDataFrame(rows, "k long, o long, s int, e int")
    out = S.coalesce_ranges(frame, ["k"], ["o"], "s", "e").orderBy("k", "slice_no").collect()
    assert [(r.k, r.members) for r in out] == want


def plan_rows(spark, rows):
    schema = "doc_id long, selection_id long, char_start long, char_end long, source string, replacement string, plan_outcome string"
    return spark.createDataFrame(rows, schema).withColumn("source_digest", F.sha2("source", 256))


def test_apply_is_whole_and_truthful(spark):
    docs = spark.createDataFrame([(i, "abcdefghij") for i in range(1, 7)], "doc_id long, text string")
    plan = plan_rows(
        spark,
        [
            (1, 1, 0, 3, "abc", "X", "PLANNED"),
            (1, 2, 2, 5, "cde", "Y", "PLANNED"),  # in the way of the first
            (2, 1, 0, 3, "abc", "X", "PLANNED"),
            (2, 1, 5, 6, "f", "Y", "REPLACEMENT_OVERFLOW"),  # refused at planning
            (3, 1, 0, 3, "abc", "X", "PLANNED"),
            (3, 1, 5, 6, "changed", "Y", "PLANNED"),  # stale
            (4, 1, 0, 3, "abc", "X", "PLANNED"),
            (4, 2, 5, 6, "f", "", "PLANNED"),
            (5, 1, 3, 3, "", "X", "PLANNED"),  # empty range
            (5, 2, 8, 12, "ij", "X", "PLANNED"),  # beyond the text
            (6, 1, 0, 3, "abc", "X", "PLANNED"),
            (6, 2, 1, 2, "b", "Y", "READ_ONLY_SPAN"),  # a refused selection is in nobody's way
        ],
    )
    after, outcomes = R.apply_edits(docs, plan)
    texts = {r.doc_id: r.text for r in after.collect()}
    assert texts == {1: "abcdefghij", 2: "abcdefghij", 3: "abcdefghij", 4: "Xdeghij", 5: "abcdefghij", 6: "Xdefghij"}
    got = {(r.doc_id, r.selection_id, r.char_start): r.outcome for r in outcomes.collect()}
    assert got == {
        (1, 1, 0): "READ_ONLY_SPAN", (1, 2, 2): "READ_ONLY_SPAN",
        (2, 1, 0): "REPLACEMENT_OVERFLOW", (2, 1, 5): "REPLACEMENT_OVERFLOW",
        (3, 1, 0): "STALE_REVISION", (3, 1, 5): "STALE_REVISION",
        (4, 1, 0): "APPLIED", (4, 2, 5): "APPLIED",
        (5, 1, 3): "STALE_REVISION", (5, 2, 8): "STALE_REVISION",
        (6, 1, 0): "APPLIED", (6, 2, 1): "READ_ONLY_SPAN",
    }


def test_several_edits_of_one_run_list_change_nothing(spark):
    runs = spark.createDataFrame([(1, 1, "abcdefghij", "s"), (2, 1, "abcdefghij", "s")], "k long, run_no long, run_text string, style string")
    edits = spark.createDataFrame([(1, 1, 2, "X"), (1, 5, 6, "Y"), (2, 1, 2, "Z")], "k long, start int, end int, inserted string")
    out = R.replace_in_runs(runs, edits, ["k"], ["style"]).groupBy("k").agg(F.expr("listagg(run_text) WITHIN GROUP (ORDER BY run_no)").alias("t"))
    assert {r.k: r.t for r in out.collect()} == {1: "abcdefghij", 2: "aZcdefghij"}
    assert {r.k: r.outcome for r in R.edit_outcomes(edits, ["k"]).collect()} == {1: "READ_ONLY_SPAN", 2: "EDITED"}


def test_folds_keep_integers_and_null_keys(spark):
    big = 9_007_199_254_740_993
    frame = spark.createDataFrame([(big, 1, None), (big, 2, 5), (None, 1, 1), (None, 2, None), (3, 1, 2)], "k long, o long, v long")
    out = fold_sorted(frame, ["k"], ["o"], ["k", "o"], ["v"], lambda n, v: ((n or 0) + 1, ((n or 0) + 1, v)), "n long, seen long")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(big, 1, 1, None), (big, 2, 2, 5), (None, 1, 1, 1), (None, 2, 2, None), (3, 1, 1, 2)], key=repr
    )


@pytest.mark.parametrize("order", [["name"], ["same", "name"], ["at"]])
def test_hot_keys_of_any_order(spark, order):
    rows = [(1 if i % 2 else i, f"n{i * 7919 % 1000:04d}", "x", i) for i in range(400)]
    frame = spark.createDataFrame(rows, "k long, name string, same string, i long").withColumn(
        "at", F.timestamp_seconds(F.col("i") * 7919 % 1009)
    )
    blocked, hot = assign_blocks(frame, ["k"], order, 20)
    assert hot and blocked.filter("k = 1").select("_block").distinct().count() > 4
    plain = Sequence(frame, ["k"], order).running_sum("s", F.col("i")).total("t", F.col("i")).done()
    cut = Sequence(frame, ["k"], order, 20).running_sum("s", F.col("i")).total("t", F.col("i")).done()
    pick = ["k", "i", "s", "t"]
    assert sorted(map(tuple, plain.select(*pick).collect())) == sorted(map(tuple, cut.select(*pick).collect()))


def test_rows_equal_in_all_order_columns_share_a_block(spark):
    frame = spark.createDataFrame([(1, 5, i) for i in range(100)], "k long, o long, v long")
    cut = Sequence(frame, ["k"], ["o"], 10).running_max("m", F.col("v")).done()
    assert cut.count() == 100 and cut.agg(F.max("m")).first()[0] == 99


@pytest.mark.parametrize("height", [0.1, 1.0, 12.0, 300.0])
def test_candidates_stay_near_the_results(spark, height):
    rng = random.Random(5)
    glyphs = [(1, i, (i % 60) * height * 0.6, -(i // 60) * height * 1.2, height * 0.5, height) for i in range(3000)]
    targets = [(1, i, rng.random() * height * 30, -rng.random() * height * 55, height * 0.5, height) for i in range(300)]
    schema = "k long, id long, x double, y double, w double, h double"
    a, b = spark.createDataFrame(glyphs, schema), spark.createDataFrame(targets, schema)
    got = {(r.l_id, r.r_id) for r in X.join_intersects(a, b, ["k"], ["id"], ["id"]).collect()}
    want = {
        (g[1], t[1])
        for g in glyphs
        for t in targets
        if g[2] < t[2] + t[4] and g[2] + g[4] > t[2] and g[3] < t[3] + t[5] and g[3] + g[5] > t[3]
    }
    assert got == want and want
    sides = X._leveled(a), X._leveled(b)
    levels = [X._levels_of(s) for s in sides]
    left = X._box_rows(sides[0], ["k"], levels[1], "_a", ["id"], left=True)
    right = X._box_rows(sides[1], ["k"], levels[0], "_b", ["id"], left=False)
    candidates = left.join(right, ["k", "_la", "_lb", "_cx", "_cy"]).count()
    assert candidates < 40 * len(want) and candidates < 60_000  # all pairs would be 900,000


def test_glyphs_without_text_split_groups(spark):
    rows = [(1, 0, 1, 1, "a", 0.0), (1, 0, 1, 2, None, 5.0), (1, 0, 1, 3, "b", 9.0)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_no int, tok_no int, text string, x double").withColumns(
        {"w": F.lit(1.0), "h": F.lit(1.0), "style": F.lit("s")}
    )
    assert [r.group_no for r in S.split_groups(frame).orderBy("tok_no").collect()] == [0, 1, 2]
    runs = S.style_runs(frame, ["doc_id", "page", "line_no"], "tok_no", ["style"], "text").collect()
    assert [r.run_text for r in runs] == ["a￼b"]


def test_raised_atoms_stay_in_their_line(spark):
    rows = [(1, 0, 1, 1, "A", 0.0, 0.0), (1, 0, 1, 2, "B", 1.0, 0.2), (1, 0, 1, 3, "C", 2.0, 0.0), (1, 0, 2, 1, "D", 0.0, 0.1)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_no int, tok_no int, text string, x double, y double")
    assert "".join(r.text for r in S.reading_order(frame).orderBy("ordinal").collect()) == "DABC"


def test_broadcasts_are_bounded_in_bytes(spark):
    long = spark.range(50).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"))
    small = spark.range(50).select("id", F.lit("x").alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(long)) and not hinted(broadcast_if_small(small, 10))


def test_ends_widen_over_clusters_of_any_length(spark):
    from glyphfold.functions.text import CLUSTER_STRETCH, widened_end

    long = "a" + "́" * (3 * CLUSTER_STRETCH) + "b"
    exact = "a" + "́" * (CLUSTER_STRETCH - 1) + "b"
    rows = [("abc", 1, 1), (long, 1, len(long) - 1), (exact, 5, CLUSTER_STRETCH), (long, len(long), len(long)), ("", 0, 0), ("x́y", 2, 2)]
    df = spark.createDataFrame(rows, "t string, e int, want int")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in df.select("want", widened_end(F.col("t"), F.col("e")).alias("got")).collect())

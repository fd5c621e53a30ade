"""Atoms are sorted as seldom as their order asks for, and pages with odd keys keep their lines."""

import random

from pyspark.sql import functions as F

from glyphfold.operators import sequences as S
from glyphfold.plans import layout as L

ATOM = "doc_id bigint, page int, atom_id bigint, text string, mode int, x double, y double, w double, h double, bx double, by double, dx double, dy double"


def atom(doc, page, i, x, by, h=2.0, dx=1.0, dy=0.0):
    return (doc, page, i, f"t{i}", 0, x, by, 1.0, h, x, by, dx, dy)


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_level_pages_are_not_sorted_to_find_lines(spark):
    rows = [atom(d, p, 10 * n + t, float(t), -10.0 * n + 0.2 * t) for d in range(3) for p in range(2) for n in range(4) for t in range(3)]
    lined = S.assign_lines(spark.createDataFrame(rows, ATOM))
    assert not any("atom_id" in line for line in plan_of(lined).splitlines() if "Sort [" in line)
    assert {(r.atom_id // 10, r.line_id) for r in lined.collect()} == {(n, n) for n in range(4)}


def test_placed_atoms_are_sorted_three_times(spark):
    rows = [atom(1, 0, 10 * n + t, float(2 * t), -10.0 * n + 0.2 * t) for n in range(3) for t in range(3)]
    placed = L.place_atoms(spark.createDataFrame(rows, ATOM), F.lit(None).cast("double"), F.lit(4.0), F.lit(1.0))
    sorts = [line for line in plan_of(placed).splitlines() if "Sort [" in line and ("atom_id" in line or "tok_no" in line or "_top" in line or "ordinal" in line)]
    assert len(sorts) <= 3, sorts
    got = sorted((r.atom_id, r.line_no, r.tok_no, r.ordinal) for r in placed.collect())
    assert got == [(10 * n + t, n + 1, t + 1, 3 * n + t + 1) for n in range(3) for t in range(3)]


def test_pages_without_a_key_and_with_odd_baselines_are_folded(spark):
    rng = random.Random(5)
    rows = []
    for doc, page in ((1, 0), (1, None), (None, 0), (None, None), (2, 0), (3, 0), (4, 0)):
        for i in range(24):
            by = rng.choice([0.0, -0.0, -0.3, -7.0, -7.4, -20.0])
            if doc == 2 and i == 5:
                by = None
            rows.append(atom(doc, page, i, float(i), by, h=rng.choice([1.0, 2.0, 9.0]), dx=0.0 if doc == 3 and i == 3 else 1.0, dy=1.0 if doc == 3 and i == 3 else 0.0))
    atoms = spark.createDataFrame([r for r in rows if r[10] is not None], ATOM)
    assigned = {(r.doc_id, r.page, r.atom_id): r.line_id for r in S.assign_lines(atoms).collect()}
    assert len(assigned) == sum(r[10] is not None for r in rows)
    # The same atoms folded as a whole: an atom of a nearly level direction keeps its page from the bands.
    tilted = [(*r[:11], 1.0, 1e-12) if r[0] != 3 else r for r in rows if r[10] is not None]
    folded = {(r.doc_id, r.page, r.atom_id): r.line_id for r in S.assign_lines(spark.createDataFrame(tilted, ATOM)).collect()}
    assert assigned == folded
    # A null baseline neither loses nor repeats an atom on the way to the fold.
    marked = S.plain_baselines(spark.createDataFrame(rows, ATOM)).collect()
    assert not any(r._level for r in marked if None in (r.doc_id, r.page) or r.doc_id == 2)

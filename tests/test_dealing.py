"""What keeps atoms where they lie: partitions by text, no checkpoints between, one pass."""

import pytest

from glyphfold import session
from glyphfold.catalog import load
from glyphfold.operators import aggregates as A
from glyphfold.operators import sequences as S

SMALL = "/root/testdata/sf0.001"


def test_partitions_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_TEXT_BYTES", 1000)
    cores = spark.sparkContext.defaultParallelism
    for rows in (1, 40):
        texts = spark.createDataFrame([(i, "é" * 500) for i in range(rows)] + [(None, None)], "doc_id long, text string")
        assert session.text_parts(texts) == max(cores, rows)
        assert session.deal(texts, "doc_id", session.text_parts(texts)).rdd.getNumPartitions() == max(cores, rows)
    assert session.text_parts(texts.filter("false")) == cores


@pytest.mark.parametrize(
    "name",
    [
        *("jon3_box_overlap", "jon11_hit_test", "jon11_nearest", "jon11_targets", "rdx4_replace_runs", "rdx4_format_runs"),
        *("rdx6_profile", "rdx8_extraction", "rdx8_extraction_lenient", "agg10_masked_diff", "agg12_format_state"),
        *("agg13_uniform_requirement", "win2_lines_separable", "win2_lines_greedy", "win3_reading_order", "win5_synthetic_spaces"),
        *("win6_style_runs", "win10_advance_profile", "win19_cluster_text", "layout_runs", "layout_groups"),
    ],
)
def test_documents_are_dealt_by_their_text(spark, capsys, name):
    capsys.readouterr()
    load()[0][name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("step", [8.0, 0.9])
def test_lines_are_found_without_writing_atoms(spark, monkeypatch, step):
    def refused(df):
        raise AssertionError("atoms were written")

    monkeypatch.setattr(S, "cut_lineage", refused)
    rows = [(1, p, i, float(i), -step * (i // 3), 2.0, 1.0, 0.0) for p in range(2) for i in range(9)]
    atoms = spark.createDataFrame(rows, "doc_id int, page int, atom_id int, bx double, by double, h double, dx double, dy double")
    got = {(r.page, r.atom_id): r.line_id for r in S.assign_lines(atoms).collect()}
    # At 0.9 the second row is still within a unit of the first.
    assert got == {(p, i): i // 3 if step == 8.0 else i // 6 for p in range(2) for i in range(9)}


def test_calls_of_a_validator_are_spread(spark, capsys):
    capsys.readouterr()
    load()[0]["udf1_validator"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    above = plan[plan.index("FlatMapGroupsInPandas") :]
    assert "REPARTITION_BY_NUM" in above[: above.index("Aggregate")]


def test_masks_that_repeat_and_cells_without_a_key(spark):
    cells = "d int, x double, y double, v string"
    before = spark.createDataFrame([(1, 1.0, 1.0, "a"), (1, 9.0, 9.0, "b"), (None, 1.0, 1.0, "c")], cells)
    after = spark.createDataFrame([(1, 1.0, 1.0, "z"), (1, 5.0, 5.0, "b"), (2, 1.0, 1.0, "n")], cells)
    mask = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (1, 0.0, 0.0, 4.0, 4.0)], "d int, x0 double, y0 double, x1 double, y1 double")
    got = {r.d: (r.same_shape, r.inside_cells, r.outside_cells, r.inside_raw, r.outside_raw) for r in A.masked_diff(before, after, ["d"], ["x", "y"], "v", mask).collect()}
    assert got == {1: (False, 2, 4, 2, 4), 2: (False, 0, 1, 0, 1), None: (False, 0, 1, 0, 1)}


def test_a_shared_continuation_is_walked_once(spark, monkeypatch):
    counts = []

    def counted(df):
        done = session.cut_lineage(df)
        counts.append(done.count())
        return done

    monkeypatch.setattr(A, "cut_lineage", counted)
    edges = [(1000 + i, 100 + i) for i in range(100)] + [(100 + i, 0) for i in range(100)] + [(i, i + 1) for i in range(6)]
    roots = spark.createDataFrame([(1000 + i,) for i in range(100)], "root bigint")
    got = A.walk_resources(roots, spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert got.count() == 100 * 9
    # Links twice, the nodes that roots lead to, their links, and the paths from them.
    assert sum(n >= 100 for n in counts) <= 5

"""Atoms to proof on tables in buckets: no exchange of text after the layout, and what a proof refuses."""

import re

import pytest
from pyspark.sql import functions as F

from glyphfold.plans import from_atoms as FA
from glyphfold.plans.redaction import apply_edits

CATALOGUE = (
    "font_id long, name_key string, family_key string, weight int, italic boolean, code_points array<int>, source string, hash string, "
    "metrics string, embeddable boolean"
)


@pytest.fixture(scope="module")
def groups(spark):
    """Three documents of two pages; document 2 says one thing twice, document 3 has a group that may not be changed."""
    rows = []
    for doc in (1, 2, 3):
        for page in (0, 1):
            for line in range(4):
                text = "said twice over" if doc == 2 and line < 2 else f"group {line} of page {page} in {doc}"
                rows.append((doc, page, line + 1, 1, page * 4 + line + 1, text, 0.0, -10.0 * line, float(len(text)), 2.0, "readOnly" if doc == 3 and line == 0 else "safeReplacement"))
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_no int, group_no int, seq int, text string, x double, y double, w double, h double, kind string")
    ends = frame.withColumn("char_end", F.expr("sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - 1"))
    full = ends.withColumns(
        {
            "char_start": F.col("char_end") - F.length("text"),
            "reasons": F.array().cast("array<string>"),
            "font_id": F.lit(1).cast("long"),
            "advance": F.lit(1.0),
        }
    )
    return FA.write_buckets(full)


@pytest.fixture(scope="module")
def fonts(spark):
    cover = list(range(32, 127))
    frame = spark.createDataFrame([(1, "sans", "sans", 400, False, cover, "embedded", "h", None, True)], CATALOGUE)
    return frame, frame.select("font_id", "name_key", "family_key", F.lit(None).cast("string").alias("subfamily"), "weight", "italic")


def edits(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, page int, source_text string, replacement string")
    return frame.withColumns({"accept_substitution": F.lit(True), "font_id": F.lit(None).cast("long")})


def test_outcomes_and_texts(spark, groups, fonts):
    asked = edits(spark, [(1, 1, "group 2 of page 1 in 1", "gone"), (2, 0, "said twice over", "once"), (3, 0, "group 0 of page 0 in 3", "no")])
    got = {r.doc_id: r for r in FA.redact_groups(groups, asked, *fonts).collect()}
    assert {doc: r.outcome for doc, r in got.items()} == {1: "APPLIED", 2: "READ_ONLY_SPAN", 3: "READ_ONLY_SPAN"}
    assert got[1].valid and got[1].old_outside == 0 and got[2].valid is None and got[3].valid is None
    before = {r.doc_id: r.d for r in FA.documents(groups).select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert got[1].text_digest != before[1] and (got[2].text_digest, got[3].text_digest) == (before[2], before[3])


def test_wide_replacement_and_unknown_text(spark, groups, fonts):
    asked = edits(spark, [(1, 0, "group 1 of page 0 in 1", "x" * 23), (2, 1, "never said", "y")])
    got = {r.doc_id: r.outcome for r in FA.redact_groups(groups, asked, *fonts).collect()}
    assert got[1] == "REPLACEMENT_OVERFLOW" and got[2] not in (None, "APPLIED") and got[3] is None


def test_a_line_feed_in_a_replacement_is_no_valid_proof(spark, groups, fonts):
    plan = FA.plan_groups(groups, edits(spark, [(1, 0, "group 1 of page 0 in 1", "gone")]), *fonts)
    broken = plan.withColumn("replacement", F.lit("go\nne"))
    after, outcomes = apply_edits(FA.documents(groups), broken)
    assert [r.valid for r in FA.evidence_of(after, FA.expected(groups, outcomes)).collect()] == [False]


def test_no_exchange_of_texts_after_the_plan(spark, groups, fonts):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with FA.by_document(spark):
            plan = FA.plan_groups(groups, edits(spark, [(1, 0, "group 1 of page 0 in 1", "gone")]), *fonts)
            after, outcomes = apply_edits(FA.documents(groups), plan)
            asked = FA.expected(groups, FA.write_buckets(outcomes))
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
            plans = [df._jdf.queryExecution().explainString(mode) for df in (after, FA.evidence_of(after, asked))]
    finally:
        spark.conf.set(name, before)
    for text in plans:
        found = [line for line in text.splitlines() if "Exchange" in line]
        # Only rows of edits: slices by their offsets, expectations on their way to the pages, and what was seen of them.
        other = [i for i, line in enumerate(found) if not re.search(r"_w0#|exp_id#|REPARTITION_BY_NUM", line)]
        assert all(i and "REPARTITION_BY_NUM" in found[i - 1] for i in other), found
    assert spark.conf.get(FA._ALL_KEYS) != "false"

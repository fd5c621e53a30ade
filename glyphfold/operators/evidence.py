"""Evidence gates (AGG15-AGG17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.operators.joins import union_all


def outcome_matches() -> Column:
    """A case's observed outcome against its expectation."""
    return (F.col("expected_kind") == F.col("observed_kind")) & (
        F.when(F.col("expected_kind") == "crossConsumerControl", True)
        .when(F.col("expected_kind") == "rejected", F.col("expected_code") == F.col("observed_code"))
        .otherwise(
            (F.col("expected_code") == F.col("observed_code"))
            & (F.col("expected_reason").isNull() | F.array_contains("observed_reasons", F.col("expected_reason")))
        )
    )


def case_reasons(cases: DataFrame) -> DataFrame:
    """AGG15: reason codes of each case (no rows for a sound case).

    cases: id, expected_kind, expected_code, expected_reason, observed_kind,
    observed_code, observed_reasons, evidence booleans (atomic_failure,
    consumer_a, consumer_b, true_removal, extractable_redraw,
    region_fidelity, independent_rendering, deterministic, failure_closed) and
    status.
    """
    editable = (F.col("expected_kind") == "capability") & (F.col("expected_code") != "readOnly")
    looked_at = editable | (F.col("expected_kind") == "crossConsumerControl")

    def per_case(code: str) -> Column:
        return F.concat(F.lit(code + ":"), F.col("id").cast("string"))

    rules = [
        F.when(~F.coalesce(outcome_matches(), F.lit(False)), per_case("unexpected-outcome")),
        F.when(~F.col("atomic_failure"), per_case("non-atomic-failure")),
        F.when(looked_at & ~(F.col("consumer_a") & F.col("consumer_b")), "missing-independent-validation"),
        F.when(editable & ~F.col("true_removal"), "missing-true-removal"),
        F.when(editable & ~F.col("extractable_redraw"), "missing-extractable-redraw"),
        F.when(looked_at & ~(F.col("region_fidelity") & F.col("independent_rendering")), "unedited-region-fidelity-failed"),
        F.when(looked_at & ~F.col("deterministic"), "determinism-failed"),
        F.when(~looked_at & ~F.col("failure_closed"), per_case("failure-not-closed")),
        F.when(F.col("status") != "pass", per_case("case-failed")),
    ]
    return cases.select(F.explode(F.array_compact(F.array(*rules))).alias("reason"))


def evaluate_gate(
    cases: DataFrame,
    required: DataFrame | None = None,
    thresholds: DataFrame | None = None,
    sweeps: DataFrame | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """AGG15: distinct reasons with the number of cases behind each.

    required: id; thresholds: consumer, separates; sweeps and limits: limit.
    An empty result is GO, see :func:`gate_decision`.
    """
    parts = [case_reasons(cases)]
    if required is not None:
        gone = required.select("id").distinct().join(cases.select("id"), "id", "left_anti")
        parts.append(gone.select(F.concat(F.lit("missing-case:"), F.col("id").cast("string")).alias("reason")))
    if thresholds is not None:
        parts.append(
            thresholds.filter(~F.col("separates")).select(
                F.concat(F.lit("visual-threshold-not-separated:"), F.col("consumer")).alias("reason")
            )
        )
    if sweeps is not None and limits is not None:
        unswept = limits.select("limit").distinct().join(sweeps.select("limit"), "limit", "left_anti")
        parts.append(unswept.select(F.concat(F.lit("missing-resource-sweep:"), F.col("limit")).alias("reason")))
    return union_all(*parts).groupBy("reason").agg(F.count(F.lit(1)).alias("hits"))


def gate_decision(reasons: DataFrame) -> DataFrame:
    """AGG15: one row: GO when no reason is left, with the number of reasons."""
    return reasons.agg(F.count(F.lit(1)).alias("reasons")).select(
        F.when(F.col("reasons") == 0, "GO").otherwise("NO_GO").alias("decision"), "reasons"
    )


def sweep_summary(measurements: DataFrame) -> DataFrame:
    """AGG16: measurements: limit, bound, value, run, accepted."""
    at_most = F.col("value") <= F.col("bound")
    return measurements.groupBy("limit").agg(
        F.max(F.when(F.col("accepted"), F.col("value"))).alias("largest_passing"),
        F.min(F.when(~F.col("accepted"), F.col("value"))).alias("smallest_rejected"),
        F.count_distinct("run").alias("repeats"),
        F.count_if(F.col("accepted") != at_most).alias("contradictions"),
    )


def agreement(extract_a: DataFrame, extract_b: DataFrame, expectation: DataFrame, key: str) -> DataFrame:
    """AGG17: extract_*: key, observed; expectation: key, expected."""
    a = extract_a.select(key, F.col("observed").alias("_a"))
    b = extract_b.select(key, F.col("observed").alias("_b"))
    joined = expectation.join(a, key, "left").join(b, key, "left")
    ok_a = F.col("_a").isNotNull() & F.col("_a").eqNullSafe(F.col("expected"))
    ok_b = F.col("_b").isNotNull() & F.col("_b").eqNullSafe(F.col("expected"))
    return joined.select(
        key, ok_a.alias("consumer_a"), ok_b.alias("consumer_b"), (ok_a & ok_b).alias("agreed")
    )

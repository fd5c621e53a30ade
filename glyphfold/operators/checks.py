"""Predicates and constraint checks (VAL1-VAL9)."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.operators.joins import union_all
from glyphfold.operators.ordered import Sequence
from glyphfold.session import broadcast_if_small

# Default resource limits, in the order they are tested.
LIMITS = {
    "file_bytes": 15 * 1024 * 1024,
    "objects": 2_000,
    "nesting_depth": 12,
    "stream_bytes": 4 * 1024 * 1024,
    "operations": 50_000,
    "image_pixels": 12_000_000,
    "processing_ms": 30_000,
}


def apply_limits(metrics: DataFrame, key: str, limits: dict[str, int] | None = None) -> DataFrame:
    """VAL1: the first exceeded limit per document; equal to the limit passes.

    metrics has one column per limit name; a null measure is not judged.  The
    limits are literals, so the gate is a projection without any join.
    """
    limits = LIMITS if limits is None else limits
    verdict = F.lit(None).cast("struct<resource:string,limit:bigint,observed:bigint>")
    for name, bound in reversed(list(limits.items())):
        verdict = F.when(
            F.col(name) > bound,
            F.struct(
                F.lit(name).alias("resource"), F.lit(bound).cast("bigint").alias("limit"), F.col(name).cast("bigint").alias("observed")
            ),
        ).otherwise(verdict)
    return metrics.select(key, verdict.alias("_v")).select(
        key, F.col("_v").isNull().alias("ok"), "_v.resource", "_v.limit", "_v.observed"
    )


def unique_violations(df: DataFrame, key: Seq[str], field: str) -> DataFrame:
    """VAL2: keys that occur more than once."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.lit(field).alias("field"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("subject"))
    )


def reference_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, field: str) -> DataFrame:
    """VAL2: child rows whose key no parent has; one row per missing key."""
    missing = (
        child.select(F.col(child_key).alias("_k"))
        .filter("_k is not null")
        .distinct()
        .join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    )
    return missing.select(F.lit(field).alias("field"), F.col("_k").cast("string").alias("subject"))


def row_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """VAL2: rows that break a row rule; a rule is true where the row is sound."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("field"), F.col(key).cast("string").alias("subject"))


def check_constraints(*parts: DataFrame) -> DataFrame:
    """VAL2: all breaches of several rules: field, subject."""
    return union_all(*parts)


def feature_flags(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """VAL3: sorted feature classes present per document (several rows may be one document)."""
    names = sorted(rules)
    flags = df.groupBy(key).agg(*[F.bool_or(F.coalesce(rules[n], F.lit(False))).alias(f"_{n}") for n in names])
    return flags.select(key, F.array_compact(F.array(*[F.when(F.col(f"_{n}"), n) for n in names])).alias("features"))


def policy_evidence(objects: DataFrame, key: str, direct: dict[str, Column], metadata: dict[str, Column]) -> DataFrame:
    """VAL4: per feature ``<name>`` and ``<name>_confidence``; counts for direct features.

    ``direct`` features are boolean per object row, ``metadata`` ones give an
    identifier or null.
    """
    aggs = [F.count_if(F.coalesce(t, F.lit(False))).alias(f"_{n}") for n, t in direct.items()]
    aggs += [F.max(t).alias(f"_{n}") for n, t in metadata.items()]
    found = objects.groupBy(key).agg(*aggs)
    cols = []
    for n in direct:
        cols += [
            (F.col(f"_{n}") > 0).alias(n),
            F.col(f"_{n}").alias(f"{n}_count"),
            F.when(F.col(f"_{n}") > 0, "direct").otherwise("notObserved").alias(f"{n}_confidence"),
        ]
    for n in metadata:
        cols += [
            F.col(f"_{n}").isNotNull().alias(n),
            F.col(f"_{n}").alias(f"{n}_id"),
            F.when(F.col(f"_{n}").isNotNull(), "metadata").otherwise("notObserved").alias(f"{n}_confidence"),
        ]
    return found.select(key, *cols)


def disclosure_codes(flags: dict[str, Column]) -> Column:
    """VAL4: codes of the observed features, in the given order."""
    return F.array_compact(F.array(*[F.when(seen, code) for code, seen in flags.items()]))


def check_contiguous(
    df: DataFrame, keys: Seq[str], order: Seq[str], start: str, end: str, total: Column, max_group_rows: int | None = None
) -> DataFrame:
    """VAL5: valid, overlap or invalid per key.

    Ranges must be non-empty, not negative, start where the last ended (the
    first at 0) and end at ``total``.  ``first_bad`` names the first breach.
    """
    rows = Sequence(df.withColumn("_total", total), keys, order, max_group_rows).lag("_prev", F.col(end)).done()
    prev = F.coalesce("_prev", F.lit(0))
    fault = (
        F.when((F.col(start) < 0) | (F.col(end) <= F.col(start)), "invalid")
        .when(F.col(start) < prev, "overlap")
        .when(F.col(start) > prev, "invalid")
    )
    judged = rows.withColumn("_fault", fault)
    place = F.struct(*order)
    first = F.min_by(F.col("_fault"), F.when(F.col("_fault").isNotNull(), place))
    where = F.min(F.when(F.col("_fault").isNotNull(), F.col(order[0])))
    return judged.groupBy(*keys).agg(
        first.alias("_first"), where.alias("first_bad"), F.max(end).alias("_end"), F.max("_total").alias("_total")
    ).select(
        *keys,
        F.coalesce("_first", F.when(F.col("_end") == F.col("_total"), "valid").otherwise("invalid")).alias("verdict"),
        "first_bad",
    )


def byte_entropy(df: DataFrame, key: str, text: str, min_unique: int = 16, min_bits: float = 1.0) -> DataFrame:
    """VAL6: distinct bytes (of UTF-8 text, or binary) and Shannon entropy per payload.

    Counts per (payload, byte) are combined map-side, so the shuffle carries
    at most 256 rows of a payload.
    """
    pairs = F.regexp_extract_all(F.hex(F.col(text).cast("binary")), F.lit(".."), F.lit(0))
    symbols = df.select(key, F.explode(pairs).alias("_c"))
    counts = symbols.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_n"))
    # H = log2(N) - sum(n*log2(n))/N needs one pass over the counts.
    agg = counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("uniq"),
        F.sum("_n").alias("_total"),
        F.sum(F.col("_n") * F.log2(F.col("_n"))).alias("_nlogn"),
    )
    entropy = F.log2(F.col("_total")) - F.col("_nlogn") / F.col("_total")
    return agg.select(
        key,
        "uniq",
        entropy.alias("entropy"),
        ((F.col("uniq") >= min_unique) & (entropy >= min_bits)).alias("useful"),
    )


def check_fd(df: DataFrame, key: Seq[str], value: str) -> DataFrame:
    """VAL7: keys with more than one value.  Values are compared by digest and
    (key, value) pairs are made distinct first, so hot keys combine map-side."""
    pairs = df.select(*key, F.sha2(F.col(value).cast("string"), 256).alias("_v")).distinct()
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("values")).filter("values > 1")


RELATIVE_PATH = r"^(?!/)(?!.*\\)(?!(?:.*/)?\.\.(?:/|$)).+$"


def check_allow_list(df: DataFrame, approved: DataFrame, name: str, fields: Seq[str]) -> DataFrame:
    """VAL8: the first field whose value differs from the approved tuple, or ``not-approved``."""
    want = approved.select(F.col(name).alias("_name"), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    joined = df.join(broadcast_if_small(want), F.col(name) == F.col("_name"), "left")
    breach = F.when(F.col("_known").isNull(), "not-approved")
    for f in fields:
        breach = breach.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f)
    return joined.withColumn("breach", breach).select(*df.columns, "breach")


def is_relative_path(path: Column) -> Column:
    """VAL8: relative, without ``..`` segments or backslashes."""
    return path.rlike(RELATIVE_PATH)


def class_coverage(cases: DataFrame, classes: str, required: DataFrame) -> DataFrame:
    """VAL9: per required class how many cases carry it; 0 = not covered."""
    have = cases.select(F.explode(classes).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("cases"))
    return required.join(have, "class", "left").select(
        "class", F.coalesce("cases", F.lit(0)).alias("cases"), F.col("cases").isNotNull().alias("covered")
    )

"""Capability classification (CLS1, CLS2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.functions.geometry import finite
from glyphfold.functions.text import ordered_reasons, without_subset_prefix
from glyphfold.operators.aggregates import KINDS, REASON_ORDER

# The fourteen standard font names.
STANDARD_FONTS = [
    "Courier",
    "Courier-Bold",
    "Courier-Oblique",
    "Courier-BoldOblique",
    "Helvetica",
    "Helvetica-Bold",
    "Helvetica-Oblique",
    "Helvetica-BoldOblique",
    "Times-Roman",
    "Times-Bold",
    "Times-Italic",
    "Times-BoldItalic",
    "Symbol",
    "ZapfDingbats",
]
# The reasons that alone make text read-only.
BLOCKING = [
    "replacementOverflow",
    "ambiguousTransform",
    "sharedResource",
    "outlinedText",
    "scannedContent",
    "fontEmbeddingProhibited",
    "unsupportedOperator",
    "malformedContent",
]
SAFE, SUBSTITUTE, READ_ONLY = KINDS


def _reasons(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _verdict(kind: str, reasons: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), reasons.alias("reasons"))


def sound_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return finite(x) & finite(y) & finite(w) & finite(h) & (w >= 0) & (h >= 0)


def classify_baseline(spans: DataFrame) -> DataFrame:
    """CLS1: adds ``base`` = struct<kind, reasons>.

    spans: inherited_kind, inherited_reasons, refs, writing_mode,
    sound_geometry, text (null = unknown), contiguous, font_base, font_subtype,
    embedded.
    """
    no_text = F.col("text").isNull()
    inherited = F.when(
        F.col("inherited_kind") == READ_ONLY, F.array_intersect(F.col("inherited_reasons"), _reasons(*BLOCKING))
    ).otherwise(F.array().cast("array<string>"))
    found = F.array_union(
        F.coalesce(inherited, F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(F.col("refs") > 1, "sharedResource"),
                F.when((F.col("writing_mode") != 0) | no_text, "unsupportedEncoding"),
                F.when(~F.col("sound_geometry"), "ambiguousTransform"),
            )
        ),
    )
    standard = without_subset_prefix(F.col("font_base"), ignore_case=False).isin(*STANDARD_FONTS)
    composite = (F.col("font_subtype") == "Type0") & F.col("embedded")
    rows = spans.withColumn("_found", found)
    base = (
        F.when(
            (F.col("writing_mode") != 0) | F.arrays_overlap("_found", _reasons(*BLOCKING)),
            _verdict(READ_ONLY, ordered_reasons(F.col("_found"), REASON_ORDER)),
        )
        .when(~F.col("contiguous"), _verdict(READ_ONLY, _reasons("unsupportedEncoding")))
        .when(no_text, _verdict(SUBSTITUTE, _reasons("substituteFontRequired", "unsupportedEncoding")))
        .when(composite | ~standard, _verdict(SUBSTITUTE, _reasons("substituteFontRequired")))
        .otherwise(_verdict(SAFE, _reasons("supportedExistingFont")))
    )
    return rows.withColumn("base", base).drop("_found")


def classify_replacement(spans: DataFrame) -> DataFrame:
    """CLS2: adds ``verdict`` = struct<kind, reasons, can_apply>.

    spans with ``base`` (CLS1), box x, y, w, h, replacement box rx, ry, rw, rh,
    can_encode, has_substitute, embeddable, accept_substitution.
    """

    def outcome(kind: str, reasons: Column, can_apply: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), reasons.alias("reasons"), can_apply.alias("can_apply"))

    no = F.lit(False)
    sound = sound_box(*[F.col(c) for c in ("rx", "ry", "rw", "rh")])
    return spans.withColumn(
        "verdict",
        F.when(F.col("base.kind") == READ_ONLY, outcome(READ_ONLY, F.col("base.reasons"), no))
        .when(~sound, outcome(READ_ONLY, _reasons("ambiguousTransform"), no))
        .when(
            (F.col("rw") > F.col("w")) | (F.col("rh") > F.col("h")),
            outcome(READ_ONLY, _reasons("replacementOverflow"), no),
        )
        .when(F.col("can_encode"), outcome(SAFE, _reasons("supportedExistingFont"), F.lit(True)))
        .when(~F.col("has_substitute"), outcome(READ_ONLY, _reasons("unsupportedEncoding"), no))
        .when(~F.col("embeddable"), outcome(READ_ONLY, _reasons("fontEmbeddingProhibited"), no))
        .otherwise(outcome(SUBSTITUTE, _reasons("substituteFontRequired"), F.col("accept_substitution"))),
    )

"""Guarded bulk replacement and its proofs (RDX1-RDX11, UDF1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence as Seq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphfold.functions.geometry import finite
from glyphfold.functions.keys import command_hash
from glyphfold.functions.text import code_points, nfc, nfc_needed, searchable, widened_end, widened_start
from glyphfold.operators.joins import bind_edits, resolve_requirements
from glyphfold.operators.sequences import apply_patches, char_ranges, common_prefix, style_runs
from glyphfold.plans import proof
from glyphfold.plans.classify import classify_replacement
from glyphfold.session import cut_lineage, spread
from glyphfold.sources.sinks import fingerprint_dataset

TOLERANCE = 1e-6


def plan_edits(edits: DataFrame, groups: DataFrame, revision: Column, on: Seq[str] = ("doc_id", "page")) -> DataFrame:
    """RDX1: what each edit would do; nothing is changed.

    edits: on, source_text, replacement, accept_substitution; groups: on,
    text, line_no, char_start, char_end, cap_kind, cap_reasons, x, y, w, h.
    A replacement fits when it is no wider than its target.
    """
    keep = ["line_no", "char_start", "char_end", "cap_kind", "cap_reasons", "w"]
    bound = bind_edits(edits, groups, on, "source_text", "text", keep)
    raw = F.col("replacement")
    bound = bound.withColumn("replacement", F.coalesce(nfc(F.when(nfc_needed(raw), raw)), raw))
    fits = F.length("replacement") <= F.col("w") + TOLERANCE
    needs = F.col("cap_kind") == "replacementWithSubstitution"
    missing = F.when(needs & ~F.col("accept_substitution"), F.array(F.lit("substitution"))).otherwise(
        F.array().cast("array<string>")
    )
    outcome = (
        F.when(F.col("outcome") != "RESOLVED", F.col("outcome"))
        .when(F.col("cap_kind") == "readOnly", "READ_ONLY_SPAN")
        .when(~fits, "REPLACEMENT_OVERFLOW")
        .when(needs & ~F.col("accept_substitution"), "FONT_CONSENT_REQUIRED")
        .otherwise("PLANNED")
    )
    digest = F.sha2("source_text", 256)
    address = F.concat_ws(":", F.col("line_no").cast("string"), F.col("char_start").cast("string"), F.col("char_end").cast("string"))
    return bound.withColumns(
        {
            "plan_outcome": outcome,
            "fits": fits,
            "missing_consents": missing,
            "source_digest": digest,
            "base_revision": revision,
            "next_revision": revision + 1,
            "command_hash": command_hash(
                revision,
                F.col("page"),
                address,
                F.col("replacement"),
                digest,
                F.col("cap_kind"),
                F.when(F.col("accept_substitution"), F.array(F.lit("substitution"))).otherwise(
                    F.array().cast("array<string>")
                ),
            ),
        }
    ).drop("outcome")


def plan_with_fonts(
    edits: DataFrame, groups: DataFrame, fonts: DataFrame, revision: Column, on: Seq[str] = ("doc_id", "page"), cross: float = 0.0
) -> DataFrame:
    """RDX1 on its own parts: bind, resolve a font, classify, fit, hash; nothing is changed.

    edits: on, source_text, replacement, accept_substitution, font_id (an
    explicit choice, or null: the source's font is to be kept); groups: on,
    text, line_no, char_start, char_end, base (CLS1), name_key, family_key,
    subfamily (nullable), weight, italic, x, y, w, h, dx, dy, advance (width of
    a code point); fonts: the catalogue of JON5 with ``embeddable``.

    A chosen font must cover the replacement.  A kept font is a requirement
    (JON5); a substitute needs consent.  The replacement's box must fit the
    source's region (RDX5, ``cross`` is the largest extent across the baseline).
    """
    keep = ["line_no", "char_start", "char_end", "base", "name_key", "family_key", "subfamily", "weight", "italic", "x", "y", "w", "h", "dx", "dy", "advance"]
    bound = bind_edits(edits, groups, on, "source_text", "text", keep)
    raw = F.col("replacement")
    bound = bound.withColumn("replacement", F.coalesce(nfc(F.when(nfc_needed(raw), raw)), raw))
    style = ["name_key", "family_key", "subfamily", "weight", "italic"]
    need = code_points(F.col("replacement"))
    bound = cut_lineage(bound.withColumn("_need", need).withColumn("_asked", F.xxhash64(*style, "_need")))
    # Equal requirements are resolved once.
    asked = bound.filter((F.col("outcome") == "RESOLVED") & F.col("font_id").isNull()).select("_asked", *style, "_need").distinct()
    none = F.lit(None).cast("string")
    reqs = asked.select(F.col("_asked").alias("req_id"), *style, F.col("_need").alias("code_points"), none.alias("hash"), none.alias("metrics"))
    kept = resolve_requirements(reqs, fonts).select(
        F.col("req_id").alias("_asked"), F.col("kind").alias("_kind"), F.col("font_id").alias("_found")
    )
    joined = bound.join(kept, "_asked", "left").withColumn("_font", F.coalesce("font_id", "_found"))
    known = fonts.select(F.col("font_id").alias("_font"), F.col("code_points").alias("_cover"), "embeddable")
    joined = joined.join(known, "_font", "left")
    chosen = F.col("font_id").isNotNull()
    covers = F.coalesce(F.size(F.array_except("_need", "_cover")) == 0, F.lit(False))
    width = F.length("replacement") * F.col("advance")
    area = fit_region(_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.lit(cross), F.col("dx"), F.col("dy"))
    own = (~chosen & F.col("_kind").isin("exact", "compatible-version")) | (chosen & covers)
    ready = joined.withColumns(
        {
            "rx": F.col("x"),
            "ry": F.col("y"),
            "rw": width,
            "rh": F.col("h"),
            "can_encode": F.coalesce(own, F.lit(False)) & (F.col("base.kind") == "safeReplacement"),
            "has_substitute": F.when(chosen, covers).otherwise(F.coalesce(F.col("_kind") != "unavailable", F.lit(False))),
            "embeddable": F.coalesce("embeddable", F.lit(False)),
        }
    )
    judged = classify_replacement(ready).withColumn("fits", fits(_box(F.col("x"), F.col("y"), width, F.col("h")), area))
    reasons, consent = F.col("verdict.reasons"), F.array(F.lit("substitution"))
    empty = F.array().cast("array<string>")
    substitutes = F.col("verdict.kind") == "replacementWithSubstitution"
    outcome = (
        F.when(F.col("outcome") != "RESOLVED", F.col("outcome"))
        .when(F.col("base.kind") == "readOnly", "READ_ONLY_SPAN")
        .when(F.array_contains(reasons, "ambiguousTransform"), "READ_ONLY_SPAN")
        .when(F.array_contains(reasons, "replacementOverflow") | ~F.col("fits"), "REPLACEMENT_OVERFLOW")
        .when(F.array_contains(reasons, "unsupportedEncoding"), "FONT_UNAVAILABLE")
        .when(F.array_contains(reasons, "fontEmbeddingProhibited"), "FONT_EMBEDDING_PROHIBITED")
        .when(~F.col("verdict.can_apply"), "FONT_CONSENT_REQUIRED")
        .otherwise("PLANNED")
    )
    address = F.concat_ws(":", *[F.col(c).cast("string") for c in ("line_no", "char_start", "char_end")])
    digest = F.sha2("source_text", 256)
    hashed = command_hash(
        revision, F.col("page"), address, F.col("replacement"), digest, F.coalesce(F.col("_font").cast("string"), F.lit("")),
        F.when(F.col("accept_substitution"), consent).otherwise(empty),
    )
    return judged.withColumns(
        {
            "plan_outcome": outcome,
            "font_id": F.col("_font"),
            "missing_consents": F.when(substitutes & ~F.col("verdict.can_apply"), consent).otherwise(empty),
            "source_digest": digest,
            "base_revision": revision,
            "next_revision": revision + 1,
            "command_hash": F.when(F.col("outcome") == "RESOLVED", hashed),
        }
    ).drop("outcome", "_asked", "_need", "_kind", "_found", "_font", "_cover", "rx", "ry", "rw", "rh", "can_encode", "has_substitute")


def apply_edits(docs: DataFrame, plan: DataFrame, selection: Seq[str] = ("doc_id", "selection_id")) -> tuple[DataFrame, DataFrame]:
    """RDX2: apply planned edits where the source still matches.

    docs: doc_id, text; plan: doc_id, selection_id, char_start, char_end,
    source_digest, replacement, plan_outcome.  All slices of a selection or
    none: a slice refused at planning refuses the selection with its outcome, a
    slice whose source has changed makes it STALE_REVISION, and slices of a
    document that overlap make the selections they belong to READ_ONLY_SPAN.
    Returns (documents, outcomes): outcomes has one row per plan row, and every
    APPLIED row has changed its range.
    """
    start, end = F.col("char_start"), F.col("char_end")
    found = F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))
    sound = (start >= 0) & (end > start) & (end <= F.length("text"))
    checked = plan.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn(
        "_match", F.coalesce(sound & (F.sha2(found, 256) == F.col("source_digest")), F.lit(False))
    ).drop("text")
    whole = Window.partitionBy(*selection)
    planned = F.col("plan_outcome") == "PLANNED"
    refused = F.min(F.when(~planned, F.col("plan_outcome"))).over(whole)
    stale = F.bool_or(planned & ~F.col("_match")).over(whole)
    judged = checked.withColumn("_why", F.coalesce(refused, F.when(stale, "STALE_REVISION")))
    # Only slices that would be applied can be in each other's way.
    alive = F.col("_why").isNull()
    along = Window.partitionBy("doc_id", alive).orderBy("char_start", "char_end")
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(along)
    meets = alive & (F.coalesce(before > start, F.lit(False)) | F.coalesce(after < end, F.lit(False)))
    judged = judged.withColumn("_meets", meets).withColumn("_clash", F.bool_or("_meets").over(whole))
    outcome = (
        F.when(~planned, F.col("plan_outcome")).when(~alive, F.col("_why")).when(F.col("_clash"), "READ_ONLY_SPAN").otherwise("APPLIED")
    )
    outcomes = judged.withColumn("outcome", outcome).drop("_match", "_why", "_meets", "_clash")
    patches = outcomes.filter("outcome = 'APPLIED'").select(
        "doc_id", start.cast("int").alias("start"), end.cast("int").alias("end"), "replacement"
    )
    patched = apply_patches(docs, patches, ["doc_id"], "text")
    return patched.withColumn("text", F.col("patched")).drop("patched"), outcomes


def excise(atoms: DataFrame, ranges: DataFrame, keys: Seq[str], index: str) -> DataFrame:
    """RDX3: prefix, gap and suffix of a run when [start, end) is removed.

    atoms: keys, index, text, advance, adjust_before (nullable), cluster;
    ranges: keys, start, end.  The gap is the removed advance with interior
    adjustments; a range that cuts a cluster says ``expandRequired``.
    """
    joined = atoms.join(ranges, list(keys))
    i, s, e = F.col(index), F.col("start"), F.col("end")
    inside = (i >= s) & (i < e)
    pieces = joined.withColumns(
        {"_pre": F.when(i < s, F.col("text")), "_cut": F.when(inside, F.col("text")), "_suf": F.when(i >= e, F.col("text"))}
    )

    def joined_text(col: str) -> Column:
        return F.coalesce(F.expr(f"listagg({col}, '') WITHIN GROUP (ORDER BY {index})"), F.lit(""))

    clusters = pieces.groupBy(*keys, "cluster").agg(
        F.count_if(inside).alias("_in"), F.count_if(~inside).alias("_out")
    ).groupBy(*keys).agg(F.bool_or((F.col("_in") > 0) & (F.col("_out") > 0)).alias("_partial"))
    sums = pieces.groupBy(*keys).agg(
        joined_text("_pre").alias("prefix"),
        joined_text("_cut").alias("removed"),
        joined_text("_suf").alias("suffix"),
        F.sum(F.when(inside, F.col("advance")).otherwise(0.0)).alias("_adv"),
        F.sum(F.when((i > s) & (i < e), F.coalesce("adjust_before", F.lit(0.0))).otherwise(0.0)).alias("_adj"),
    )
    return sums.join(clusters, list(keys)).select(
        *keys,
        F.when(F.col("_partial"), "expandRequired").otherwise("preserved").alias("outcome"),
        "prefix",
        "removed",
        "suffix",
        (F.col("_adv") + F.col("_adj")).alias("gap"),
    )


def _pieces_to_runs(pieces: DataFrame, keys: Seq[str], style: Seq[str]) -> DataFrame:
    """Merge neighbours of equal presentation (pieces: keys, _part, run_no, run_text, style)."""
    ordered = pieces.withColumn("_ord", F.col("run_no").cast("bigint") * 3 + F.col("_part"))
    runs = style_runs(ordered, keys, "_ord", style, "run_text")
    return runs.drop("run_start", "run_end")


def _with_offsets(runs: DataFrame, edits: DataFrame, keys: Seq[str]) -> tuple[DataFrame, DataFrame]:
    """Runs with char ranges, and edits with ranges widened to whole clusters."""
    ranged = char_ranges(runs, keys, ["run_no"], "run_text")
    whole = runs.groupBy(*keys).agg(F.expr("listagg(run_text, '') WITHIN GROUP (ORDER BY run_no)").alias("_all"))
    asked = edits.join(whole, list(keys))
    n = F.length("_all")
    lo = F.greatest(F.lit(0), F.least(F.col("start"), n))
    hi = F.greatest(lo, F.least(F.col("end"), n))
    asked = asked.withColumns({"_lo": lo, "_hi": hi, "_n": n})
    empty = F.col("_lo") == F.col("_hi")
    widened = asked.withColumns(
        {
            "_s": F.when(empty, F.col("_lo")).otherwise(widened_start(F.col("_all"), F.col("_lo"))),
            "_e": F.when(empty, F.col("_hi")).otherwise(widened_end(F.col("_all"), F.col("_hi"))),
        }
    )
    return ranged, widened.drop("_all", "_lo", "_hi", "start", "end")


def edit_outcomes(edits: DataFrame, keys: Seq[str]) -> DataFrame:
    """RDX4: keys, edits, outcome: EDITED, or READ_ONLY_SPAN where several edits ask for one run list."""
    counted = edits.groupBy(*keys).agg(F.count(F.lit(1)).alias("edits"))
    return counted.withColumn("outcome", F.when(F.col("edits") == 1, "EDITED").otherwise("READ_ONLY_SPAN"))


def _single_edits(edits: DataFrame, keys: Seq[str]) -> DataFrame:
    # Counted where they lie; null keys are a run list too.
    counted = edits.withColumn("_edits", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.filter("_edits = 1").drop("_edits")


def replace_in_runs(runs: DataFrame, edits: DataFrame, keys: Seq[str], style: Seq[str]) -> DataFrame:
    """RDX4: replace one range per run list; text takes the style before it.

    runs: keys, run_no, run_text, style columns (with the source run index
    among them); edits: keys, start, end, inserted.  A run list with several
    edits is left as it is; :func:`edit_outcomes` names it.
    """
    ranged, asked = _with_offsets(runs, _single_edits(edits, keys), keys)
    joined = ranged.join(asked, list(keys), "left")
    s, e = F.col("_s"), F.col("_e")
    cut_left = F.least(F.col("char_end"), s) - F.col("char_start")
    cut_right = F.greatest(F.col("char_start"), e) - F.col("char_start")
    text = F.col("run_text")
    untouched = s.isNull()
    # In front of the insertion: part 0, behind it: part 2, both in run order.
    two = F.array(
        F.struct(F.lit(0).alias("p"), F.when(untouched, text).when(cut_left > 0, F.substring(text, F.lit(1), cut_left.cast("int"))).alias("t")),
        F.struct(
            F.lit(2).alias("p"),
            F.when(~untouched & (cut_right < F.length(text)), F.substring(text, (cut_right + 1).cast("int"), F.length(text))).alias("t"),
        ),
    )
    kept = joined.select(*keys, "run_no", *style, F.explode(two).alias("_x")).select(
        *keys, "run_no", *style, F.col("_x.p").alias("_part"), F.col("_x.t").alias("run_text")
    ).filter("run_text is not null and run_text <> ''")
    at = F.when((s == e) & (s > 0), s - 1).otherwise(s)
    template = (
        joined.filter(~untouched)
        .withColumn("_owns", (at >= F.col("char_start")) & (at < F.col("char_end")))
        .groupBy(*keys)
        .agg(
            F.coalesce(
                F.min_by(F.struct("run_no", *style), F.when(F.col("_owns"), F.col("run_no"))),
                F.max_by(F.struct("run_no", *style), F.col("run_no")),
            ).alias("_t"),
            F.first("inserted").alias("inserted"),
            F.bool_and((s == 0) & (e >= F.col("_n"))).alias("_all_gone"),
        )
        .filter("inserted <> '' or _all_gone")
        .select(*keys, "_t.*", F.lit(1).alias("_part"), F.col("inserted").alias("run_text"))
    )
    # Parts sort before run numbers: all of the front, the insertion, all of the back.
    pieces = kept.unionByName(template)
    top = F.lit(1 << 40)
    ordered = pieces.withColumn("run_no", F.col("_part") * top + F.col("run_no").cast("bigint")).withColumn("_part", F.lit(0))
    return _pieces_to_runs(ordered, keys, style)


def format_runs(runs: DataFrame, edits: DataFrame, keys: Seq[str], style: Seq[str], patch: dict[str, Column]) -> DataFrame:
    """RDX4: restyle one range per run list; equal neighbours merge again.

    As in :func:`replace_in_runs`, a run list with several edits is left as it is.
    """
    ranged, asked = _with_offsets(runs, _single_edits(edits, keys), keys)
    joined = ranged.join(asked, list(keys), "left")
    text = F.col("run_text")
    a = F.least(F.greatest(F.coalesce("_s", F.lit(0)) - F.col("char_start"), F.lit(0)), F.length(text))
    b = F.least(F.greatest(F.coalesce("_e", F.lit(0)) - F.col("char_start"), F.lit(0)), F.length(text))
    joined = joined.withColumns({"_a": a.cast("int"), "_b": F.greatest(a, b).cast("int")})
    three = F.array(
        F.struct(F.lit(0).alias("p"), F.substring(text, F.lit(1), F.col("_a")).alias("t")),
        F.struct(F.lit(1).alias("p"), F.substring(text, F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("t")),
        F.struct(F.lit(2).alias("p"), F.substring(text, F.col("_b") + 1, F.length(text)).alias("t")),
    )
    parts = joined.select(*joined.columns, F.explode(three).alias("_x")).filter("_x.t <> ''")
    styled = {c: F.when(F.col("_x.p") == 1, patch[c]).otherwise(F.col(c)) for c in patch}
    pieces = parts.withColumns(styled).select(
        *keys, "run_no", *style, F.col("_x.p").alias("_part"), F.col("_x.t").alias("run_text")
    )
    return _pieces_to_runs(pieces, keys, style)


def fits(box: Column, region: Column) -> Column:
    """RDX5: a box inside the allowed region, within the tolerance."""
    return (
        (box["x"] >= region["x"] - TOLERANCE)
        & (box["y"] >= region["y"] - TOLERANCE)
        & (box["x"] + box["w"] <= region["x"] + region["w"] + TOLERANCE)
        & (box["y"] + box["h"] <= region["y"] + region["h"] + TOLERANCE)
    )


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def fit_region(box: Column, cross: Column, dx: Column, dy: Column) -> Column:
    """RDX5: the region padded by the largest glyph extent across the baseline."""
    length = F.hypot(dx, dy)
    usable = finite(length) & (length > 0)
    px = F.when(usable, F.abs(dy / length) * cross).otherwise(0.0)
    py = F.when(usable, F.abs(dx / length) * cross).otherwise(0.0)
    return _box(box["x"] - px, box["y"] - py, box["w"] + 2 * px, box["h"] + 2 * py)


def auto_fit(need: Column, region: Column, max_width: Column, eligible: Column) -> Column:
    """RDX5: the wider width when width is the only problem and there is room, else null."""
    sound = finite(max_width)
    for b in (need, region):
        for f in ("x", "y", "w", "h"):
            sound = sound & finite(b[f])
    too_wide = need["w"] > region["w"] + TOLERANCE
    room = need["w"] <= max_width + TOLERANCE
    placed = (
        (need["x"] >= region["x"] - TOLERANCE)
        & (need["y"] >= region["y"] - TOLERANCE)
        & (need["y"] + need["h"] <= region["y"] + region["h"] + TOLERANCE)
    )
    return F.when(eligible & sound & too_wide & room & placed, F.least(need["w"], max_width))


def spacing_scale(extent: Column, baseline_scale: Column, advance: Column) -> Column:
    """RDX6: source extent over new advance, 1 when it cannot be told."""
    sound = finite(extent) & finite(baseline_scale) & finite(advance) & (extent > 0) & (baseline_scale > 0) & (advance > 0)
    scale = extent / F.when(sound, baseline_scale * advance)
    return F.when(finite(scale) & (scale > 0), scale).otherwise(1.0)


def profile_prefix(
    source: DataFrame, new: DataFrame, keys: Seq[str], pos: str, glyph: str, advance: str, lie: tuple[int, str] | None = None
) -> DataFrame:
    """RDX6: the source's advances on the glyphs that a new run begins with as the source did.

    source: keys, pos (from 0), glyph, advance; new: keys, pos, glyph.  A profile
    with an advance that is not positive and finite is of no use and gives none.
    ``lie`` (a number and a column of ``keys``) says how the glyphs are dealt out:
    what is found per run goes there, and glyphs stay.
    """
    good = finite(F.col(advance)) & (F.col(advance) > 0)
    usable = source.groupBy(*keys).agg(F.every(F.coalesce(good, F.lit(False))).alias("_usable")).filter("_usable").drop("_usable")
    same = common_prefix(source, new, keys, pos, glyph).select(*keys, "prefix").join(usable, list(keys))
    if lie:
        same = same.repartition(*lie)
    return source.join(same, list(keys)).filter(F.col(pos) < F.col("prefix")).drop("prefix")


def prove_removed(after: DataFrame, edits: DataFrame, on: Seq[str], text: str, source: str) -> DataFrame:
    """RDX7: per edit: how many texts of its stream still hold the removed source.

    All sources of a stream are searched in one pass over its texts.
    """
    asked = edits.select(*on, source).distinct()
    found = proof.texts_holding(after, asked, on, text, source)
    keys = [*on, source]
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    joined = asked.alias("e").join(found.alias("f"), same, "left")
    left = F.coalesce("f.remaining", F.lit(0)).cast("bigint")
    return joined.select(*[F.col(f"e.{c}").alias(c) for c in keys], left.alias("remaining"), (left == 0).alias("removed"))


def extraction_evidence(
    items: DataFrame, expectations: DataFrame, on: Seq[str], order: str, strict: bool = True, region: str | None = None,
    lie: tuple[int, str] | None = None,
) -> DataFrame:
    """RDX8: text at the target against the rest of the page, spaces ignored.

    items: on, order, text, x, y, w, h; expectations: on, exp_id, x, y, w, h,
    old_text, new_text, expected_outside.  ``strict`` asks for equality at the
    target when the new text contains the old one.  ``region`` names a struct
    column x0, y0, x1, y1 of the expectations: then ``cells`` digests the places
    and texts of all items outside it, as sums of hashes.  A page meets all its
    expectations at once (see :mod:`glyphfold.plans.proof`); ``lie`` as there.
    """
    return _evidence(proof.page_items(items, on, order), expectations, on, strict, region, lie)


def _evidence(pages: DataFrame, expectations: DataFrame, on: Seq[str], strict: bool = True, region: str | None = None, lie: tuple[int, str] | None = None) -> DataFrame:
    kept = ["cells"] if region else []
    asked = expectations.select(
        *on, "exp_id", searchable(F.col("old_text")).alias("_old"), searchable(F.col("new_text")).alias("_new"), "expected_outside"
    )
    seen = proof.look_up(pages, expectations, on, region, lie).join(asked, [*on, "exp_id"])
    old, new = F.coalesce("_old", F.lit("")), F.coalesce("_new", F.lit(""))
    clean = seen.withColumn("target_text", searchable(F.col("target")))
    target = F.col("target_text")
    absent = F.when(F.length(old) == 0, True)
    if strict:
        absent = absent.when(new.contains(old), target == new)
    absent = absent.otherwise(~target.contains(old))
    return clean.select(
        *on,
        "exp_id",
        "target_text",
        absent.alias("old_absent"),
        ((F.length(new) == 0) | target.contains(new)).alias("new_present"),
        "old_outside",
        (F.col("old_outside") == F.col("expected_outside")).alias("outside_preserved"),
        "outside_digest",
        *kept,
    ).withColumn("valid", F.col("old_absent") & F.col("new_present") & F.col("outside_preserved"))


STRUCTURE = ("streams_ok", "marked", "fonts_ok", "generated_ok")
CONTENT = ("old_absent", "new_present", "geometry_ok", "outside_text_ok", "outside_cells_ok")


def structure_checks(before: DataFrame, after: DataFrame, commands: DataFrame, fonts: DataFrame) -> DataFrame:
    """RDX9: (doc_id, checks_of): the checks of a candidate's structure, one row per command.

    before: doc_id, stream_id, content; after: the same and ``mark`` (command
    hash of a generated stream, else null); commands: doc_id, mutated (array of
    stream ids), command_hash, fonts (array of names); fonts: doc_id, font
    (present in the candidate).  Streams outside the mutated ones are as they
    were; exactly one generated stream carries the command's hash, and there is
    no other new stream; the fonts asked for are there.
    """
    b = before.select("doc_id", "stream_id", F.sha2("content", 256).alias("_b"))
    a = after.select("doc_id", "stream_id", F.sha2("content", 256).alias("_a"), "mark")
    met = b.join(a, ["doc_id", "stream_id"], "full_outer").join(commands.drop("fonts"), "doc_id")
    source = F.col("_b").isNotNull()
    kept = F.array_contains("mutated", F.col("stream_id")) | F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    matched = ~source & F.coalesce(F.col("mark") == F.col("command_hash"), F.lit(False))
    per_doc = met.groupBy("doc_id").agg(
        F.every(~source | kept).alias("streams"), F.count_if(matched).alias("_marks"), F.count_if(~source).alias("_new")
    )
    have = fonts.select("doc_id", "font").distinct()
    lacking = (
        commands.select("doc_id", F.explode("fonts").alias("font"))
        .join(have, ["doc_id", "font"], "left_anti")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("_lacking"))
    )
    joined = commands.select("doc_id").join(per_doc, "doc_id", "left").join(lacking, "doc_id", "left")
    checks = {
        "streams_ok": F.col("streams"),
        "marked": F.col("_marks") == 1,
        "fonts_ok": F.col("_lacking").isNull(),
        "generated_ok": (F.col("_marks") == 1) & (F.col("_new") == 1),
    }
    return joined.select("doc_id", proof.check_set(checks).alias("checks_of"))


def validate_structure(before: DataFrame, after: DataFrame, commands: DataFrame, fonts: DataFrame) -> DataFrame:
    """RDX9: structure alone (see :func:`structure_checks`), with check codes and a verdict of its own."""
    checked, of = structure_checks(before, after, commands, fonts), F.col("checks_of")
    return checked.select("doc_id", proof.codes(of, STRUCTURE).alias("checks"), proof.holds(of, *STRUCTURE).alias("valid"))


def validate_candidates(
    before: DataFrame,
    after: DataFrame,
    expectations: DataFrame,
    page_before: DataFrame,
    page_after: DataFrame,
    order: str,
    validator: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    structure: DataFrame | None = None,
    lie: tuple[int, str] | None = None,
) -> DataFrame:
    """RDX9: check codes and one verdict per expectation.

    Outside text must be identical, page geometry identical, and atoms outside
    the widened region identical; with ``structure`` (doc_id, checks_of, see
    :func:`structure_checks`) the document's structure must hold too.  Partial
    check sets of texts, pages and documents are merged by one aggregate, and a
    check that nobody made did not hold.  ``validator`` (UDF1) replaces the
    built-in verdict: it gets the check columns of one page and returns the same
    rows with ``valid``.  ``lie`` is as in :func:`look_up`, for the atoms of both sides.
    """
    on = ["doc_id", "page"]
    key = [*on, "exp_id"]
    # What the source page shows outside each target, and the region that belongs to it.
    plain = expectations.withColumn("old_text", F.lit(""))
    source = proof.look_up(proof.page_items(before, on, order), plain, on, lie=lie).select(
        *key, F.col("region").alias("_wide"), F.col("outside_digest").alias("_src"), F.col("cells").alias("_cells")
    )
    widened = cut_lineage(expectations.join(source, key))
    new = _evidence(proof.page_items(after, on, order), widened, on, region="_wide", lie=lie).join(widened.select(*key, "_src", "_cells"), key)
    text = new.select(
        *key,
        proof.check_set(
            {
                "old_absent": F.col("old_absent"),
                "new_present": F.col("new_present"),
                "outside_text_ok": F.col("_src") == F.col("outside_digest"),
                "outside_cells_ok": F.col("_cells") == F.col("cells"),
            }
        ).alias("checks_of"),
    )
    geometry = page_before.select(*on, F.struct("page_width", "page_height").alias("_g0")).join(
        page_after.select(*on, F.struct("page_width", "page_height").alias("_g1")), on, "full_outer"
    )
    of_page = geometry.select(*on, proof.check_set({"geometry_ok": F.col("_g0").eqNullSafe(F.col("_g1"))}).alias("checks_of"))
    # Verdicts of pages and documents are those of each of their expectations.
    asked = widened.select(*key)
    parts, names = [text, asked.join(of_page, on)], CONTENT
    if structure is not None:
        parts, names = [*parts, asked.join(structure, "doc_id")], CONTENT + STRUCTURE
    of = F.col("checks_of")
    merged = proof.merge_checks(parts, key)
    out = merged.select(
        *key,
        *[proof.holds(of, name).alias(name) for name in names],
        proof.codes(of, names).alias("checks"),
        proof.holds(of, *names).alias("valid"),
    )
    if validator is None:
        return out
    # Checks are narrow and a call a page is not: a fixed number of partitions keeps every core at work.
    return spread(out, *on).groupBy(*on).applyInPandas(validator, out.schema)


MARKERS = ("glyphfold:2", "glyphfold:1")


def mark(df: DataFrame, text: str, command: Column, tags: Seq[str] = MARKERS) -> DataFrame:
    """RDX10: add provenance (current tag, digest of the actual text, command hash)."""
    return df.withColumn(
        "provenance",
        F.struct(F.lit(tags[0]).alias("tag"), F.sha2(text, 256).alias("text_digest"), command.alias("command_hash")),
    )


def wrapper_state(items: DataFrame, keys: Seq[str], order: str, text: str, tags: Seq[str] = MARKERS) -> DataFrame:
    """RDX10: ``none``, ``wrapped`` or ``malformed`` per payload.

    A wrapper is an opening item ``<tag>`` in the first place and ``</tag>`` in
    the last; the current and earlier tags count.  Half of one is malformed.
    """
    opens, closes = [f"<{t}>" for t in tags], [f"</{t}>" for t in tags]
    marks = items.withColumns({"_o": F.col(text).isin(*opens), "_c": F.col(text).isin(*closes)})
    agg = marks.groupBy(*keys).agg(
        F.count_if("_o").alias("_no"),
        F.count_if("_c").alias("_nc"),
        F.min_by(F.col(text), F.col(order)).alias("_first"),
        F.max_by(F.col(text), F.col(order)).alias("_last"),
    )
    paired = F.substring(F.col("_first"), F.lit(2), F.length("_first")) == F.substring(F.col("_last"), F.lit(3), F.length("_last"))
    framed = F.col("_first").isin(*opens) & F.col("_last").isin(*closes) & paired
    return agg.select(
        *keys,
        F.when((F.col("_no") == 0) & (F.col("_nc") == 0), "none")
        .when((F.col("_no") == 1) & (F.col("_nc") == 1) & framed, "wrapped")
        .otherwise("malformed")
        .alias("state"),
    )


def not_yet_marked(df: DataFrame, done: DataFrame, key: Seq[str]) -> DataFrame:
    """RDX10: the rows no earlier run has processed."""
    return df.join(done.select(*key), list(key), "left_anti")


def prove_deterministic(run_a: DataFrame, run_b: DataFrame, keys: Seq[str]) -> DataFrame:
    """RDX11: per key whether two runs gave the same content."""
    a = fingerprint_dataset(run_a, keys).withColumnRenamed("sha256", "_a").withColumnRenamed("rows", "_ra")
    b = fingerprint_dataset(run_b, keys).withColumnRenamed("sha256", "_b").withColumnRenamed("rows", "_rb")
    return a.join(b, list(keys), "full_outer").select(
        *keys, (F.col("_a").eqNullSafe(F.col("_b")) & F.col("_ra").eqNullSafe(F.col("_rb"))).alias("same")
    )

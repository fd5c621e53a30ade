"""Window and sequence operators (WIN1-WIN19).

Keys of pages and lines are bounded by the operation limit, so plain windows
are used for them; operators that also serve entity keys take
``max_group_rows`` (see :mod:`glyphfold.operators.ordered`).
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphfold.functions.geometry import finite
from glyphfold.functions.text import ASCII_ONLY, grapheme_list
from glyphfold.operators.ordered import Sequence, fold_sorted
from glyphfold.session import cut_lineage

PARALLEL = math.cos(math.radians(1.0))
LINE = ("doc_id", "page", "line_no")


def place(
    df: DataFrame, keys: Seq[str], order: Seq[str], advance: Column, adjust: Column, max_group_rows: int | None = None
) -> DataFrame:
    """WIN1: ``start`` and ``gap_before``; ``adjust`` is the signed move before a glyph."""
    return (
        Sequence(df, keys, order, max_group_rows)
        .running_sum("_adv", advance, inclusive=False)
        .running_sum("_adj", F.coalesce(adjust, F.lit(0.0)))
        .with_column("start", F.col("_adv") + F.col("_adj"))
        .with_column("gap_before", F.when(adjust != 0, adjust))
        .done()
        .drop("_adv", "_adj")
    )


def line_bands(atoms: DataFrame) -> DataFrame:
    """``atoms`` with ``_visit``, ``_side``, ``_band`` and ``_plain``: groups that cannot share a line (see :func:`assign_lines`).

    Level atoms are visited downwards.  Where the next one lies farther below
    the last than any line so far can reach, a band ends.  A band is plain, one
    line, if even the smallest reach in it spans it.  Turned atoms are a side of
    their own; nearly level ones could meet both, so their pages stay whole.
    """
    page = Window.partitionBy("doc_id", "page")
    level = (F.col("dy") == 0) & (F.col("dx") >= PARALLEL)
    nearly = (F.col("dy") != 0) & (F.col("dx") >= PARALLEL)
    whole = F.coalesce(F.bool_or(nearly).over(page), F.lit(False))
    # Numbered first: one sort serves both windows.
    visited = atoms.withColumn("_visit", F.row_number().over(page.orderBy(F.col("by").desc(), "bx", "atom_id")))
    sided = visited.withColumn("_side", F.when(whole, 2).when(level, 0).otherwise(1))
    along = Window.partitionBy("doc_id", "page", "_side").orderBy("_visit")
    tallest = F.max("h").over(along.rowsBetween(Window.unboundedPreceding, -1))
    below = F.lag("by").over(along) - F.col("by")
    ends = (F.col("_side") == 0) & F.coalesce(below > F.greatest(F.lit(1.0), 0.35 * tallest), F.lit(False))
    banded = sided.withColumn("_ends", ends.cast("int")).withColumn(
        "_band", F.sum("_ends").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    band = Window.partitionBy("doc_id", "page", "_side", "_band")
    spans = F.max("by").over(band) - F.min("by").over(band)
    plain = (F.col("_side") == 0) & (spans <= F.greatest(F.lit(1.0), 0.35 * F.min("h").over(band)))
    return banded.withColumn("_plain", F.coalesce(plain, F.lit(False))).drop("_ends")


def plain_baselines(atoms: DataFrame) -> DataFrame:
    """doc_id, page, by, _plain, _level, line_id: the distinct baselines of pages, by the rules of :func:`line_bands`.

    Atoms on one baseline share a band, so bands are found on baselines, of which
    a line has few.  ``_level`` pages hold level atoms and plain bands only: there
    a band is a line, and ``line_id`` its number.  What has a null for a key or a
    baseline is not plain.
    """
    level = F.coalesce((F.col("dy") == 0) & (F.col("dx") >= PARALLEL), F.lit(False))
    met = atoms.groupBy("doc_id", "page", "by").agg(
        F.min("h").alias("_low"), F.max("h").alias("_tall"), F.bool_and(level).alias("_flat")
    )
    along = Window.partitionBy("doc_id", "page").orderBy(F.col("by").desc())
    tallest = F.max("_tall").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.coalesce(F.lag("by").over(along) - F.col("by") > F.greatest(F.lit(1.0), 0.35 * tallest), F.lit(False))
    banded = met.withColumn("_ends", ends.cast("int")).withColumn(
        "line_id", F.sum("_ends").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    band = Window.partitionBy("doc_id", "page", "line_id")
    spans = F.max("by").over(band) - F.min("by").over(band)
    short = F.coalesce(spans <= F.greatest(F.lit(1.0), 0.35 * F.min("_low").over(band)), F.lit(False))
    keyed = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("by").isNotNull()
    judged = banded.withColumn("_plain", F.col("_flat") & short & keyed)
    whole = F.bool_and("_plain").over(Window.partitionBy("doc_id", "page"))
    return judged.withColumn("_level", whole).select("doc_id", "page", "by", "_plain", "_level", "line_id")


def assign_lines(atoms: DataFrame) -> DataFrame:
    """WIN2: greedy line assignment per page: ``atoms`` with ``line_id`` in creation order.

    atoms: doc_id, page, atom_id, bx, by (baseline), h, dx, dy (unit direction),
    further columns.  The tolerance follows the growing median height of a line,
    so the order of visits matters.  Pages of bands that can only be one line are
    decided from their distinct baselines (:func:`plain_baselines`) without a sort
    of atoms; only the others are folded, in the order that Spark sorted, and a
    corpus without any needs no Python at all.  Nothing is written between: what
    tells whether a page is folded is worked out again instead.
    Limits on pages are a gate of their own (:mod:`glyphfold.operators.checks`).
    """

    def visit(
        page: tuple | None, side: int, band: int, plain: bool, bx: float, by: float, h: float, dx: float, dy: float
    ) -> tuple[tuple, tuple]:
        # Lines made so far, and of each side the band it is in: a side's bands come one after another.
        made, sides = (0, {}) if page is None else page
        if side not in sides or sides[side][0] != band:
            sides[side] = (band, [], [])
        _, lines, reachable = sides[side]
        chosen, closed = None, []
        for i in reachable:
            number, ox, oy, lx, ly, heights = lines[i]
            if plain:
                chosen = number
                break
            n = len(heights)
            median = (heights[(n - 1) // 2] + heights[n // 2]) / 2
            if abs((by - oy) * lx - (bx - ox) * ly) > max(1.0, 0.35 * median):
                # Visits go downwards, so a level line out of reach stays so.
                if ly == 0:
                    closed.append(i)
            elif lx * dx + ly * dy >= PARALLEL:
                chosen = number
                insort(heights, h)
                break
        for i in closed:
            reachable.remove(i)
        if chosen is None:
            # A line is created by its first visit.
            chosen = made
            made += 1
            reachable.append(len(lines))
            lines.append((chosen, bx, by, dx, dy, [h]))
        return (made, sides), (chosen,)

    own = atoms.columns
    baselines = plain_baselines(atoms)
    pages = baselines.groupBy("doc_id", "page").agg(F.bool_and("_plain").alias("_level"))
    # Joins on plain keys meet as atoms lie; pages with a null among them are folded.
    known = baselines.filter("_level").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "page", "by")], "line_id").hint("shuffle_hash")
    same = [F.col(c) == F.col(f"_{c}") for c in ("doc_id", "page", "by")]
    found = atoms.join(known, same).select(*own, "line_id")
    if pages.filter("not _level").isEmpty():
        return found
    marked = pages.select(F.col("doc_id").alias("_doc_id"), F.col("page").alias("_page"), "_level").hint("shuffle_hash")
    unclear = atoms.join(marked, same[:2], "left").filter(~F.coalesce("_level", F.lit(False))).select(*own)
    inputs = ["_side", "_band", "_plain", "bx", "by", "h", "dx", "dy"]
    banded = line_bands(unclear)
    folded = fold_sorted(banded, ["doc_id", "page"], ["_visit"], own, inputs, visit, "line_id int", together=True)
    return found.unionByName(folded)


def reading_order(
    atoms: DataFrame, line: str = "line_no", dx: Column | None = None, dy: Column | None = None, number: bool = False
) -> DataFrame:
    """WIN3: ``ordinal`` over a page: lines by their box from the top, then from the left; atoms along the baseline.

    (dx, dy) is the unit direction of an atom's line, level by default.  With
    ``number`` also ``line_no`` (lines in this order) and ``tok_no`` (atoms of a line).
    """
    along = F.col("x") * (F.lit(1.0) if dx is None else dx) + F.col("y") * (F.lit(0.0) if dy is None else dy)
    box = Window.partitionBy("doc_id", "page", line)
    # In order first: one sort serves both windows.  A line's atoms follow each other, so its first place and theirs in it add up.
    placed = atoms.withColumn("_along", along).withColumn("_at", F.row_number().over(box.orderBy("_along", "tok_no")))
    placed = placed.withColumns({"_top": F.min("y").over(box), "_left": F.min("x").over(box)})
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("_top").desc(), "_left", line)
    numbers = {"line_no": F.dense_rank().over(w), "tok_no": F.col("_at")} if number else {}
    return placed.withColumns({"ordinal": F.rank().over(w) + F.col("_at") - 1, **numbers}).drop("_top", "_left", "_along", "_at")


#: Stands for a glyph without text.
NO_TEXT = "\ufffc"


def _shown(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(NO_TEXT))


def _explicit_space(left: Column, right: Column) -> Column:
    return left.rlike(r"(?U)\s$") | right.rlike(r"(?U)^\s")


def split_groups(atoms: DataFrame) -> DataFrame:
    """WIN4: ``group_no`` within the line (gaps and islands)."""
    line = Window.partitionBy(*LINE)
    w = line.orderBy("tok_no")
    # In order first: one sort serves both windows.
    seen = atoms.withColumns({"_text": F.lag(_shown()).over(w), "_gap": F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)})
    seen = seen.withColumn("_h", F.median("h").over(line))
    wide = (F.col("_gap") > 0.75 * F.col("_h")) | (
        F.col("_text").rlike(r"(?U)\s*:\s*$") & (F.col("_gap") > 0.25 * F.col("_h"))
    )
    cut = F.col("_gap").isNotNull() & ~_explicit_space(F.col("_text"), _shown()) & wide
    return (
        seen.withColumn("_cut", cut.cast("int"))
        .withColumn("group_no", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("_h", "_text", "_gap", "_cut")
    )


def needs_space(atoms: DataFrame, source_gap: Column, size: Column, scaling: Column) -> DataFrame:
    """WIN5: ``space_before``; a null source gap is no evidence, not a zero gap."""
    line = Window.partitionBy(*LINE)
    w = line.orderBy("tok_no")
    # In order first: one sort serves both windows.
    seen = atoms.withColumns({"_text": F.lag(_shown()).over(w), "_gap": F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)})
    seen = seen.withColumn("_h", F.median("h").over(line))
    em = size * F.abs(scaling)
    by_source = (em > 0) & (source_gap >= 0.2 * em)
    by_box = (F.col("_gap") > 0.15 * F.col("_h")) & (F.col("_gap") <= 0.75 * F.col("_h"))
    verdict = (
        F.when(F.col("_gap").isNull(), False)
        .when(_explicit_space(F.col("_text"), _shown()), False)
        .when(source_gap.isNotNull(), by_source)
        .otherwise(by_box)
    )
    return seen.withColumn("space_before", verdict).drop("_h", "_text", "_gap")


def style_runs(
    df: DataFrame,
    keys: Seq[str],
    order: str,
    style: Seq[str],
    text: str | None,
    space_before: str | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """WIN6: maximal runs of equal style: run_no, run_start, run_end, style, run_text.

    A synthetic space belongs to the run before it.  Ranges count rows of the
    key in order (half open).  With ``text=None`` no run text is gathered, which
    suits runs of any length.
    """
    style_now = F.struct(*style)
    seq = Sequence(df, keys, [order], max_group_rows).lag("_prev", style_now)
    change = (~F.col("_prev").eqNullSafe(style_now)).cast("int")
    seq = seq.running_sum("run_no", change).row_number("_row")
    texts = []
    if text is not None:
        piece = _shown(text)
        if space_before is not None:
            seq = seq.lead("_space", F.col(space_before))
            piece = F.concat(piece, F.when(F.col("_space"), " ").otherwise(""))
        seq = seq.with_column("_piece", piece)
        texts = [F.expr(f"listagg(_piece, '') WITHIN GROUP (ORDER BY {order})").alias("run_text")]
    runs = seq.done().groupBy(*keys, "run_no").agg(
        (F.min("_row") - 1).alias("run_start"), F.max("_row").alias("run_end"), F.first(style_now).alias("_style"), *texts
    )
    return runs.select(*keys, "run_no", "run_start", "run_end", "_style.*", *(["run_text"] if texts else []))


def coalesce_ranges(
    df: DataFrame, keys: Seq[str], order: Seq[str], start: str, end: str, max_group_rows: int | None = None
) -> DataFrame:
    """WIN7: merge neighbours that are equal or touch, in source order.

    A range equal to the slice so far is dropped, one that begins where the
    slice ends extends it, any other opens a slice.  The slice ends where the
    range before ended.  It begins where the last range began that did not
    touch its predecessor: such a range opens a slice or equals the slice.
    """
    seq = Sequence(df, keys, order, max_group_rows).lag("_end", F.col(end))
    seq = seq.with_column("_touch", F.coalesce(F.col("_end") == F.col(start), F.lit(False)))
    seq = seq.last_known("_begin", F.when(~F.col("_touch"), F.col(start)), inclusive=False)
    equal = (F.col("_begin") == F.col(start)) & (F.col("_end") == F.col(end))
    opens = ~F.col("_touch") & ~F.coalesce(equal, F.lit(False))
    rows = seq.running_sum("slice_no", opens.cast("int")).done()
    return rows.groupBy(*keys, "slice_no").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")
    )


#: What a source slice is told by: the operator that draws a glyph, and the glyph's range in it.
SOURCE = ("op_no", "g_start", "g_end")


def _cluster_reach(glyphs: DataFrame) -> DataFrame:
    """LINE, ix, lo, hi: the glyphs that share a grapheme cluster with a glyph, where these are more than itself.

    glyphs: LINE, ix, _t (shown text), _c0 and _c1 (its character range).  In
    plain ASCII lines only CR LF is more than a character, so they take no part.
    """
    hard = F.bool_or(~F.col("_t").rlike(ASCII_ONLY) | F.col("_t").contains("\r"))
    lines = glyphs.groupBy(*LINE).agg(hard.alias("_hard"), F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY ix)").alias("_all"))
    clusters = graphemes(lines.filter("_hard"), LINE, "_all").filter(F.col("end") - F.col("start") > 1)
    places = clusters.select(
        *LINE, "cluster_no", F.col("start").alias("_from"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_p")
    )
    # A glyph without characters lies in the cluster that goes on behind it.
    own = F.explode(F.sequence(F.col("_c0"), F.greatest(F.col("_c0"), F.col("_c1") - 1)))
    met = glyphs.select(*LINE, "ix", "_c0", "_c1", own.alias("_p")).join(places, [*LINE, "_p"])
    met = met.filter((F.col("_c1") > F.col("_c0")) | (F.col("_from") < F.col("_p")))
    ends = met.groupBy(*LINE, "cluster_no").agg(F.min("ix").alias("_lo"), F.max("ix").alias("_hi")).filter("_lo < _hi")
    per_glyph = met.select(*LINE, "ix", "cluster_no").join(ends, [*LINE, "cluster_no"])
    return per_glyph.groupBy(*LINE, "ix").agg(F.min("_lo").alias("lo"), (F.max("_hi") + 1).alias("hi"))


def selection_index(atoms: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per glyph of the lines asked for, with running measures.

    ``ix`` from 0, ``n`` glyphs of the line; ``lo``, ``hi``: the glyphs its
    clusters reach; ``_d0``, ``_d1``: its characters in the shown line; ``_runs``,
    ``_slices``: how many style runs and source slices have begun before or at it.
    """
    asked = requests.select(*LINE).distinct()
    source = [c if c in atoms.columns else F.lit(None).cast("int").alias(c) for c in SOURCE]
    w = Window.partitionBy(*LINE).orderBy("tok_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = atoms.join(asked, list(LINE), "left_semi").select(
        *LINE, "tok_no", _shown().alias("_t"), "x", "y", "w", "h", "style_key", "space_before", *source
    )
    # The pieces of one operator go on while the glyphs do; a source that repeats is one piece.
    last = {c: F.lag(c).over(w) for c in SOURCE}
    same_op = F.col("op_no").eqNullSafe(last["op_no"])
    again = same_op & F.col("g_start").eqNullSafe(last["g_start"]) & F.col("g_end").eqNullSafe(last["g_end"])
    follows = F.coalesce(same_op & (F.col("g_start") == last["g_end"]), F.lit(False))
    placed = rows.withColumn("_first", F.row_number().over(w) == 1).withColumns(
        {
            "ix": F.row_number().over(w) - 1,
            "n": F.count(F.lit(1)).over(Window.partitionBy(*LINE)).cast("int"),
            "_new_style": (~F.col("_first") & ~F.col("style_key").eqNullSafe(F.lag("style_key").over(w))).cast("int"),
            "_again": again & ~F.col("_first"),
            "_follows": follows & ~again & ~F.col("_first"),
            "_size": F.length("_t") + F.when(F.col("space_before") & ~F.col("_first"), 1).otherwise(0),
        }
    )
    # A source that repeats right after its first glyph has lengthened a slice begins one of its own.
    placed = placed.withColumn("_own", F.col("_again") & F.coalesce(F.lag("_follows").over(w), F.lit(False)))
    breaks = (F.col("_own") | ~(F.col("_again") | F.col("_follows") | F.col("_first"))).cast("int")
    placed = placed.withColumns(
        {
            "_c1": F.sum(F.length("_t")).over(upto),
            "_d1": F.sum("_size").over(upto),
            "_runs": F.sum("_new_style").over(upto),
            "_slices": F.sum(breaks).over(upto),
        }
    ).withColumns({"_c0": F.col("_c1") - F.length("_t"), "_d0": F.col("_d1") - F.length("_t")})
    placed = placed.drop("_first", "_again", "_follows", "_new_style", "_size")
    reach = _cluster_reach(placed)
    joined = placed.join(reach, [*LINE, "ix"], "left")
    return joined.withColumns({"lo": F.coalesce("lo", "ix"), "hi": F.coalesce("hi", F.col("ix") + 1)})


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), level)


def _spans(glyphs: Column, measures: dict[str, Callable[[Column], Column]]) -> Column:
    """A sparse table, by doubling: at [level][ix] each measure over the 2^level glyphs from ``ix`` on.

    glyphs: a line's, in order; measures: name to value of a glyph, names that
    begin with ``min`` or ``max`` say which.
    """

    def joined(a: Column, b: Column) -> Column:
        return F.struct(*[(F.least if m.startswith("min") else F.greatest)(a[m], b[m]).alias(m) for m in measures])

    def doubled(made: Column, level: Column) -> Column:
        known, step = F.element_at(made, -1), _power(level - 1)
        following = F.transform(F.slice(known, 1, F.size(known) - step), lambda a, ix: joined(a, F.get(known, ix + step)))
        return F.concat(made, F.array(following))

    single = F.transform(glyphs, lambda g: F.struct(*[value(g).alias(m) for m, value in measures.items()]))
    levels = F.when(F.size(glyphs) > 1, F.sequence(F.lit(1), F.length(F.bin(F.size(glyphs))) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.array(single), doubled)


def _over(spans: Column, start: Column, end: Column, names: Seq[str]) -> Column:
    """Each measure over [start, end): the two spans that cover it."""
    # The largest power of two that fits, from the length's binary digits.
    level = F.length(F.bin(end - start)) - 1
    row = F.get(spans, level)
    a, b = F.get(row, start), F.get(row, end - _power(level))
    return F.struct(*[(F.least if m.startswith("min") else F.greatest)(a[m], b[m]).alias(m) for m in names])


def line_spans(index: DataFrame) -> DataFrame:
    """One row per line: LINE, n, its text, ``_at`` (glyphs with running measures) and the sparse tables ``_reach`` and ``_box``."""
    piece = F.concat(F.when(F.col("space_before") & (F.col("ix") > 0), " ").otherwise(""), "_t").alias("p")
    right, bottom = (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b")
    glyph = F.struct("ix", "lo", "hi", "x", "y", right, bottom, "_d0", "_d1", "_runs", "_slices", "_own", piece)
    lines = index.groupBy(*LINE).agg(F.array_sort(F.collect_list(glyph)).alias("_g"))
    boxes = {"min_x": "x", "min_y": "y", "max_x": "r", "max_y": "b"}
    return lines.select(
        *LINE,
        F.size("_g").alias("n"),
        F.array_join(F.transform("_g", lambda g: g["p"]), "").alias("_line"),
        F.transform("_g", lambda g: F.struct(*[g[c].alias(c) for c in ("_d0", "_d1", "_runs", "_slices", "_own")])).alias("_at"),
        _spans(F.col("_g"), {"min_lo": lambda g: g["lo"], "max_hi": lambda g: g["hi"]}).alias("_reach"),
        _spans(F.col("_g"), {m: lambda g, c=c: g[c] for m, c in boxes.items()}).alias("_box"),
    )


def select_range(
    atoms: DataFrame, requests: DataFrame, decorations: DataFrame | None = None, warnings: DataFrame | None = None
) -> DataFrame:
    """WIN8: selections on lines, by range queries: a request reads two places per measure, whatever it selects.

    A line meets its requests as one row; only what requests find is written.

    atoms: LINE, tok_no, text (null: a glyph without text), x, y, w, h,
    style_key, space_before, and op_no, g_start, g_end where source slices are
    asked for; requests: req_id, LINE, anchor, focus (0-based, either
    direction); decorations: LINE, start, end; warnings: LINE, ranges (array of
    start, end; empty: of the whole line).  Out-of-range requests become an
    ``OUT_OF_RANGE`` row.
    """
    sound = (F.col("anchor") >= 0) & (F.col("focus") >= 0) & (F.col("anchor") < F.col("n")) & (F.col("focus") < F.col("n"))
    asked = requests.join(line_spans(selection_index(atoms, requests)), list(LINE), "left").withColumns(
        {
            "ok": F.coalesce(sound, F.lit(False)),
            "_from": F.least("anchor", "focus").cast("int"),
            "_to": (F.greatest("anchor", "focus") + 1).cast("int"),
        }
    )
    # Out of range, nothing is looked up.
    reach = F.when(F.col("ok"), _over(F.col("_reach"), F.col("_from"), F.col("_to"), ["min_lo", "max_hi"]))
    wide = asked.withColumn("_wide", reach).withColumns(
        {"sel_start": F.col("_wide.min_lo").cast("int"), "sel_end": F.col("_wide.max_hi").cast("int")}
    )
    box = _over(F.col("_box"), F.col("sel_start"), F.col("sel_end"), ["min_x", "min_y", "max_x", "max_y"])
    ends = {"_first": F.col("sel_start"), "_second": F.col("sel_start") + 1, "_last": F.col("sel_end") - 1}
    read = wide.withColumns({"_b": box, **{name: F.get("_at", ix) for name, ix in ends.items()}})
    asked = cut_lineage(
        read.select(
            "req_id",
            *LINE,
            "ok",
            "sel_start",
            "sel_end",
            F.substring("_line", (F.col("_first._d0") + 1).cast("int"), (F.col("_last._d1") - F.col("_first._d0")).cast("int")).alias("sel_text"),
            (F.col("_last._runs") - F.col("_first._runs") + 1).cast("int").alias("runs"),
            # A source that repeats at the very start has lengthened nothing.
            (
                F.col("_last._slices")
                - F.col("_first._slices")
                + 1
                - F.when((F.col("sel_end") - F.col("sel_start") > 1) & F.col("_second._own"), 1).otherwise(0)
            )
            .cast("int")
            .alias("slices"),
            F.col("_b.min_x").alias("x"),
            F.col("_b.min_y").alias("y"),
            (F.col("_b.max_x") - F.col("_b.min_x")).alias("w"),
            (F.col("_b.max_y") - F.col("_b.min_y")).alias("h"),
        )
    )
    found = asked.filter("ok").drop(*LINE, "ok")
    out = asked.select("req_id", *LINE, "ok").join(found, "req_id", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    meets = lambda d: (d["start"] < F.col("sel_end")) & (d["end"] > F.col("sel_start"))
    inside = lambda d: (d["start"] >= F.col("sel_start")) & (d["end"] <= F.col("sel_end"))
    # Graphics of a line are few; they are not glyphs.
    if decorations is not None:
        deco = decorations.groupBy(*LINE).agg(F.collect_list(F.struct("start", "end")).alias("_deco"))
        out = out.join(deco, list(LINE), "left")
    else:
        out = out.withColumn("_deco", none)
    if warnings is not None:
        warned = warnings.groupBy(*LINE).agg(F.collect_list("ranges").alias("_warned"))
        out = out.join(warned, list(LINE), "left")
    else:
        out = out.withColumn("_warned", F.array().cast("array<array<struct<start:int,end:int>>>"))
    deco_list = F.coalesce("_deco", none)
    warned_list = F.coalesce("_warned", F.array().cast("array<array<struct<start:int,end:int>>>"))

    def when_ok(value: Column) -> Column:
        return F.when(F.col("ok"), value)

    return out.select(
        "req_id",
        *LINE,
        F.when(F.col("ok"), "SELECTED").otherwise("OUT_OF_RANGE").alias("outcome"),
        *["sel_start", "sel_end", "sel_text", "runs", "slices", "x", "y", "w", "h"],
        when_ok(F.size(F.filter(deco_list, inside))).alias("decorations"),
        when_ok(F.size(F.filter(deco_list, lambda d: meets(d) & ~inside(d)))).alias("partial_warnings"),
        when_ok(F.size(F.filter(warned_list, lambda r: (F.size(r) == 0) | F.exists(r, meets)))).alias("line_warnings"),
    )


def graphemes(df: DataFrame, keys: Seq[str], text: str) -> DataFrame:
    """SCL16: one row per grapheme cluster with start and end (code points)."""
    rows = df.select(*keys, F.posexplode(grapheme_list(F.col(text))).alias("_p", "cluster"))
    return (
        Sequence(rows, keys, ["_p"])
        .running_sum("end", F.length("cluster"))
        .with_column("start", F.col("end") - F.length("cluster"))
        .select(*keys, F.col("_p").alias("cluster_no"), "start", "end", "cluster")
    )


def char_ranges(df: DataFrame, keys: Seq[str], order: Seq[str], text: str, max_group_rows: int | None = None) -> DataFrame:
    """WIN9: ``char_start``/``char_end`` of each piece in its sequence."""
    return (
        Sequence(df, keys, order, max_group_rows)
        .running_sum("char_end", F.length(text))
        .with_column("char_start", F.col("char_end") - F.length(text))
        .done()
    )


def slice_runs(runs: DataFrame, text: str, start: Column, end: Column) -> DataFrame:
    """WIN9: runs with char ranges cut to [start, end); empty ones drop out."""
    lo = F.greatest(F.lit(0), start - F.col("char_start"))
    hi = F.least(F.col("char_end"), end) - F.col("char_start")
    cut = F.substring(F.col(text), (lo + 1).cast("int"), (hi - lo).cast("int"))
    return runs.filter(lo < hi).withColumns(
        {text: cut, "char_start": F.col("char_start") + lo, "char_end": F.col("char_start") + hi}
    )


def advance_profile(
    df: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    start: Column,
    end: Column,
    scale: Column,
    run: str | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """WIN10: ``advance`` per glyph and ``usable`` per run (every advance positive)."""
    base = df.withColumns({"_s": start, "_e": end})
    bad = ~F.coalesce(finite(F.col("advance")) & (F.col("advance") > 0), F.lit(False))
    return (
        Sequence(base, [*keys, *([run] if run else [])], order, max_group_rows)
        .lead("_next", F.col("_s"))
        .with_column("advance", (F.coalesce("_next", "_e") - F.col("_s")) / scale)
        .total("_bad", bad.cast("int"))
        .with_column("usable", F.col("_bad") == 0)
        .done()
        .drop("_s", "_e", "_next", "_bad")
    )


def common_prefix(a: DataFrame, b: DataFrame, keys: Seq[str], pos: str, value: str) -> DataFrame:
    """WIN11: ``prefix`` = leading positions (from 0) on which two sequences agree."""
    left = a.select(*keys, pos, F.struct(F.col(value).alias("v")).alias("_a"))
    right = b.select(*keys, pos, F.struct(F.col(value).alias("v")).alias("_b"))
    pairs = left.join(right, [*keys, pos], "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(differs, F.col(pos))), F.count(F.lit(1))).cast("bigint").alias("prefix"),
        F.count("_a").alias("left_len"),
        F.count("_b").alias("right_len"),
    )


def check_patches(patches: DataFrame, payloads: DataFrame, key: Seq[str], text: str) -> DataFrame:
    """WIN12: per payload ``ok``, ``invalid-range`` or ``overlap``.

    patches: key, start, end, replacement (offsets in code points).
    """
    sized = patches.join(payloads.select(*key, F.length(text).alias("_len")), list(key))
    w = Window.partitionBy(*key).orderBy("start", "end", "replacement")
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("_len"))
    return (
        sized.withColumn("_bad", bad)
        .withColumn("_over", F.lag("end").over(w) > F.col("start"))
        .groupBy(*key)
        .agg(F.bool_or("_bad").alias("_bad"), F.coalesce(F.bool_or("_over"), F.lit(False)).alias("_over"))
        .select(*key, F.when(F.col("_bad"), "invalid-range").when(F.col("_over"), "overlap").otherwise("ok").alias("verdict"))
    )


def apply_patches(payloads: DataFrame, patches: DataFrame, key: Seq[str], text: str) -> DataFrame:
    """WIN12: payloads with all patches applied against the original offsets.

    The patches of a payload travel as one ordered array to its text; a
    payload whose patches are not sound keeps its text and says why.
    """
    packed = patches.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_p")
    )
    joined = payloads.join(packed, list(key), "left")
    p, n = F.col("_p"), F.length(text)
    invalid = F.exists(p, lambda q: (q["start"] < 0) | (q["end"] <= q["start"]) | (q["end"] > n))
    after = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    overlap = F.exists(
        F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), after, lambda a, b: a["end"] > b["start"]), lambda x: x
    )
    verdict = F.when(p.isNull(), "untouched").when(invalid, "invalid-range").when(overlap, "overlap").otherwise("ok")
    kept = F.transform(
        p,
        lambda q, i: F.concat(
            F.substring(
                F.col(text),
                F.when(i > 0, F.get(p, i - 1)["end"]).otherwise(0) + 1,
                q["start"] - F.when(i > 0, F.get(p, i - 1)["end"]).otherwise(0),
            ),
            q["replacement"],
        ),
    )
    tail = F.substring(F.col(text), F.element_at(p, -1)["end"] + 1, n)
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("patched", F.when(F.col("verdict") == "ok", F.concat(F.array_join(kept, ""), tail)).otherwise(F.col(text)))
        .drop("_p")
    )


def carry_state(
    ops: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    cols: Seq[str],
    begin: Column | None = None,
    moves: Seq[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """WIN13: attributes in force at every row (``<col>_now``).

    ``begin`` marks rows that start a segment; ``moves`` are relative shifts
    summed within the segment (``<col>_pos``).
    """
    seq = Sequence(ops, keys, order, max_group_rows)
    seq = seq.last_known_of({f"{c}_now": F.col(c) for c in cols})
    if begin is None:
        return seq.done()
    seq = seq.running_sum("segment", begin.cast("int"))
    for m in moves:
        # Running total less the total at the segment's start: no second partitioning.
        seq = seq.running_sum(f"_{m}", F.coalesce(F.col(m), F.lit(0.0)))
        seq = seq.last_known(
            f"_{m}0", F.when(begin, F.col(f"_{m}") - F.coalesce(F.col(m), F.lit(0.0)))
        )
        seq = seq.with_column(f"{m}_pos", F.col(f"_{m}") - F.coalesce(F.col(f"_{m}0"), F.lit(0.0)))
    done = seq.done()
    return done.drop(*[f"_{m}" for m in moves], *[f"_{m}0" for m in moves])


def scope_depth(ops: DataFrame, keys: Seq[str], order: Seq[str], step: Column, max_group_rows: int | None = None) -> DataFrame:
    """WIN14: running ``depth`` (step +1 push, -1 pop, 0 other), after the row."""
    return Sequence(ops, keys, order, max_group_rows).running_sum("depth", step).done()


def scope_balance(ops: DataFrame, keys: Seq[str], order: Seq[str], step: Column, max_depth: int = 12, max_group_rows: int | None = None) -> DataFrame:
    """WIN14: one verdict per key: underflow or unclosed scopes are malformed."""
    rows = scope_depth(ops.withColumn("_step", step), keys, order, F.col("_step"), max_group_rows)
    return rows.groupBy(*keys).agg(
        F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.sum("_step").alias("end_depth")
    ).select(
        *keys,
        "max_depth",
        F.when(F.col("min_depth") < 0, "MALFORMED_INPUT")
        .when(F.col("max_depth") > max_depth, "RESOURCE_LIMIT")
        .when(F.col("end_depth") != 0, "MALFORMED_INPUT")
        .otherwise("BALANCED")
        .alias("verdict"),
    )


def resolve_scopes(
    ops: DataFrame, keys: Seq[str], order: Seq[str], step: Column, value: Column, max_group_rows: int | None = None
) -> DataFrame:
    """WIN14: ``in_force`` = the value set last in the innermost open scope that has one.

    A push opens a scope one level deeper; a set counts for the scope it is in.
    Rows of one level, in order, are scope after scope, so a window per level
    tells each row its scope and the value set there.  A scope without a value
    inherits what its parent had when it was opened: parents are followed by
    doubling the distance each round, so any depth is exact.  Pops below level
    0 are ignored (:func:`scope_balance` reports them).  Keys and the first
    order column identify a row.
    """
    keys, pos = list(keys), order[0]
    base = ops.withColumns({"_step": step, "_set": value})
    seq = Sequence(base, keys, order, max_group_rows).running_sum("_sum", F.col("_step"))
    seq = seq.running_min("_low", F.col("_sum"))
    rows = seq.with_column("depth", (F.col("_sum") - F.least(F.col("_low"), F.lit(0))).cast("int")).done()
    push = F.col("_step") > 0
    # A push is also asked about on the level it leaves: what its scope inherits.
    asks = F.array(F.lit(False), F.lit(True))
    both = rows.withColumn("_ask", F.explode(F.when(push, asks).otherwise(F.array(F.lit(False)))))
    both = both.withColumn("_level", F.when(F.col("_ask"), F.col("depth") - 1).otherwise(F.col("depth")))
    opens = push & ~F.col("_ask")
    sets = ~F.col("_ask") & F.col("_set").isNotNull()
    levels = Sequence(both, [*keys, "_level"], order, max_group_rows).last_known_of(
        {
            "_scope": F.when(opens, F.col(pos)),
            "_own": F.when(opens | sets, F.struct(F.col("_set").alias("v"))),
        }
    )
    known = cut_lineage(levels.with_column("_own", F.col("_own.v")).done())
    scopes = known.filter("_ask").select(
        *keys, F.col(pos).alias("_id"), F.when(F.col("_level") > 0, F.col("_scope")).alias("_up"), F.col("_own").alias("_value")
    )
    scopes = cut_lineage(scopes)
    while not scopes.filter("_value is null and _up is not null").isEmpty():
        above = scopes.select(*keys, F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_value").alias("_got"))
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
        met = scopes.alias("s").join(above.alias("a"), [*same, F.col("s._up") == F.col("a._up"), F.col("s._value").isNull()], "left")
        scopes = cut_lineage(
            met.select(
                *[f"s.{k}" for k in keys],
                "s._id",
                F.when(F.col("s._value").isNull(), F.col("a._next")).alias("_up"),
                F.coalesce("s._value", "a._got").alias("_value"),
            )
        )
    inherited = scopes.filter(F.col("_value").isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_id", "_value")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    here = [F.col("_scope") == F.col("_id"), F.col("_own").isNull(), F.col("depth") > 0]
    joined = known.filter(~F.col("_ask")).join(inherited, [*same, *here], "left")
    return joined.select(*ops.columns, "depth", F.coalesce("_own", "_value").alias("in_force"))


def bracket_blocks(ops: DataFrame, keys: Seq[str], pos: str, kind: Column, max_group_rows: int | None = None) -> DataFrame:
    """WIN15: pairs of opens with their closes: block_open, block_close, depth.

    ``kind`` is +1, -1 or 0.  A close without an open is ignored; an open
    without a close has a null end.
    """
    brackets = ops.select(*keys, pos, kind.alias("_k")).filter("_k != 0")
    seq = Sequence(brackets, keys, [pos], max_group_rows).running_sum("_sum", F.col("_k"))
    seq = seq.running_min("_low", F.col("_sum"))
    # Depth over ignored closes; a close is matched when the level above it was open.
    seq = seq.with_column("_depth", F.col("_sum") - F.least(F.col("_low"), F.lit(0)))
    seq = seq.lag("_prev", F.col("_depth"))
    level = F.when(F.col("_k") > 0, F.col("_depth")).otherwise(F.coalesce("_prev", F.lit(0)))
    rows = seq.done().withColumn("depth", level.cast("int")).filter("depth > 0")
    paired = Sequence(rows.select(*keys, "depth", pos, "_k"), [*keys, "depth"], [pos], max_group_rows).lead(
        "block_close", F.col(pos)
    )
    return paired.done().filter("_k > 0").select(*keys, F.col(pos).alias("block_open"), "block_close", "depth")


def classify_blocks(ops: DataFrame, keys: Seq[str], pos: str, max_group_rows: int | None = None) -> DataFrame:
    """WIN15: decoration graphics: leaf blocks that fit one of two patterns.

    ops: keys, pos, op, nums (array<double>).  Opens are ``q``, closes ``Q``.
    Accepted: exactly one colour and one painter, and either one width, one
    move and one line (stroke), or one rectangle that is not square (fill).
    Any other operator, a nested block or a repeated member rejects the block.
    """
    op = F.col("op")
    mark = F.when(op == "q", F.struct(F.lit(1).alias("k"), F.col(pos).alias("p"))).when(
        op == "Q", F.struct(F.lit(-1).alias("k"), F.col(pos).alias("p"))
    )
    seq = Sequence(ops, keys, [pos], max_group_rows).last_known("_last", mark, inclusive=False)
    rows = seq.done().filter((F.col("_last.k") == 1) & (op != "q"))
    colour = op.isin("rg", "RG", "g", "G", "k", "K")
    painter = op.isin("S", "f", "f*")

    def one(name: str) -> Column:
        return F.count_if(op == name).alias(name)

    blocks = rows.groupBy(*keys, F.col("_last.p").alias("block_open")).agg(
        F.max(F.when(op == "Q", F.col(pos))).alias("block_close"),
        F.count_if(op != "Q").alias("members"),
        F.count_if(colour).alias("colours"),
        F.count_if(painter).alias("painters"),
        one("w"),
        one("m"),
        one("l"),
        one("re"),
        F.max(F.when(op == "S", "stroke").when(painter, "fill")).alias("_paint"),
        F.max(F.when(op == "w", F.col("nums")[0])).alias("_w"),
        F.max(F.when(op == "m", F.col("nums"))).alias("_m"),
        F.max(F.when(op == "l", F.col("nums"))).alias("_l"),
        F.max(F.when(op == "re", F.col("nums"))).alias("_re"),
        F.max(F.when(colour, F.struct(F.lower(op).alias("op"), F.col("nums").alias("comps")))).alias("_colour"),
    )
    closed = F.col("block_close").isNotNull()
    single = (F.col("colours") == 1) & (F.col("painters") == 1)
    stroke = (
        (F.col("_paint") == "stroke")
        & (F.col("w") == 1)
        & (F.col("m") == 1)
        & (F.col("l") == 1)
        & (F.col("members") == 5)
        & (F.col("_w") > 0)
        & (F.col("_m") != F.col("_l"))
    )
    wide, tall = F.abs(F.get("_re", F.lit(2))), F.abs(F.get("_re", F.lit(3)))
    fill = (
        (F.col("_paint") == "fill")
        & (F.col("re") == 1)
        & (F.col("members") == 3)
        & (wide > 0)
        & (tall > 0)
        & (wide != tall)
    )
    x, y, rw, rh = (F.get("_re", F.lit(i)) for i in range(4))
    is_stroke = F.coalesce(closed & single & stroke, F.lit(False))
    is_fill = F.coalesce(closed & single & fill, F.lit(False))
    flat = wide > tall
    return blocks.select(
        *keys,
        "block_open",
        "block_close",
        F.when(is_stroke, "stroke").when(is_fill, "fill").alias("paint"),
        F.when(is_stroke, F.get("_m", F.lit(0))).when(is_fill, F.when(flat, x).otherwise(x + rw / 2)).alias("gx0"),
        F.when(is_stroke, F.get("_m", F.lit(1))).when(is_fill, F.when(flat, y + rh / 2).otherwise(y)).alias("gy0"),
        F.when(is_stroke, F.get("_l", F.lit(0))).when(is_fill, F.when(flat, x + rw).otherwise(x + rw / 2)).alias("gx1"),
        F.when(is_stroke, F.get("_l", F.lit(1))).when(is_fill, F.when(flat, y + rh / 2).otherwise(y + rh)).alias("gy1"),
        F.when(is_stroke, F.col("_w")).when(is_fill, F.least(wide, tall)).alias("thickness"),
        F.when(is_stroke | is_fill, F.col("_colour.op")).alias("space"),
        F.when(is_stroke | is_fill, F.col("_colour.comps")).alias("comps"),
    )


def max_width(atoms: DataFrame, page_width: Column) -> DataFrame:
    """WIN16: ``room`` = free width to the right of each atom, never under its own."""
    w = Window.partitionBy(*LINE).orderBy("x", "tok_no")
    right = F.coalesce(F.lead("x").over(w), page_width)
    return atoms.withColumn("room", F.greatest(F.col("w"), right - F.col("x")))


def admit(
    items: DataFrame,
    tenant: str,
    order: str,
    max_item: float,
    max_count: int,
    max_total: float,
    candidates: int = 1_000,
) -> DataFrame:
    """WIN17: admission in arrival order: outcome per item.

    items: tenant, order (unique per tenant), hash, size, allowed.  Order of
    checks: item size, duplicate of an admitted hash, count, total, rights.

    A rejected item uses no quota and the rest of the quota only shrinks, so
    the first item of a hash decides for the hash, and an item larger than the
    rest can be passed over for good.  Each round folds, per tenant, only the
    next ``candidates`` items that still fit; every round admits at least one,
    so there are at most ``max_count`` rounds, and a tenant of any size stays
    bounded.  The number changes how many rounds there are, not the result.
    The first items and the admitted ones are written, the former to be read
    each round, the latter so that a hot tenant's rows can be split in the join.
    """
    sound = (F.col("size") > 0) & (F.col("size") <= max_item)
    firsts = (
        items.filter(sound & F.col("allowed"))
        .groupBy(tenant, "hash")
        .agg(F.min(F.struct(F.col(order).alias("o"), F.col("size").alias("s"))).alias("f"))
        .select(tenant, "hash", F.col("f.o").alias(order), F.col("f.s").alias("size"))
    )
    firsts = cut_lineage(firsts)
    w = Window.partitionBy(tenant).orderBy(order)

    def offer(state: tuple | None, size: float, used: int, total: float) -> tuple[tuple, tuple]:
        used, total = (used, total) if state is None else state
        taken = used < max_count and size <= max_total - total
        if taken:
            used, total = used + 1, total + size
        return (used, total), (taken, used, total)

    todo = firsts.withColumns({"used": F.lit(0), "total": F.lit(0.0)})
    admitted = None
    while True:
        fitting = todo.filter(F.col("size") <= max_total - F.col("total"))
        ranked = fitting.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= candidates)
        folded = fold_sorted(
            ranked,
            [tenant],
            [order],
            [tenant, order, "size", "hash"],
            ["size", "used", "total"],
            offer,
            "taken boolean, used_now int, total_now double",
        )
        folded = cut_lineage(folded)
        taken = folded.filter("taken").select(tenant, order, "size", "hash")
        admitted = taken if admitted is None else admitted.unionByName(taken)
        # A tenant that was offered less than the limit was offered all that could still fit.
        state = folded.groupBy(tenant).agg(
            F.max(order).alias("_last"),
            F.max("used_now").alias("used"),
            F.max("total_now").alias("total"),
            F.count(F.lit(1)).alias("_seen"),
        )
        unfinished = state.filter((F.col("used") < max_count) & (F.col("_seen") >= candidates)).drop("_seen")
        if unfinished.isEmpty():
            break
        todo = firsts.join(unfinished, tenant).filter(F.col(order) > F.col("_last")).drop("_last")
    slots = cut_lineage(
        admitted.groupBy(tenant).agg(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "size", "hash"))).alias("_slots")
        )
    )
    earlier = F.filter(F.coalesce("_slots", F.array()), lambda s: s["o"] < F.col(order))
    count = F.size(earlier)
    total = F.aggregate(earlier, F.lit(0.0), lambda acc, s: acc + s["size"])
    verdict = (
        F.when(F.col("size") <= 0, "EMPTY")
        .when(F.col("size") > max_item, "ITEM_LIMIT")
        .when(F.exists(earlier, lambda s: s["hash"] == F.col("hash")), "DUPLICATE")
        .when(count >= max_count, "COUNT_LIMIT")
        .when(F.col("size") > max_total - total, "TOTAL_LIMIT")
        .when(~F.col("allowed"), "PROHIBITED")
        .otherwise("ADMITTED")
    )
    return items.join(slots, tenant, "left").withColumn("outcome", verdict).drop("_slots")


def merge_spans(spans: DataFrame, keys: Seq[str], order: str, text: str, expected: DataFrame | None = None) -> DataFrame:
    """WIN18: ordered spans with rebased offsets, and a verdict per merged span.

    spans: keys, order, text, font, x, y, w, h; expected: keys, ordinal, font.
    The list is refused unless it matches the expectation by position.
    """
    ranged = Sequence(char_ranges(spans, keys, [order], text), keys, [order]).row_number("ordinal").done()
    if expected is None:
        return ranged.withColumn("outcome", F.lit("MERGED"))
    want = expected.select(*keys, "ordinal", F.col("font").alias("_want"))
    checked = ranged.select(*keys, "ordinal", "font").join(want, [*keys, "ordinal"], "full_outer")
    verdict = checked.groupBy(*keys).agg(F.every(F.col("font").eqNullSafe(F.col("_want"))).alias("_ok"))
    return ranged.join(verdict, list(keys)).withColumn(
        "outcome", F.when(F.col("_ok"), "MERGED").otherwise("REFUSED")
    ).drop("_ok")


def merge_controlled(
    spans: DataFrame, controlled: DataFrame, keys: Seq[str], order: str
) -> tuple[DataFrame, DataFrame]:
    """WIN18: spans that one redraw made become one span again, where they are what the redraw says.

    spans: keys, order, text, font, op_start (operation that draws it), x, y, w, h;
    controlled: keys, actual_text, operations (their number), op_indexes,
    fonts, run_indexes and decorations (arrays; the last two nullable; a
    decoration is underline, strike).  By position every span must be drawn by
    the operation and with the font that the redraw names, and there must be as many.

    Returns (merged, pieces): merged has a row per redraw: keys, outcome (MERGED
    or REFUSED), text (the redraw's own), x, y, w, h (of all spans), op_start,
    op_end (all operations), glyphs; pieces has the spans of merged ones with
    span_no (from 0), glyph_start and glyph_end in the merged span, and the underline
    and strike of their run (false where it names none).
    """
    ranged = Sequence(char_ranges(spans, keys, [order], "text"), keys, [order]).row_number("_no").done()
    numbered = ranged.withColumn("span_no", F.col("_no") - 1).drop("_no")
    place = lambda c: F.get(F.col(c), F.col("span_no"))
    joined = numbered.join(controlled, list(keys))
    agrees = F.coalesce((F.col("op_start") == place("op_indexes")) & F.col("font").eqNullSafe(place("fonts")), F.lit(False))
    found = joined.groupBy(*keys).agg(
        F.every(agrees).alias("_agrees"),
        F.count(F.lit(1)).alias("_spans"),
        F.max("char_end").cast("int").alias("_glyphs"),
        F.min("x").alias("_x"),
        F.min("y").alias("_y"),
        F.max(F.col("x") + F.col("w")).alias("_right"),
        F.max(F.col("y") + F.col("h")).alias("_top"),
    )
    whole = controlled.join(found, list(keys), "left")
    sound = F.col("_agrees") & (F.col("_spans") == F.size("op_indexes")) & (F.col("_spans") == F.size("fonts")) & (F.col("_glyphs") > 0)
    judged = whole.withColumn("_ok", F.coalesce(sound, F.lit(False)))

    def if_merged(value: Column) -> Column:
        return F.when(F.col("_ok"), value)

    merged = judged.select(
        *keys,
        F.when(F.col("_ok"), "MERGED").otherwise("REFUSED").alias("outcome"),
        if_merged(F.col("actual_text")).alias("text"),
        if_merged(F.col("_x")).alias("x"),
        if_merged(F.col("_y")).alias("y"),
        if_merged(F.col("_right") - F.col("_x")).alias("w"),
        if_merged(F.col("_top") - F.col("_y")).alias("h"),
        if_merged(F.lit(0)).alias("op_start"),
        if_merged(F.col("operations")).alias("op_end"),
        if_merged(F.col("_glyphs")).alias("glyphs"),
    )
    run = F.get(F.col("decorations"), place("run_indexes"))
    pieces = joined.join(judged.filter("_ok").select(*keys), list(keys), "left_semi").select(
        *keys,
        "span_no",
        F.col("char_start").alias("glyph_start"),
        F.col("char_end").alias("glyph_end"),
        F.coalesce(run["underline"], F.lit(False)).alias("underline"),
        F.coalesce(run["strike"], F.lit(False)).alias("strike"),
    )
    return merged, pieces


def cluster_text(glyphs: DataFrame, texts: DataFrame, keys: Seq[str], index: str, cluster: str, text: str, filler: str = "") -> DataFrame:
    """WIN19: text per glyph: the last glyph of a cluster carries the cluster's
    text (up to the next cluster start), the others the filler."""
    starts = glyphs.groupBy(*keys, cluster).agg(F.max(index).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(cluster)
    pieces = starts.withColumn("_next", F.lead(cluster).over(w)).join(texts.select(*keys, text), list(keys))
    owned = F.substring(
        F.col(text), (F.col(cluster) + 1).cast("int"), (F.coalesce("_next", F.length(text)) - F.col(cluster)).cast("int")
    )
    return glyphs.join(
        pieces.select(*keys, cluster, "_last", owned.alias("_owned")), [*keys, cluster]
    ).select(
        *glyphs.columns,
        F.when(F.col(index) == F.col("_last"), F.col("_owned")).otherwise(filler).alias("cluster_text"),
    )

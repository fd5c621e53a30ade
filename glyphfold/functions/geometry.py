"""Geometry and style column functions (SCL8, SCL9, SCL12, SCL13, SCL17, SCL19, SCL20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX = ("a", "b", "c", "d", "e", "f")


def matrix(a, b, c, d, e, f) -> Column:
    values = (a, b, c, d, e, f)
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in zip(values, MATRIX)]
    )


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def apply_matrix(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """SCL8: a point under a matrix."""
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def transform_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """SCL8: min/max box of the four transformed corners."""
    corners = [apply_matrix(m, px, py) for px in (x, x + w) for py in (y, y + h)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    left, bottom = F.least(*xs), F.least(*ys)
    return F.struct(
        left.alias("x"), bottom.alias("y"), (F.greatest(*xs) - left).alias("w"), (F.greatest(*ys) - bottom).alias("h")
    )


def mat_mul(m: Column, n: Column) -> Column:
    """SCL8: ``n`` applied first, then ``m``."""
    ox, oy = apply_matrix(m, n["e"], n["f"])
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"],
        m["b"] * n["a"] + m["d"] * n["b"],
        m["a"] * n["c"] + m["c"] * n["d"],
        m["b"] * n["c"] + m["d"] * n["d"],
        ox,
        oy,
    )


def mat_inv(m: Column) -> Column:
    """SCL8: inverse, or null when singular or not finite."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    usable = finite(det) & (det != 0)
    safe = F.when(usable, det)
    return F.when(
        usable,
        matrix(
            m["d"] / safe,
            -m["b"] / safe,
            -m["c"] / safe,
            m["a"] / safe,
            (m["c"] * m["f"] - m["d"] * m["e"]) / safe,
            (m["b"] * m["e"] - m["a"] * m["f"]) / safe,
        ),
    )


def page_geometry(pages: DataFrame) -> DataFrame:
    """SCL9: visible box, rotation, canonical size and matrix per page.

    Input: media box x0,y0,x1,y1, optional crop box cx0..cy1 (null = none),
    rotate, user_unit.  A page that breaks a rule gets ``reason`` and nulls.
    """
    has_crop = F.col("cx0").isNotNull()
    sides = {
        "vx0": F.when(has_crop, F.greatest("x0", "cx0")).otherwise(F.col("x0")),
        "vy0": F.when(has_crop, F.greatest("y0", "cy0")).otherwise(F.col("y0")),
        "vx1": F.when(has_crop, F.least("x1", "cx1")).otherwise(F.col("x1")),
        "vy1": F.when(has_crop, F.least("y1", "cy1")).otherwise(F.col("y1")),
    }

    def bad_box(*names: str) -> Column:
        x0, y0, x1, y1 = (F.col(n) for n in names)
        all_finite = finite(x0) & finite(y0) & finite(x1) & finite(y1)
        return ~all_finite | (x1 <= x0) | (y1 <= y0)

    boxes = pages.withColumns(sides)
    reason = (
        F.when(~finite(F.col("user_unit").cast("double")) | (F.col("user_unit") <= 0), "user-unit")
        .when(bad_box("x0", "y0", "x1", "y1"), "media-box")
        .when(has_crop & bad_box("cx0", "cy0", "cx1", "cy1"), "crop-box")
        .when(bad_box("vx0", "vy0", "vx1", "vy1"), "empty-intersection")
        .when(F.col("rotate") % 90 != 0, "rotation")
    )
    u = F.col("user_unit").cast("double")
    zero = F.lit(0.0)
    rot = F.pmod(F.col("rotate"), F.lit(360))
    m = (
        F.when(rot == 0, matrix(u, zero, zero, u, -u * F.col("vx0"), -u * F.col("vy0")))
        .when(rot == 90, matrix(zero, -u, u, zero, -u * F.col("vy0"), u * F.col("vx1")))
        .when(rot == 180, matrix(-u, zero, zero, -u, u * F.col("vx1"), u * F.col("vy1")))
        .otherwise(matrix(zero, u, -u, zero, u * F.col("vy1"), -u * F.col("vx0")))
    )
    width = (F.col("vx1") - F.col("vx0")) * u
    height = (F.col("vy1") - F.col("vy0")) * u
    turned = rot.isin(90, 270)
    return (
        boxes.withColumn("reason", reason)
        .withColumn("m", F.when(F.col("reason").isNull(), m))
        .withColumn("page_width", F.when(F.col("reason").isNull(), F.when(turned, height).otherwise(width)))
        .withColumn("page_height", F.when(F.col("reason").isNull(), F.when(turned, width).otherwise(height)))
        .drop("vx0", "vy0", "vx1", "vy1")
    )


def to_canonical(atoms: DataFrame, pages: DataFrame, on: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """SCL9: atom boxes in one bottom-left, y-up space; bad pages keep a reason."""
    geometry = page_geometry(pages).select(*on, "m", "reason", "page_width", "page_height")
    box = transform_box(F.col("m"), *[F.col(c) for c in ("x", "y", "w", "h")])
    joined = atoms.join(geometry, list(on), "left").withColumn("_box", box)
    return joined.withColumns({c: F.col(f"_box.{c}") for c in ("x", "y", "w", "h")}).drop("_box", "m")


def to_viewport(x: Column, y: Column, page_height: Column, scale: Column | float) -> tuple[Column, Column]:
    """SCL9: canonical point to a top-left, y-down view."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return x * s, (page_height - y) * s


def decode_rights(flags: Column) -> Column:
    """SCL12: embedding rights from the 16-bit flag field."""

    def bit(mask: int) -> Column:
        return flags.bitwiseAND(F.lit(mask)) != 0

    restricted, preview, editable, bitmap = bit(0x0002), bit(0x0004), bit(0x0008), bit(0x0200)
    many = restricted.cast("int") + preview.cast("int") + editable.cast("int") > 1
    usage = (
        F.when(many, "invalid")
        .when(restricted, "restricted")
        .when(preview, "preview-print")
        .when(editable, "editable")
        .otherwise("installable")
    )
    return F.struct(
        usage.alias("usage"),
        (~bitmap & usage.isin("installable", "editable")).alias("editing_allowed"),
        (~bit(0x0100)).alias("subsetting_allowed"),
        bitmap.alias("bitmap_only"),
    )


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def decoration_metrics(upem: Column, upos: Column, uthick: Column, spos: Column, sthick: Column) -> Column:
    """SCL13: underline and strike geometry in em, with defaults and clamps."""

    def thick(v: Column) -> Column:
        return F.when(finite(v) & (v > 0), _clamp(v / upem, 0.025, 0.12)).otherwise(0.05)

    return F.struct(
        F.when(finite(upos) & (upos < 0), _clamp(upos / upem, -0.35, -0.05)).otherwise(-0.1).alias("underline_pos"),
        thick(uthick).alias("underline_thick"),
        F.when(finite(spos) & (spos > 0), _clamp(spos / upem, 0.2, 0.6)).otherwise(0.3).alias("strike_pos"),
        thick(sthick).alias("strike_thick"),
    )


DOUBLE_STEP = 2.220446049250313e-16


def colour_compatible(space_a: Column, a: Column, space_b: Column, b: Column, tol: float = 0.02) -> Column:
    """SCL17: same space, same component count, every component within the tolerance."""
    near = F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= tol + DOUBLE_STEP), lambda ok: ok)
    return (space_a == space_b) & F.when(F.size(a) == F.size(b), near).otherwise(False)


def is_painted(mode: Column, fill: Column, stroke: Column, clipped: Column, masked: Column) -> Column:
    """SCL19: does an atom leave ink."""
    inked = (mode.isin(0, 2, 4, 6) & (fill > 0)) | (mode.isin(1, 2, 5, 6) & (stroke > 0))
    return ~clipped & ~masked & inked


def on_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """SCL19: finite, positive and meeting the page."""
    sound = finite(x) & finite(y) & finite(w) & finite(h) & (w > 0) & (h > 0)
    return sound & (x < page_w) & (x + w > 0) & (y < page_h) & (y + h > 0)


def visible_mode(mode: Column) -> Column:
    return ~mode.isin(3, 7)


def glyph_advance(
    advance: Column, size: Column, char_space: Column, word_space: Column, is_space: Column, scale: Column
) -> Column:
    """SCL20: advance of one glyph in text space (advance in 1/1000 em)."""
    return (advance / 1000 * size + char_space + F.when(is_space, word_space).otherwise(0.0)) * scale


def positive_or_zero(value: Column) -> Column:
    """SCL20: a run advance that is not finite and positive counts as 0."""
    return F.when(finite(value) & (value > 0), value).otherwise(0.0)

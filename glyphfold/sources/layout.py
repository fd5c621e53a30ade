"""Nested layout records to text items (SRC4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.functions.geometry import finite

WORD = "struct<text:string,xMin:double,yMin:double,xMax:double,yMax:double>"
LINE = f"struct<words:array<{WORD}>>"
PAGE = f"struct<width:double,height:double,flows:array<struct<blocks:array<struct<lines:array<{LINE}>>>>>>"


def one_or_many(json_text: Column, path: str, element: str) -> Column:
    """A member that may be one object or a list of them, as a list."""
    raw = F.get_json_object(json_text, path)
    return F.when(raw.startswith("["), F.from_json(raw, f"array<{element}>")).otherwise(
        F.array_compact(F.array(F.from_json(raw, element)))
    )


def _members(json_text: Column, name: str) -> Column:
    """The JSON texts of a member that may be missing, one object or a list."""
    raw = F.get_json_object(json_text, f"$.{name}")
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array_compact(F.array(raw)))


def read_page(json_text: Column) -> Column:
    """A page (form of :data:`PAGE`) from JSON in which every child may stand alone or in a list."""

    def line(text: Column) -> Column:
        return F.struct(F.transform(_members(text, "words"), lambda w: F.from_json(w, WORD)).alias("words"))

    def block(text: Column) -> Column:
        return F.struct(F.transform(_members(text, "lines"), line).alias("lines"))

    def flow(text: Column) -> Column:
        return F.struct(F.transform(_members(text, "blocks"), block).alias("blocks"))

    size = F.from_json(json_text, "width double, height double")
    return F.struct(
        size["width"].alias("width"), size["height"].alias("height"), F.transform(_members(json_text, "flows"), flow).alias("flows")
    )


def flatten_layout(df: DataFrame, keys: list[str], page: Column, target_width: Column, target_height: Column) -> DataFrame:
    """SRC4: one item per line: text, and box in a y-up space of the target size.

    ``page`` is a struct of PAGE form.  Lines without words and items with a
    box that is not finite are dropped.  Line boxes are taken inside the row,
    so flattening needs no shuffle.
    """
    rows = df.select(*keys, page.alias("_pg"), target_width.alias("_tw"), target_height.alias("_th"))
    rows = rows.select(*keys, "_pg.width", "_pg.height", "_tw", "_th", F.posexplode("_pg.flows").alias("flow_no", "_f"))
    rows = rows.select("*", F.posexplode("_f.blocks").alias("block_no", "_b")).drop("_f")
    rows = rows.select("*", F.posexplode("_b.lines").alias("line_no", "_l")).drop("_b")
    words = F.col("_l.words")

    def over(pick, field: str) -> Column:
        return pick(F.transform(words, lambda w: w[field]))

    left, right = over(F.array_min, "xMin"), over(F.array_max, "xMax")
    top, bottom = over(F.array_min, "yMin"), over(F.array_max, "yMax")
    sx, sy = F.col("_tw") / F.col("width"), F.col("_th") / F.col("height")
    items = rows.filter(F.size(words) > 0).select(
        *keys,
        "flow_no",
        "block_no",
        "line_no",
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"),
        (left * sx).alias("x"),
        ((F.col("height") - bottom) * sy).alias("y"),
        ((right - left) * sx).alias("w"),
        ((bottom - top) * sy).alias("h"),
    )
    return items.filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("w")) & finite(F.col("h")))

"""Line de-duplication across documents.

Lines are exploded with their position, normalised and hashed; the distinct
documents of each hash are counted; lines of hashes over the threshold are
dropped, except in the document with the largest id; what stays is put
together again by position.

* Hashes are two differently seeded 64-bit hashes, 128 bits together.
* Hashed lines are written once, narrow, for both passes over them.
* A hash that a third of all lines share is counted map-side before the
  shuffle.  The repeated hashes are written, so that the join that finds their
  lines again has two plain exchanges and adaptive execution can split it where
  a hash is hot.
* Texts move once, when the dropped positions of a document meet it.

Defined cases: null or empty text is one empty line; a row without an id takes
part in no count and loses nothing; rows that repeat an id and text are one
document and get the same result; rows that share an id but not a text are
counted as one document, and each keeps its own lines.  Other columns of the
input, whatever their names, are ignored or (``dedup_lines``) passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.llm.common import SPACE_CHARS, ascii_lower, let
from glyphfold.session import cut_lineage

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _th, _pos, _h1, _h2): one row for each line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.posexplode(F.split(text, "\n")).alias("_pos", "_line")
    ).filter(F.col("_id").isNotNull())
    # The trimmed line can only be shorter, so most lines are judged without a key.
    long = lines.filter(F.length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line")))
    return long.filter(F.length("_key") >= min_chars).select(
        "_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )


def repeated_keys(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_h1, _h2, _last): keys found in at least ``min_docs`` documents and the largest id that holds each."""
    counted = keyed.groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_last"))
    return counted.filter(F.col("_docs") >= min_docs).select("_h1", "_h2", "_last")


def dropped_positions(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(_id, _th, _drop): ascending positions of the lines that a document loses."""
    lost = keyed.join(repeated, ["_h1", "_h2"]).filter(F.col("_id") != F.col("_last"))
    return lost.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))


def kept_lines(lines: Column, drop: Column) -> Column:
    """``lines`` without the ascending 0-based positions ``drop``: the slices between them."""

    def between(parts: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), parts["drop"], F.array(F.size(parts["lines"])))
        return let(
            F.struct(parts["lines"].alias("lines"), ends.alias("ends")),
            lambda p: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.size(p["ends"]) - 2),
                    lambda i: F.slice(p["lines"], p["ends"][i] + 2, p["ends"][i + 1] - p["ends"][i] - 1),
                )
            ),
        )

    return let(F.struct(lines.alias("lines"), drop.alias("drop")), between)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and ``n_lines`` and ``n_dropped`` added (replacing such columns)."""
    keyed = cut_lineage(keyed_lines(docs, id_col, text_col, min_chars))
    drops = dropped_positions(keyed, cut_lineage(repeated_keys(keyed, min_docs)))
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    joined = docs.alias("d").join(
        drops.alias("p"), (F.col(f"d.{id_col}") == F.col("p._id")) & (F.xxhash64(text) == F.col("p._th")), "left"
    )
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    lines = F.split(text, "\n")
    return joined.select(
        *[F.col(f"d.{c}") for c in rest],
        F.when(F.col("p._drop").isNull(), text)
        .otherwise(F.array_join(kept_lines(lines, F.col("p._drop")), "\n"))
        .alias(text_col),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("p._drop").isNull(), 0).otherwise(F.size("p._drop")).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = dedup_lines(docs.select(id_col, text_col), id_col, text_col)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col), 256).alias("kept_sha256"))

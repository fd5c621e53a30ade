"""Benchmark decontamination: short test items inside long documents.

1. Items are partitioned by their number of distinct word shingles, in powers
   of two.  Each gets a MinHash sketch: its k smallest shingle hashes, where k
   fits the largest item of its partition: one more than the shingles that a
   document may lack and still contain ``threshold`` of the item.
2. Every document's shingles, hashed the same way, are looked up in the
   sketches.  A document that contains the item lacks fewer shingles than the
   sketch has, so it holds one of them: no containing pair is missed, however
   long the document is.  (Comparing whole-document MinHash signatures would
   miss them: an item of twenty shingles is a thousandth of a long document.)
3. Pairs found are verified by the exact containment of the shingles
   themselves, words and all.

Sketches are broadcast in blocks of at most ``index_rows`` rows, counted
first; a larger benchmark takes several passes over the documents.  Document
shingles are never shuffled, and the texts of candidate documents move only
where those are too many to broadcast their ids.

Words are runs of letters and digits (anything beyond ASCII counts as one),
lower-cased.  Items of fewer than five words are one shingle of all their words.

Defined cases: null or empty texts have no words and match nothing; rows without
an id are not searched by ``contained_items``, but are by ``clean``; rows that
share a document id but not a text are judged apart (and named apart: one row of
the result each), repeated rows as one; rows that repeat an item id are one item;
an empty benchmark or table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.llm.common import let
from glyphfold.session import broadcast_if_small, cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
#: Rows of (hash, item, limit) broadcast at once: about 5 MB.
INDEX_ROWS = 100_000
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _starts(words: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.size(words) - width)


def shingle_hashes(text: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of the given widths, with repeats."""
    none = F.array().cast("array<bigint>")

    def of_width(h: Column, width: int) -> Column:
        made = F.transform(_starts(h, width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))
        return F.when(F.size(h) < width, none).otherwise(made)

    def of_hashes(h: Column) -> Column:
        parts = [of_width(h, width) for width in widths]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(F.transform(plain_words(text), lambda w: F.xxhash64(w)), of_hashes)


def shingle_texts(text: Column, widths: list[int]) -> Column:
    """Distinct shingles of the given widths, as words joined by one space."""
    none = F.array().cast("array<string>")

    def of_width(words: Column, width: int) -> Column:
        made = F.transform(_starts(words, width), lambda i: F.concat_ws(" ", *[words[i + k] for k in range(width)]))
        return F.when(F.size(words) < width, none).otherwise(made)

    return let(plain_words(text), lambda words: F.array_distinct(F.concat(*[of_width(words, w) for w in widths])))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_item, _width, _shingle): the distinct shingles of each item."""
    words = items.select(F.col(id_col).alias("_item"), F.col(text_col).alias("_text")).filter(F.col("_item").isNotNull())
    width = F.least(F.lit(SHINGLE), F.size(plain_words(F.col("_text"))))
    sized = words.withColumn("_width", width).filter(F.col("_width") > 0)
    made = [
        sized.filter(F.col("_width") == w).select("_item", "_width", F.explode(shingle_texts(F.col("_text"), [w])).alias("_shingle"))
        for w in range(1, SHINGLE + 1)
    ]
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out.distinct()


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_hash, _item, _least): for each item its k smallest hashes, and the shingles a containing document has at least."""
    narrow = [
        F.when(F.col("_width") == w, F.xxhash64(*[F.xxhash64(F.get(F.split("_shingle", " "), F.lit(k))) for k in range(w)]))
        for w in range(1, SHINGLE + 1)
    ]
    hashed = shingles.select("_item", F.coalesce(*narrow).alias("_hash"))
    # An item's own shingles: bounded by its length.
    per_item = hashed.groupBy("_item").agg(F.sort_array(F.collect_set("_hash")).alias("_all"))
    size = F.size("_all")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1) - 1  # of the item's partition
    k = (F.floor(F.round(largest * (1 - threshold), 6)) + 1).cast("int")
    least = F.ceil(F.round(size * threshold, 6)).cast("int")
    return per_item.select("_item", least.alias("_least"), F.explode(F.slice("_all", F.lit(1), k)).alias("_hash"))


def document_row(id_col: str, text_col: str) -> Column:
    """What tells a row from others of its id: the id and a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def candidates(rows: DataFrame, sketch: DataFrame, widths: list[int], index_rows: int = INDEX_ROWS) -> DataFrame:
    """(_doc, _item): pairs that share a sketch entry, the document (rows: _doc, _text) being long enough."""
    blocks = max(1, math.ceil(sketch.count() / index_rows))
    probe = rows.select("_doc", shingle_hashes(F.col("_text"), widths).alias("_all")).select(
        "_doc", F.size("_all").alias("_size"), F.explode("_all").alias("_hash")
    )
    found = None
    for block in range(blocks):
        # Blocks are cut by hash, so that each has its share of the counted rows.
        part = sketch if blocks == 1 else sketch.filter(F.pmod(F.xxhash64("_hash"), F.lit(blocks)) == block)
        met = probe.join(F.broadcast(part), "_hash").filter(F.col("_size") >= F.col("_least")).select("_doc", "_item")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """(id, item, n_shared, n_item_shingles, containment): pairs of containment at or over ``threshold``."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(document_row(id_col, text_col).alias("_doc"), F.col(text_col).alias("_text"))
    shingles = cut_lineage(item_shingles(items, item_col, item_text_col))
    widths = sorted(row[0] for row in shingles.select("_width").distinct().collect())  # at most five
    sizes = shingles.groupBy("_item").agg(F.count(F.lit(1)).alias("_n"))
    pairs = cut_lineage(candidates(rows, cut_lineage(sketches(shingles, threshold)), widths or [SHINGLE], index_rows))
    few = broadcast_if_small(pairs.select("_doc").distinct(), index_rows)
    texts = rows.join(few, "_doc", "left_semi")
    held = texts.select("_doc", F.explode(shingle_texts(F.col("_text"), widths or [SHINGLE])).alias("_shingle"))
    index = broadcast_if_small(shingles.select("_shingle", "_item"), index_rows)
    shared = held.join(index, "_shingle").groupBy("_doc", "_item").agg(F.count_distinct("_shingle").alias("n_shared"))
    return (
        shared.join(pairs, ["_doc", "_item"])
        .join(sizes, "_item")
        .withColumn("containment", F.col("n_shared") / F.col("_n"))
        .filter(F.col("containment") >= threshold)
        .select(
            F.col("_doc.id").alias(id_col), F.col("_item").alias(item_col), "n_shared", F.col("_n").alias("n_item_shingles"), "containment"
        )
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that contain an item, rows without an id among them."""
    row = document_row(id_col, text_col)
    found = contained_items(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), items, "_row", "_text")
    leaked = broadcast_if_small(cut_lineage(found.select("_row").distinct()))
    # Structs are equal where the same fields are null.
    return docs.alias("d").join(leaked.alias("l"), document_row(f"d.{id_col}", f"d.{text_col}") == F.col("l._row"), "left_anti")

"""From raw documents to packed training sequences, in five stages.

Each stage gets all that its predecessor kept, as a table read from Parquet,
and returns the columns of ``documents``; the last returns the packed pieces.

A row is known by its id and text: rows that share an id but not a text, and
rows without an id, are documents of their own in every stage.  Rows that are
equal in both are one document to the near-duplicate stage, which leaves one.
Line de-duplication counts rows of one id as one document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.llm import decontaminate, line_dedup, near_dups, packing, quality
from glyphfold.llm.common import table
from glyphfold.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share this part of their shingles, or more; the query of the operator has a limit of its own.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Rows without an id stay or go by what the rules say of their text."""
    # One verdict for each id and text, so that repeated rows do not multiply.
    marked = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("text")).alias("_row"))
    verdicts = quality.judge(marked, id_col="_row").filter("kept").select(
        F.col("_row.doc_id").alias("_id"), F.col("_row.text").alias("_text")
    )
    kept = marked.join(
        verdicts, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_row.text") == F.col("_text")), "left_semi"
    )
    return kept.select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents repeat."""
    # A row without an id gets one below zero, from its text, so that its lines count as well.
    own = F.lit(-1).cast("long") - F.shiftrightunsigned(F.xxhash64("text"), 1)
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS, F.coalesce("doc_id", own).alias("_row")), "_row")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, any id before none; of equal rows one stays."""
    row = F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text"),
        F.xxhash64(F.lit(1), "text").alias("more"),
    )
    marked = docs.select(*COLUMNS, row.alias("_row"))
    found = near_dups.near_duplicates(marked, "_row", percent=PERCENT)
    gone = found.filter(~F.col("kept")).select("_row").distinct()
    return marked.join(gone, "_row", "left_anti").dropDuplicates(["_row"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.digest(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dups", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: MinHash candidates, components and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

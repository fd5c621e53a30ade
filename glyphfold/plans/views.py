"""Positioned text derived from the plain test tables.

The tables hold no page layout, so a deterministic one is derived: a document's
lines become lines of pages of 50, its space-separated tokens become atoms.
Documents are shuffled once by ``doc_id`` while the text is still compact, into
partitions whose number grows with the text; every later window, aggregate or
join on (doc_id, ...) then needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphfold.session import deal, text_parts
from glyphfold.sources.corpus import read_table

LINES_PER_PAGE = 50


def document_span(spark: SparkSession, path: str) -> int:
    """One more than the largest document id: requests are dealt over all documents by it."""
    return int(read_table(spark, path, "documents").agg(F.max("doc_id")).first()[0] or 0) + 1


def lines(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    docs = read_table(spark, path, "documents").select("doc_id", "text", *extra)
    return lines_of(docs, extra)


def lines_of(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    pieces = docs.select("doc_id", *extra, F.posexplode(F.split("text", "\n")).alias("_p", "text"))
    return pieces.select(
        "doc_id",
        *extra,
        F.floor(F.col("_p") / LINES_PER_PAGE).cast("int").alias("page"),
        (F.col("_p") + 1).alias("line_no"),
        "text",
    )


def tokens_of(line_rows: DataFrame) -> DataFrame:
    """Atoms of lines.  ``x`` is the running text length, so the rows of a line
    must be together: the input should be partitioned by doc_id already."""
    w = (
        Window.partitionBy("doc_id", "page", "line_no")
        .orderBy("tok_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    text = F.col("text")
    style = (
        F.when(text.rlike(r"^\p{Lu}"), "upper")
        .when(text.rlike("^[0-9]+$"), "digit")
        .when(text.contains("@"), "at")
        .otherwise("other")
    )
    return (
        line_rows.select("doc_id", "page", "line_no", F.posexplode(F.split("text", " ")).alias("_p", "text"))
        .withColumn("tok_no", F.col("_p") + 1)
        .withColumn("x", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("double"))
        .filter(text != "")
        .select(
            "doc_id",
            "page",
            "line_no",
            "tok_no",
            "text",
            "x",
            (-((F.col("line_no") - 1) % LINES_PER_PAGE)).cast("double").alias("y"),
            F.length("text").cast("double").alias("w"),
            F.lit(1.0).alias("h"),
            style.alias("style_key"),
            ((F.col("doc_id") + F.col("tok_no")) % 8).cast("int").alias("mode"),
        )
    )


def document_parts(spark: SparkSession, path: str) -> int:
    """How many partitions the documents' text asks for."""
    return text_parts(read_table(spark, path, "documents"))


def dealt(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(doc_id, text) of all documents, by document in as many partitions as the text asks for, or in ``parts``."""
    docs = read_table(spark, path, "documents").select("doc_id", "text")
    return deal(docs, "doc_id", parts or document_parts(spark, path))


def atoms(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    return tokens_of(lines_of(dealt(spark, path, parts)))


def page_space(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """One media box per page; every fifth document has a crop box, every eleventh a bad unit.

    With ``parts`` the pages lie as atoms in as many partitions do.
    """
    rows = lines_of(dealt(spark, path, parts)) if parts else lines(spark, path)
    pages = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    crop = F.col("doc_id") % 5 == 0
    return pages.select(
        "doc_id",
        "page",
        *[F.lit(v).alias(n) for n, v in (("x0", 0.0), ("y0", -50.0), ("x1", 200.0), ("y1", 1.0))],
        *[F.when(crop, v).alias(n) for n, v in (("cx0", 5.0), ("cy0", -60.0), ("cx1", 150.0), ("cy1", 0.0))],
        (90 * (F.col("doc_id") % 4)).cast("int").alias("rotate"),
        F.when(F.col("doc_id") % 11 == 3, 0.0).otherwise(1.0 + F.col("doc_id") % 2).alias("user_unit"),
    )


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Parts as fonts: three coverage sets, four sources, weights by type."""
    part = read_table(spark, path, "part")
    pk = F.col("p_partkey")
    cover = (
        F.when(pk % 3 == 0, F.array(*[F.lit(c) for c in range(97, 123)]))
        .when(pk % 3 == 1, F.array(*[F.lit(c) for c in (32, *range(97, 123))]))
        .otherwise(F.array(*[F.lit(c) for c in range(97, 117)]))
    )
    return part.select(
        pk.alias("font_id"),
        F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name_key"),
        F.element_at(F.split("p_name", " "), -1).alias("family_key"),
        F.when(F.col("p_type") == "ECONOMY", 300).when(F.col("p_type") == "PROMO", 700).otherwise(400).alias("weight"),
        (F.col("p_size") % 2 == 1).alias("italic"),
        cover.alias("code_points"),
        F.element_at(F.array(*[F.lit(s) for s in ("embedded", "local", "upload", "bundled")]), (pk % 4 + 1).cast("int")).alias(
            "source"
        ),
        F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("hash"),
    )


def commands(spark: SparkSession, path: str) -> DataFrame:
    return commands_of(read_table(spark, path, "events"))


def commands_of(events: DataFrame) -> DataFrame:
    """Events as edit commands of one document per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    op = (
        F.when(F.col("event_type") == "signup", F.when(k % 3 == 0, "open").otherwise("apply"))
        .when(F.col("event_type") == "view", F.when(k % 2 == 0, "preview").otherwise("export"))
        .when(F.col("event_type") == "click", "apply")
        .when(F.col("event_type") == "purchase", "validate")
        .otherwise(F.when(k % 7 == 0, "close").otherwise("validate"))
    )
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        "ts",
        op.alias("op"),
        (k % 3).cast("bigint").alias("expected_revision"),
        (k % 5 != 4).alias("valid"),
    )


def edits(spark: SparkSession, path: str) -> DataFrame:
    """One edit per document: its first line with ``@``, else its longest line; picked inside the row."""
    docs = read_table(spark, path, "documents").select("doc_id", "text")

    def rank(text: Column, i: Column) -> Column:
        has_at = text.contains("@")
        return F.struct(
            F.when(has_at, 0).otherwise(1).alias("tier"),
            F.when(has_at, i + 1).otherwise(-F.length(text)).alias("weight"),
            (i + 1).alias("line_no"),
            F.floor(i / LINES_PER_PAGE).cast("int").alias("page"),
            text.alias("source_text"),
        )

    pick = docs.select("doc_id", F.array_min(F.transform(F.split("text", "\n"), rank)).alias("m")).filter("m is not null")
    padded = F.rpad(F.lit("[REDACTED]"), 14, ".")
    return pick.select(
        "doc_id",
        F.col("m.page").alias("page"),
        F.col("m.line_no").alias("line_no"),
        F.col("m.source_text").alias("source_text"),
        F.when(F.col("doc_id") % 2 == 0, padded).otherwise("[REDACTED]").alias("replacement"),
        (F.col("doc_id") % 3 != 0).alias("accept_substitution"),
    )

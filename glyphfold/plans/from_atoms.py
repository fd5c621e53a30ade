"""From atoms to proof: layout, plan on fonts, guarded apply and evidence over tables that share a partitioning.

Groups of text are laid out once and written as a table bucketed by document.
Everything after that reads this table: the source texts, the plan, the applied
text and the pages on both sides of the proof.  The plan, the outcomes and the
expectations, which are narrow, are written in the same buckets, so what follows
meets as it lies and no text is exchanged again (see :func:`by_document`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.operators.ordered import Sequence
from glyphfold.plans import layout
from glyphfold.plans.proof import look_up, page_items
from glyphfold.plans.redaction import apply_edits, extraction_evidence, plan_with_fonts
from glyphfold.session import ALL_KEYS, KEYS_BEFORE, shared_folder

PAGE = ["doc_id", "page"]
BOX = ["x", "y", "w", "h"]
_ALL_KEYS = ALL_KEYS


@contextmanager
def by_document(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside may meet on a part of their keys: tables in buckets of ``doc_id`` meet on (doc_id, page) as they lie."""
    before = spark.conf.get(_ALL_KEYS, None)
    if before == "false":
        # Dealing texts has set it as well; what was before that comes back.
        before = spark.conf.get(KEYS_BEFORE, before) or None
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ALL_KEYS)
        else:
            spark.conf.set(_ALL_KEYS, before)


def _number(spark: SparkSession, buckets: int | None) -> int:
    return buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_buckets(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """``rows`` as a table in buckets of ``doc_id``, in the shared folder; one file a bucket.

    ``buckets`` should grow with the corpus, so that a bucket is a task's worth
    of text; without it there are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    buckets = _number(spark, buckets)
    name = f"by_document_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, "doc_id").write.format("parquet").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(name)
    return spark.table(name)


def text_groups(placed: DataFrame, style: list[str], buckets: int | None = None) -> DataFrame:
    """Placed atoms (:func:`layout.place_atoms`, with kind, reasons, font_id and advance) as a table of groups.

    doc_id, page, line_no, group_no, seq (from 1 inside the document), text, box,
    kind, reasons, font_id (of the first atom), advance (largest), char_start and
    char_end in the document's text, which is its groups joined by line feeds.
    Line feeds inside a group count as spaces.
    """
    with by_document(placed.sparkSession):
        own = {"font_id": F.min_by("font_id", "tok_no"), "advance": F.max("advance")}
        _, groups = layout.layout_pages(placed, style, reasons=True, also=own)
        plain = groups.withColumn("text", F.translate("text", "\n", " "))
        numbered = (
            Sequence(plain, ["doc_id"], ["page", "line_no", "group_no"])
            .row_number("seq")
            .running_sum("char_end", F.length("text") + 1)
            .with_column("char_end", F.col("char_end") - 1)
            .with_column("char_start", F.col("char_end") - F.length("text"))
            .done()
        )
        return write_buckets(numbered, buckets)


def documents(groups: DataFrame) -> DataFrame:
    """(doc_id, text, places): each document's text and the places of its groups, in their order."""
    place = F.struct("seq", "page", *BOX)
    return groups.groupBy("doc_id").agg(
        F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY seq)").alias("text"), F.sort_array(F.collect_list(place)).alias("places")
    )


def shown(docs: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text, box): the lines of the texts at their places; one too many or too few has no place or text."""
    items = F.arrays_zip(F.split("text", "\n").alias("line"), F.col("places").alias("place"))
    rows = docs.select("doc_id", F.explode(items).alias("_i"))
    return rows.select("doc_id", "_i.place.page", "_i.place.seq", F.col("_i.line").alias("text"), *[f"_i.place.{c}" for c in BOX])


def plan_groups(groups: DataFrame, edits: DataFrame, fonts: DataFrame, styles: DataFrame, buckets: int | None = None) -> DataFrame:
    """The plan of edits on fonts (:func:`plan_with_fonts`), written once.

    edits: doc_id, page, source_text, replacement, accept_substitution, font_id
    (a choice, or null); fonts: the catalogue; styles: font_id, name_key,
    family_key, subfamily, weight, italic of the source's fonts.
    """
    own = styles.withColumnRenamed("font_id", "_own")
    styled = groups.withColumnRenamed("font_id", "_own").join(own, "_own", "left").drop("_own")
    base = F.struct(F.col("kind").alias("kind"), F.col("reasons").alias("reasons"))
    ready = styled.withColumns({"base": base, "dx": F.lit(1.0), "dy": F.lit(0.0)})
    plan = plan_with_fonts(edits, ready, fonts, F.lit(0)).withColumn("selection_id", F.col("doc_id"))
    return write_buckets(plan.drop("base", "verdict"), buckets)


def expected(groups: DataFrame, outcomes: DataFrame, buckets: int | None = None) -> DataFrame:
    """What the pages should show of applied edits, written; equal old text elsewhere is counted on the source page."""
    asked = outcomes.filter("outcome = 'APPLIED'").select(
        *PAGE, F.col("doc_id").alias("exp_id"), *BOX, F.col("source_text").alias("old_text"), F.col("replacement").alias("new_text")
    )
    seen = look_up(page_items(groups, PAGE, "seq"), asked, PAGE, lie=(_number(groups.sparkSession, buckets), "doc_id")).select(*PAGE, "exp_id", F.col("old_outside").alias("expected_outside"))
    return write_buckets(asked.join(seen, [*PAGE, "exp_id"]), buckets)


def evidence_of(after: DataFrame, asked: DataFrame, buckets: int | None = None) -> DataFrame:
    """The proof (RDX8) of what was applied."""
    return extraction_evidence(shown(after), asked, PAGE, "seq", lie=(_number(after.sparkSession, buckets), "doc_id"))


def redact_groups(groups: DataFrame, edits: DataFrame, fonts: DataFrame, styles: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per document with text: digest of the text after, outcome and font of its edit, evidence.

    groups: see :func:`text_groups`, of as many ``buckets``; at most one edit a
    document.  The result is narrow and written, in the same buckets.
    """
    with by_document(groups.sparkSession):
        plan = plan_groups(groups, edits, fonts, styles, buckets)
        after, outcomes = apply_edits(documents(groups), plan)
        outcomes = write_buckets(outcomes, buckets)
        evidence = evidence_of(after, expected(groups, outcomes, buckets), buckets)
        told = outcomes.select("doc_id", "page", F.when(F.col("matches") == 1, F.col("line_no")).alias("line_no"), "outcome", "font_id")
        proof = evidence.select("doc_id", "old_absent", "new_present", "old_outside", "outside_preserved", "valid")
        digests = after.select("doc_id", F.sha2("text", 256).alias("text_digest"))
        return write_buckets(digests.join(told, "doc_id", "left").join(proof, "doc_id", "left"), buckets)

"""Source and sink queries (SRC1-SRC4, SNK1, SNK2, UDF2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.joins import docs_by_id
from glyphfold.functions.extract import extract
from glyphfold.plans import views
from glyphfold.sources import files as FS
from glyphfold.session import shared_folder
from glyphfold.sources import layout as L
from glyphfold.sources import manifest as M
from glyphfold.sources import sinks as K
from glyphfold.schemas import TABLES
from glyphfold.sources.corpus import load_verified, read_table


def scratch(spark: SparkSession) -> str:
    """A folder for output of a query: beside the checkpoints that tasks share."""
    return f"{shared_folder(spark)}/glyphfold-{uuid.uuid4().hex}"


@query(
    "src1_corpus_scan",
    """SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars > 200 GROUP BY ALL""",
)
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").filter("n_chars > 200")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query(
    "src1_verified_load",
    """SELECT 'region' AS name, 'LOADED' AS outcome, count(*) AS rows, count(*) AS handed_on FROM region UNION ALL SELECT 'nation', 'ROWS_MISMATCH', count(*), 0 FROM nation
UNION ALL SELECT 'supplier', 'DIGEST_MISMATCH', count(*), 0 FROM supplier UNION ALL SELECT 'part', 'SCHEMA_MISMATCH', 0, 0 UNION ALL SELECT 'customer', 'LOADED', count(*), count(*) FROM customer""",
)
def verified_load(spark: SparkSession, d: str) -> DataFrame:
    """Tables against manifests, of which one has another number of rows, one another content and one another type."""
    outcomes = []
    for name in ("region", "nation", "supplier", "part", "customer"):
        given = read_table(spark, d, name)
        # A manifest of the supplier table before one balance changed.
        known = given.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 3, 0.0).otherwise(F.col("s_acctbal"))) if name == "supplier" else given
        mark = K.fingerprint_dataset(known).first()
        schema = TABLES[name].replace("p_size int", "p_size bigint")
        table, outcome = load_verified(spark, name, f"{d}/{name}.parquet", schema, mark["rows"] + (name == "nation"), mark["sha256"])
        outcomes.append((name, outcome.outcome, outcome.rows, table.count()))
    return spark.createDataFrame(outcomes, "name string, outcome string, rows bigint, handed_on bigint")


@query(
    "src2_verify",
    """WITH i AS (SELECT 'doc-' || doc_id AS path, doc_id, left(text, 1) AS first, strlen(text) AS len, sha256(text) AS h, text FROM documents WHERE doc_id % 29 <> 0)
SELECT path, CASE WHEN reason IS NULL THEN 'verified' ELSE 'rejected' END AS status, reason FROM (
SELECT path, CASE WHEN doc_id % 31 = 0 THEN 'not-in-manifest' WHEN doc_id % 23 = 3 THEN 'signature' WHEN doc_id % 10 = 1 THEN 'byte-length' WHEN len > 6000 THEN 'size-policy' WHEN doc_id % 10 = 2 THEN 'sha256' END AS reason FROM i
UNION ALL SELECT 'doc-' || doc_id, 'file-missing' FROM documents WHERE doc_id % 29 = 0 AND doc_id % 31 <> 0)""",
)
def verify(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    doc = F.col("doc_id")
    path = F.concat(F.lit("doc-"), doc.cast("string"))
    files = docs.filter(doc % 29 != 0).select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    length = F.octet_length("text").cast("bigint")
    manifest = docs.filter(doc % 31 != 0).select(
        path.alias("path"),
        F.when(doc % 10 == 1, length + 1).otherwise(length).alias("want_length"),
        F.lit(0).cast("bigint").alias("min_bytes"),
        F.lit(6000).cast("bigint").alias("max_bytes"),
        F.when(doc % 10 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("want_sha256"),
        F.when(doc % 23 == 3, "%PDF-")
        .otherwise(F.decode(F.substring(F.encode("text", "UTF-8"), 1, 5), "ISO-8859-1"))
        .alias("want_signature"),
    )
    inventory = FS.inventory_files(files)
    return FS.verify_files(inventory, manifest, F.col("want_signature"))


@query("src2_binary_files")
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    files = FS.inventory_folder(spark, d, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "signature", "length", "sha256")


@query(
    "src3_manifest",
    """WITH j AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'unknown-key' WHEN 2 THEN 'missing-key' WHEN 3 THEN 'wrong-type' WHEN 4 THEN 'not-an-object' ELSE CASE WHEN k > 90 THEN 'out-of-range' END END AS problem,
  CASE WHEN event_id % 10 IN (1, 2, 3, 4) OR k > 90 THEN NULL ELSE k END AS k FROM j""",
)
def manifest(spark: SparkSession, d: str) -> DataFrame:
    case = F.col("event_id") % 10
    props = F.col("props")
    seeded = (
        F.when(case == 1, F.replace(props, F.lit("}"), F.lit(', "extra": 1}')))
        .when(case == 2, F.lit("{}"))
        .when(case == 3, F.lit('{"k": "many"}'))
        .when(case == 4, F.lit("[1, 2]"))
        .otherwise(props)
    )
    rows = read_table(spark, d, "events").select("event_id", seeded.alias("body"))
    parsed = M.parse_manifest(rows, "body", "k int", ranges={"k": (0, 90)})
    return parsed.select("event_id", "problem", "doc.k")


@query(
    "src3_children",
    """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ordinal, event_type AS "sourceText", CAST(value AS VARCHAR) <> '' AS sound FROM events""",
)
def children(spark: SparkSession, d: str) -> DataFrame:
    # One manifest per user, made by Spark from its events; its edits come back as rows.
    one = F.struct("event_id", F.struct(F.col("event_type").alias("sourceText"), F.col("value").alias("pageIndex")).alias("e"))
    edits = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"])
    bodies = (
        read_table(spark, d, "events")
        .groupBy("user_id")
        .agg(F.to_json(F.struct(F.first("user_id").alias("suite"), edits.alias("edits"))).alias("body"))
    )
    schema = "suite bigint, edits array<struct<sourceText:string,pageIndex:double>>"
    good, _ = M.read_manifest(bodies, "body", schema)
    rows = M.child_table(good, ["user_id"], "edits")
    return rows.select("user_id", "ordinal", "sourceText", F.col("pageIndex").isNotNull().alias("sound"))


@query(
    "src3_nested",
    """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'unknown-key' WHEN 2 THEN 'missing-key' WHEN 3 THEN 'unknown-key' WHEN 4 THEN 'missing-key' WHEN 5 THEN 'wrong-type' END AS problem FROM events""",
)
def nested_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Exact keys inside a list of edits and inside an object of limits."""
    case, kind = F.col("event_id") % 8, F.col("event_type")
    good = F.concat(F.lit('{"sourceText": "'), kind, F.lit('", "pageIndex": 1}'))
    second = (
        F.when(case == 1, F.concat(F.lit('{"sourceText": "'), kind, F.lit('", "pageIndex": 2, "extra": 0}')))
        .when(case == 2, F.lit('{"pageIndex": 2}'))
        .otherwise(good)
    )
    limits = (
        F.when(case == 3, F.lit('{"bytes": 1, "extra": 2}'))
        .when(case == 4, F.lit("{}"))
        .when(case == 5, F.lit('{"bytes": "many"}'))
        .otherwise(F.lit('{"bytes": 1}'))
    )
    body = F.concat(F.lit('{"edits": ['), good, F.lit(", "), second, F.lit('], "limits": '), limits, F.lit("}"))
    rows = read_table(spark, d, "events").select("event_id", body.alias("body"))
    schema = "edits array<struct<sourceText:string,pageIndex:bigint>>, limits struct<bytes:bigint>"
    return M.parse_manifest(rows, "body", schema).select("event_id", "problem")


@query(
    "src4_flatten",
    """WITH w AS (SELECT conv_id, turn, t, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT conv_id, turn, text AS t, string_split(text, chr(10)) AS ls FROM conversations)),
g AS (SELECT *, list_filter(string_split(line, ' '), lambda s: s <> '') AS words FROM w)
SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(line_no - 1 AS INTEGER) AS line_no, array_to_string(words, ' ') AS text, 0.0::DOUBLE AS x, round((800 - 10.0 * line_no) * 0.5, 4)::DOUBLE AS y, round(len(words) * 6.0 * 2.0, 4)::DOUBLE AS w, round(8.0 * 0.5, 4)::DOUBLE AS h FROM g WHERE len(words) > 0""",
)
def flatten(spark: SparkSession, d: str) -> DataFrame:
    # Each turn becomes one nested page: one flow, one block, its lines, their words.
    def word(w, i, n):
        return F.struct(
            w.alias("text"),
            (i * 6.0).cast("double").alias("xMin"),
            (n * 10.0 + 2.0).cast("double").alias("yMin"),
            (i * 6.0 + 6.0).cast("double").alias("xMax"),
            (n * 10.0 + 10.0).cast("double").alias("yMax"),
        )

    def line(text, n):
        words = F.filter(F.split(text, " "), lambda s: s != "")
        return F.struct(F.transform(words, lambda w, i: word(w, i, n)).alias("words"))

    lines = F.transform(F.split("text", "\n"), line)
    size = [F.lit(100.0).alias("width"), F.lit(800.0).alias("height")]
    listed = F.struct(*size, F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("blocks"))).alias("flows"))
    # Every second page has its only flow and block without a list around them.
    alone = F.struct(*size, F.struct(F.struct(lines.alias("lines")).alias("blocks")).alias("flows"))
    nested = F.when(F.col("conv_id") % 2 == 0, F.to_json(alone)).otherwise(F.to_json(listed))
    pages = read_table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), nested.alias("body"))
    items = L.flatten_layout(
        pages, ["conv_id", "turn"], L.read_page(F.col("body")), F.lit(200.0), F.lit(400.0)
    )
    return items.select(
        "conv_id", "turn", "line_no", "text", "x", F.round("y", 4).alias("y"), F.round("w", 4).alias("w"), F.round("h", 4).alias("h")
    )


@query(
    "snk1_report",
    """SELECT '{"chars":' || CAST(sum(n_chars) AS BIGINT) || ',"documents":' || count(*) || ',"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}' AS value FROM documents GROUP BY lang, source""",
)
def report(spark: SparkSession, d: str) -> DataFrame:
    """Writes the report and reads its bytes back: path ending, length, hash."""
    summary = read_table(spark, d, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )
    out = scratch(spark)
    K.write_report(summary, out, ["lang", "source"])
    return spark.read.text(f"{out}/json")


_LIMBS_SQL = ", ".join(
    f"sum(CAST(CAST('0x' || substr(d, {1 + 13 * i}, {13 if i < 4 else 12}) AS BIGINT) AS DECIMAL(38,0))) AS s{i}" for i in range(5)
)


@query(
    "snk2_fingerprint",
    f"""WITH h AS (SELECT lang, sha256('{{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":' || to_json(source) || ',"text":' || to_json(text) || '}}') AS d FROM documents),
s AS (SELECT lang, count(*) AS n, {_LIMBS_SQL} FROM h GROUP BY lang)
SELECT lang, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3 || ':' || s4) AS sha256, n AS rows FROM s""",
)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return K.fingerprint_dataset(read_table(spark, d, "documents"), ["lang"])


@query(
    "snk2_dataset_fingerprint",
    f"""WITH h AS (SELECT sha256('{{"c_acctbal":' || to_json(c_acctbal) || ',"c_custkey":' || c_custkey || ',"c_mktsegment":' || to_json(c_mktsegment) || ',"c_name":' || to_json(c_name) || ',"c_nationkey":' || c_nationkey || '}}') AS d FROM customer),
s AS (SELECT count(*) AS n, {_LIMBS_SQL} FROM h)
SELECT sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3 || ':' || s4) AS sha256, n AS rows FROM s""",
)
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return K.fingerprint_dataset(read_table(spark, d, "customer"))


@query(
    "udf2_extract",
    """WITH m AS (SELECT page_id, unnest(t) AS m, generate_subscripts(t, 1) - 1 AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<(?:title|h1|p)>[^<]*') AS t FROM pages))
SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, regexp_extract(m, '<(title|h1|p)>', 1) AS kind, regexp_extract(m, '>(.*)', 1, 's') AS text FROM m""",
)
def extraction(spark: SparkSession, d: str) -> DataFrame:
    return extract(read_table(spark, d, "pages"), "page_id", "html")

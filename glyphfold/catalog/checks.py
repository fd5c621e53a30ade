"""Check queries (VAL1-VAL9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.sqlviews import ATOMS
from glyphfold.operators import checks as C
from glyphfold.plans import views
from glyphfold.sources.corpus import read_table

DOC_LIMITS = {"file_bytes": 20_000, "objects": 40, "nesting_depth": 12, "stream_bytes": 2_500, "operations": 1_500}


def doc_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a document from its own row: no explode, no shuffle."""
    lines = F.split("text", "\n")
    return read_table(spark, d, "documents").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("file_bytes"),
        F.size(lines).cast("bigint").alias("objects"),
        (F.col("doc_id") % 14).alias("nesting_depth"),
        F.array_max(F.transform(lines, F.length)).cast("bigint").alias("stream_bytes"),
        F.size(F.split("text", "[ \n]")).cast("bigint").alias("operations"),
    )


METRICS_SQL = """m AS (SELECT doc_id, strlen(text) AS file_bytes, len(string_split(text, chr(10))) AS objects, doc_id % 14 AS nesting_depth,
  list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS stream_bytes,
  len(string_split(replace(text, chr(10), ' '), ' ')) AS operations FROM documents)"""


@query(
    "val1_limits",
    f"""WITH {METRICS_SQL}, v AS (SELECT *, CASE WHEN file_bytes > 20000 THEN 'file_bytes' WHEN objects > 40 THEN 'objects' WHEN nesting_depth > 12 THEN 'nesting_depth'
  WHEN stream_bytes > 2500 THEN 'stream_bytes' WHEN operations > 1500 THEN 'operations' END AS resource FROM m)
SELECT doc_id, resource IS NULL AS ok, resource,
  CAST(CASE resource WHEN 'file_bytes' THEN 20000 WHEN 'objects' THEN 40 WHEN 'nesting_depth' THEN 12 WHEN 'stream_bytes' THEN 2500 WHEN 'operations' THEN 1500 END AS BIGINT) AS "limit",
  CAST(CASE resource WHEN 'file_bytes' THEN file_bytes WHEN 'objects' THEN objects WHEN 'nesting_depth' THEN nesting_depth WHEN 'stream_bytes' THEN stream_bytes WHEN 'operations' THEN operations END AS BIGINT) AS observed
FROM v""",
)
def limits(spark: SparkSession, d: str) -> DataFrame:
    return C.apply_limits(doc_metrics(spark, d), "doc_id", DOC_LIMITS)


@query(
    "val2_constraints",
    """SELECT 'orders.custkey' AS field, CAST(o_custkey AS VARCHAR) AS subject FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 1000 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) )
UNION ALL SELECT 'lineitem.key', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'labels.doc', CAST(doc_id AS VARCHAR) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de'))
UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT (o_orderstatus IN ('F', 'O'))
UNION ALL SELECT 'price', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 450000)""",
)
def constraints(spark: SparkSession, d: str) -> DataFrame:
    orders, lineitem = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    customers = read_table(spark, d, "customer").filter("c_custkey % 3 <> 0")
    documents = read_table(spark, d, "documents").filter("lang <> 'de'")
    bad_ref = orders.withColumn("_k", F.col("o_custkey") % 1000)
    known = customers.select(F.col("c_custkey").alias("_k"))
    missing = bad_ref.join(known, "_k", "left_anti").select("o_custkey").distinct()
    return C.check_constraints(
        missing.select(F.lit("orders.custkey").alias("field"), F.col("o_custkey").cast("string").alias("subject")),
        C.unique_violations(lineitem, ["l_orderkey", "l_linenumber"], "lineitem.key"),
        C.reference_violations(read_table(spark, d, "labels"), documents, "doc_id", "doc_id", "labels.doc"),
        C.row_violations(
            orders,
            "o_orderkey",
            {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice").between(1000, 450000)},
        ),
    )


FEATURES = {
    "script": "<script",
    "form": "<form",
    "iframe": "<iframe",
    "link": "<a href",
    "advert": 'class="ad"',
    "comment": "<!--",
    "bold": "<b>",
}


@query(
    "val3_features",
    "SELECT page_id, array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN contains(html, '{FEATURES[n]}') THEN '{n}' END" for n in sorted(FEATURES)
    ) + "], lambda x: x IS NOT NULL), ',') AS features FROM pages",
)
def features(spark: SparkSession, d: str) -> DataFrame:
    rules = {n: F.col("html").contains(mark) for n, mark in FEATURES.items()}
    flags = C.feature_flags(read_table(spark, d, "pages"), "page_id", rules)
    return flags.select("page_id", F.array_join("features", ",").alias("features"))


@query(
    "val4_policy",
    """WITH o AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, contains(html, '<script') AS script, contains(html, '<b>') AS marked,
  nullif(regexp_extract(html, 'lang="([^"]+)"', 1), '') AS lang, nullif(regexp_extract(html, 'charset="([^"]+)"', 1), '') AS charset FROM pages),
e AS (SELECT host, count(*) FILTER (script) AS sc, count(*) FILTER (marked) AS mk, max(lang) AS lang, max(charset) AS charset FROM o GROUP BY host)
SELECT host, sc > 0 AS script, sc AS script_count, CASE WHEN sc > 0 THEN 'direct' ELSE 'notObserved' END AS script_confidence,
  mk > 0 AS marked, mk AS marked_count, CASE WHEN mk > 0 THEN 'direct' ELSE 'notObserved' END AS marked_confidence,
  lang IS NOT NULL AS lang, lang AS lang_id, CASE WHEN lang IS NOT NULL THEN 'metadata' ELSE 'notObserved' END AS lang_confidence,
  array_to_string(list_filter([CASE WHEN lang IS NOT NULL THEN 'LANG' END, CASE WHEN mk > 0 THEN 'MARKED' END, CASE WHEN sc > 0 THEN 'SCRIPT' END], lambda x: x IS NOT NULL), ',') AS codes
FROM e""",
)
def policy(spark: SparkSession, d: str) -> DataFrame:
    objects = read_table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "html")
    html = F.col("html")
    found = C.policy_evidence(
        objects,
        "host",
        {"script": html.contains("<script"), "marked": html.contains("<b>")},
        {"lang": F.nullif(F.regexp_extract(html, 'lang="([^"]+)"', 1), F.lit(""))},
    )
    codes = C.disclosure_codes({"LANG": F.col("lang"), "MARKED": F.col("marked"), "SCRIPT": F.col("script")})
    return found.withColumn("codes", F.array_join(codes, ","))


@query(
    "val5_contiguity",
    f"""WITH {ATOMS}, r AS (SELECT a.*, CAST(a.x AS BIGINT) AS s, CAST(a.x + a.w + 1 + CASE WHEN a.doc_id % 7 = 0 AND tok_no = 2 THEN 1 ELSE 0 END AS BIGINT) AS e,
    length(l.text) + 1 AS total FROM v_atoms a JOIN v_lines l USING (doc_id, line_no)),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no), 0) AS pe FROM r),
f AS (SELECT *, CASE WHEN s < 0 OR e <= s THEN 'invalid' WHEN s < pe THEN 'overlap' WHEN s > pe THEN 'invalid' END AS fault FROM p)
SELECT doc_id, line_no, coalesce(arg_min(fault, tok_no) FILTER (fault IS NOT NULL), CASE WHEN max(e) = max(total) THEN 'valid' ELSE 'invalid' END) AS verdict,
  min(tok_no) FILTER (fault IS NOT NULL) AS first_bad FROM f GROUP BY doc_id, line_no""",
)
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines_of(views.dealt(spark, d))
    sizes = lines.select("doc_id", "line_no", (F.length("text") + 1).cast("bigint").alias("total"))
    spread = F.when((F.col("doc_id") % 7 == 0) & (F.col("tok_no") == 2), 1).otherwise(0)
    ranges = views.tokens_of(lines).select(
        "doc_id",
        "line_no",
        "tok_no",
        F.col("x").cast("bigint").alias("s"),
        (F.col("x") + F.col("w") + 1 + spread).cast("bigint").alias("e"),
    )
    joined = ranges.join(sizes, ["doc_id", "line_no"])
    return C.check_contiguous(joined, ["doc_id", "line_no"], ["tok_no"], "s", "e", F.col("total"))


@query(
    "val6_entropy",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS ch FROM documents) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS uniq, sum(n) AS total, sum(n * log2(n)) AS nl FROM c GROUP BY doc_id)
SELECT doc_id, uniq, round(log2(total) - nl / total, 6) AS entropy, uniq >= 16 AND log2(total) - nl / total >= 1 AS useful FROM t""",
)
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return C.byte_entropy(read_table(spark, d, "documents"), "doc_id", "text").withColumn("entropy", F.round("entropy", 6))


@query(
    "val7_dependencies",
    """SELECT 'part' AS relation, p_name AS key, count(DISTINCT p_brand) AS "values" FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT 'documents', sha256(text), count(DISTINCT source) FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1""",
)
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    parts = C.check_fd(read_table(spark, d, "part"), ["p_name"], "p_brand")
    docs = read_table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "source")
    return parts.select(F.lit("part").alias("relation"), F.col("p_name").alias("key"), "values").unionByName(
        C.check_fd(docs, ["key"], "source").select(F.lit("documents").alias("relation"), "key", "values")
    )


@query(
    "val8_allow_list",
    """WITH c AS (SELECT n_nationkey, n_name, CAST(CASE WHEN n_nationkey % 6 = 5 THEN n_regionkey + 1 ELSE n_regionkey END AS INTEGER) AS n_regionkey,
    CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE 'N' || n_nationkey END AS code, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT n_name, n_regionkey, 'N' || n_nationkey AS code FROM nation WHERE n_nationkey % 10 <> 9)
SELECT c_custkey, CASE WHEN a.n_name IS NULL THEN 'not-approved' WHEN c.n_regionkey IS DISTINCT FROM a.n_regionkey THEN 'n_regionkey'
  WHEN c.code IS DISTINCT FROM a.code THEN 'code' END AS breach FROM c LEFT JOIN a USING (n_name)""",
)
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "nation")
    key = F.col("n_nationkey")
    used = nation.select(
        key.alias("c_nationkey"),
        "n_name",
        F.when(key % 6 == 5, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).alias("n_regionkey"),
        F.when(key % 8 != 3, F.concat(F.lit("N"), key)).alias("code"),
    )
    claims = read_table(spark, d, "customer").join(used, "c_nationkey")
    approved = nation.filter(key % 10 != 9).select("n_name", "n_regionkey", F.concat(F.lit("N"), key).alias("code"))
    return C.check_allow_list(claims, approved, "n_name", ["n_regionkey", "code"]).select("c_custkey", "breach")


@query(
    "val8_paths",
    """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' ELSE '' END || replace(regexp_replace(url, '^https?://', ''), '/', CASE page_id % 5 WHEN 1 THEN '/../' WHEN 2 THEN '\\' WHEN 3 THEN '..' ELSE '/' END) AS path FROM pages)
SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\\') AND NOT list_contains(string_split(path, '/'), '..') AS relative FROM p""",
)
def paths(spark: SparkSession, d: str) -> DataFrame:
    case = F.col("page_id") % 5
    bare = F.regexp_replace("url", "^https?://", "")
    joint = F.when(case == 1, "/../").when(case == 2, "\\").when(case == 3, "..").otherwise("/")
    path = F.concat(F.when(case == 0, "/").otherwise(""), F.replace(bare, F.lit("/"), joint))
    return read_table(spark, d, "pages").select("page_id", C.is_relative_path(path).alias("relative"))


@query(
    "val9_class_coverage",
    """WITH r AS (SELECT DISTINCT lang || ':' || source AS class FROM documents UNION SELECT DISTINCT 'xx:' || source FROM documents),
h AS (SELECT lang || ':' || source AS class, count(*) AS n FROM documents GROUP BY 1)
SELECT class, coalesce(n, 0) AS cases, n IS NOT NULL AS covered FROM r LEFT JOIN h USING (class)""",
)
def coverage_of_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    cases = docs.select("doc_id", F.array(F.concat_ws(":", "lang", "source")).alias("classes"))
    # Required: what was seen, and for every source a language that is not there.
    required = (
        docs.select(F.explode(F.array("lang", F.lit("xx"))).alias("lang"), "source")
        .distinct()
        .select(F.concat_ws(":", "lang", "source").alias("class"))
    )
    return C.class_coverage(cases, "classes", required)

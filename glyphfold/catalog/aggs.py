"""Aggregation queries (AGG1-AGG17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.checks import DOC_LIMITS, METRICS_SQL, doc_metrics
from glyphfold.catalog.joins import docs_by_id
from glyphfold.catalog.sqlviews import ATOMS, LINES
from glyphfold.functions.extract import extract
from glyphfold.operators import aggregates as A
from glyphfold.operators import checks as C
from glyphfold.operators import evidence as E
from glyphfold.operators import sequences as S
from glyphfold.plans import views
from glyphfold.sources.corpus import read_table


@query(
    "agg1_reference_counts",
    """SELECT l_partkey, count(*) AS refs, count(*) > 1 AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey""",
)
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    edges = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_partkey").alias("slot"))
    return A.reference_counts(edges, "l_orderkey", "slot", "l_partkey")


@query(
    "agg1_repeated_lines",
    f"""WITH {LINES} SELECT sha256(text) AS line_digest, count(*) AS refs, count(*) > 1 AS shared FROM (SELECT DISTINCT doc_id, text FROM v_lines) GROUP BY text""",
)
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    edges = views.lines(spark, d).select("doc_id", F.sha2("text", 256).alias("line_digest"))
    return A.reference_counts(edges.withColumn("slot", F.col("line_digest")), "doc_id", "slot", "line_digest")


@query(
    "agg2_resource_usage",
    f"""WITH {LINES} SELECT doc_id, max(total) AS file_bytes, count(*) AS objects, max(page) AS max_depth, max(sz) AS peak_bytes, CAST(sum(sz) AS BIGINT) AS total_bytes FROM (
  SELECT l.doc_id, l.page, CAST(strlen(l.text) AS BIGINT) AS sz, CAST(strlen(d.text) AS BIGINT) AS total FROM v_lines l JOIN documents d USING (doc_id)) GROUP BY doc_id""",
)
def usage(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(
        "doc_id", "text", F.octet_length("text").cast("bigint").alias("file_bytes")
    )
    streams = views.lines_of(docs, ("file_bytes",))
    return A.resource_usage(
        streams, "doc_id", F.octet_length("text").cast("bigint"), F.col("page"), F.col("file_bytes")
    )


@query(
    "agg3_reachability",
    # Orders use parts, parts a brand; brands and types name each other once, which closes cycles.
    """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT 'p' || p_partkey, 'b' || p_brand FROM part UNION SELECT 'b' || p_brand, 't' || arg_min(p_type, p_partkey) FROM part GROUP BY p_brand
  UNION SELECT 't' || p_type, 'b' || arg_max(p_brand, p_partkey) FROM part GROUP BY p_type),
w AS (SELECT 'o' || o_orderkey AS root, 'o' || o_orderkey AS node, 0 AS depth, ['o' || o_orderkey] AS path, 'OK' AS status FROM orders
  UNION ALL SELECT root, e.dst, depth + 1, list_append(path, e.dst), CASE WHEN list_contains(path, e.dst) THEN 'MALFORMED_INPUT' WHEN depth + 1 > 12 THEN 'RESOURCE_LIMIT' ELSE 'OK' END
  FROM w JOIN e ON w.node = e.src WHERE w.status = 'OK')
SELECT root, depth, status, count(*) AS paths, count(DISTINCT node) AS nodes FROM w GROUP BY ALL""",
)
def reachability(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    items = read_table(spark, d, "lineitem")

    def tag(letter: str, value: Column) -> Column:
        return F.concat(F.lit(letter), value.cast("string"))

    brand, kind, key = F.col("p_brand"), F.col("p_type"), F.col("p_partkey")
    edges = (
        items.select(tag("o", F.col("l_orderkey")).alias("src"), tag("p", F.col("l_partkey")).alias("dst"))
        .unionByName(part.select(tag("p", key).alias("src"), tag("b", brand).alias("dst")))
        .unionByName(part.groupBy(tag("b", brand).alias("src")).agg(tag("t", F.min_by(kind, key)).alias("dst")))
        .unionByName(part.groupBy(tag("t", kind).alias("src")).agg(tag("b", F.max_by(brand, key)).alias("dst")))
        .distinct()
    )
    roots = read_table(spark, d, "orders").select(tag("o", F.col("o_orderkey")).alias("root"))
    return A.walk_resources(roots, edges).groupBy("root", "depth", "status").agg(
        F.count(F.lit(1)).alias("paths"), F.count_distinct("node").alias("nodes")
    )


@query(
    "agg4_inventory",
    """WITH r AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS ord, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name,
   CASE WHEN p_type = 'PROMO' THEN 'not-embedded' WHEN p_size % 2 = 0 THEN 'embedded-not-reusable' ELSE 'standard-font' END AS reason FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey, lower(name) AS key, arg_min(name, ord) AS name, min(CASE reason WHEN 'not-embedded' THEN 0 WHEN 'embedded-not-reusable' THEN 1 ELSE 2 END) AS p FROM r GROUP BY ALL)
SELECT l_orderkey, key, name, ['not-embedded', 'embedded-not-reusable', 'standard-font'][p + 1] AS reason FROM g""",
)
def inventory(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    joined = items.join(part, items.l_partkey == part.p_partkey)
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    reason = (
        F.when(F.col("p_type") == "PROMO", "not-embedded")
        .when(F.col("p_size") % 2 == 0, "embedded-not-reusable")
        .otherwise("standard-font")
    )
    ordinal = F.col("l_linenumber") * F.lit(1_000_000).cast("bigint") + F.col("l_partkey")
    return A.inventory(joined, "l_orderkey", F.lower(name), name, ordinal, reason)


@query(
    "agg5_union_box",
    f"""WITH {ATOMS} SELECT doc_id, page, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM v_atoms GROUP BY ALL""",
)
def union_box(spark: SparkSession, d: str) -> DataFrame:
    return A.union_box(views.atoms(spark, d), ["doc_id", "page", "line_no"])


@query(
    "agg6_median",
    f"""WITH {ATOMS} SELECT style_key, line_no % 3 AS part, median(w) AS median_w, median(x) AS median_x FROM v_atoms GROUP BY ALL""",
)
def medians(spark: SparkSession, d: str) -> DataFrame:
    atoms = views.atoms(spark, d).select("style_key", (F.col("line_no") % 3).alias("part"), "w", "x")
    keys = ["style_key", "part"]
    return A.exact_median(atoms, keys, F.col("w"), "median_w").join(
        A.exact_median(atoms, keys, F.col("x"), "median_x"), keys
    )


@query(
    "agg7_percentiles",
    """SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99, quantile_disc(n_chars, 0.01) AS p01 FROM documents GROUP BY lang""",
)
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("lang", "n_chars")
    return A.exact_quantiles(docs, ["lang"], F.col("n_chars"), {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p01": 0.01})


@query(
    "agg8_thresholds",
    """WITH s AS (SELECT lang AS consumer, quality = 1 AS accepted, CASE WHEN lang = 'de' AND quality = 0 THEN 1000.0 ELSE 0 END + n_chars / 100000.0 AS mismatch,
   CASE WHEN lang = 'de' AND quality = 0 THEN -5.0 ELSE 1.0 END - (n_chars % 1000) / 2000.0 AS similarity FROM documents JOIN labels USING (doc_id)),
t AS (SELECT consumer, max(mismatch) FILTER (accepted) AS max_mismatch, min(similarity) FILTER (accepted) AS min_similarity,
   quantile_disc(mismatch, 0.99) FILTER (accepted) AS p99_mismatch, quantile_disc(mismatch, 0.5) FILTER (accepted) AS median_mismatch,
   quantile_disc(similarity, 0.01) FILTER (accepted) AS p01_similarity, quantile_disc(similarity, 0.5) FILTER (accepted) AS median_similarity,
   min(mismatch) FILTER (NOT accepted) AS lm, max(similarity) FILTER (NOT accepted) AS bs FROM s GROUP BY consumer)
SELECT consumer, round(max_mismatch, 6)::DOUBLE AS max_mismatch, round(min_similarity, 6)::DOUBLE AS min_similarity, round(p99_mismatch, 6)::DOUBLE AS p99_mismatch, round(median_mismatch, 6)::DOUBLE AS median_mismatch,
  round(p01_similarity, 6)::DOUBLE AS p01_similarity, round(median_similarity, 6)::DOUBLE AS median_similarity, round(max_mismatch + 0.001, 6)::DOUBLE AS mismatch_threshold, round(min_similarity - 0.001, 6)::DOUBLE AS similarity_threshold,
  coalesce(lm > max_mismatch + 0.001 AND bs < min_similarity - 0.001, false) AS separates FROM t""",
)
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    out = A.derive_thresholds(threshold_samples(spark, d), "consumer", 0.001, 0.001)
    return out.select(
        "consumer", "separates", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("consumer", "separates")]
    )


def threshold_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(read_table(spark, d, "labels"), "doc_id")
    far = (F.col("lang") == "de") & (F.col("quality") == 0)
    return joined.select(
        F.col("lang").alias("consumer"),
        (F.col("quality") == 1).alias("accepted"),
        (F.when(far, 1000.0).otherwise(0.0) + F.col("n_chars") / 100000.0).alias("mismatch"),
        (F.when(far, -5.0).otherwise(1.0) - (F.col("n_chars") % 1000) / 2000.0).alias("similarity"),
    )


@query(
    "agg9_ssim",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * 255 AS a, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT v.vec_id, v.i, v.a, n.a + CASE WHEN v.vec_id % 3 = 0 THEN 0 ELSE n.i % 5 END AS b FROM v JOIN v n ON n.vec_id = v.vec_id - v.vec_id % 3 AND n.i = v.i),
s AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, coalesce(var_samp(a), 0) AS va, coalesce(var_samp(b), 0) AS vb, coalesce(covar_samp(a, b), 0) AS cv FROM p GROUP BY vec_id)
SELECT vec_id, round(greatest(-1, least(1, ((2*ma*mb + 6.5025) * (2*cv + 58.5225)) / ((ma*ma + mb*mb + 6.5025) * (va + vb + 58.5225)))), 5)::DOUBLE AS ssim FROM s""",
)
def ssim(spark: SparkSession, d: str) -> DataFrame:
    vec = F.col("vec_id")
    cells = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    cells = cells.withColumn("v", F.col("v").cast("double") * 255)
    # Each vector against the first of its block of three.
    first = cells.filter(vec % 3 == 0).select(vec.alias("base"), "i", F.col("v").alias("b"))
    pairs = cells.withColumn("base", vec - vec % 3).join(first, ["base", "i"])
    shifted = F.col("b") + F.when(vec % 3 == 0, 0).otherwise((F.col("i") + 1) % 5)
    return A.ssim(pairs, ["vec_id"], F.col("v"), shifted).withColumn("ssim", F.round("ssim", 5))


@query(
    "agg10_masked_diff",
    f"""WITH {ATOMS}, b AS (SELECT doc_id, page, x, y, CASE WHEN doc_id % 6 = 1 AND tok_no = 3 THEN upper(text) || '*' ELSE text END AS text FROM v_atoms WHERE NOT (doc_id % 50 = 9 AND tok_no = 1)),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, a.text AS ta, b.text AS tb FROM v_atoms a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.x = b.x AND a.y = b.y),
k AS (SELECT *, x >= 10 AND x < 30 AND y >= -20 AND y < 0.5 AS i, ta IS DISTINCT FROM tb AS df FROM j)
SELECT doc_id, page, bool_and(ta IS NOT NULL AND tb IS NOT NULL) AS same_shape, CASE WHEN bool_and(ta IS NOT NULL AND tb IS NOT NULL) THEN count(*) FILTER (i AND df) ELSE count(*) FILTER (i) END AS inside_diff,
  CASE WHEN bool_and(ta IS NOT NULL AND tb IS NOT NULL) THEN count(*) FILTER (NOT i AND df) ELSE count(*) FILTER (NOT i) END AS outside_diff, count(*) FILTER (i) AS inside_cells, count(*) FILTER (NOT i) AS outside_cells
FROM k GROUP BY doc_id, page""",
)
def masked(spark: SparkSession, d: str) -> DataFrame:
    parts = views.document_parts(spark, d)
    before = views.atoms(spark, d, parts).select("doc_id", "page", "tok_no", "x", "y", "text")
    doc, tok = F.col("doc_id"), F.col("tok_no")
    after = before.filter(~((doc % 50 == 9) & (tok == 1))).withColumn(
        "text", F.when((doc % 6 == 1) & (tok == 3), F.concat(F.upper("text"), F.lit("*"))).otherwise(F.col("text"))
    )
    mask = views.page_space(spark, d, parts).select(
        "doc_id", "page", F.lit(10.0).alias("x0"), F.lit(-20.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(0.5).alias("y1")
    )
    out = A.masked_diff(before, after, ["doc_id", "page"], ["x", "y"], "text", mask)
    return out.drop("inside_raw", "outside_raw")


_CAP = """CASE WHEN style_key = 'at' THEN 'readOnly' WHEN style_key = 'upper' THEN 'replacementWithSubstitution' ELSE 'safeReplacement' END"""


@query(
    "agg11_capability_rollup",
    f"""WITH {ATOMS}, s AS (SELECT doc_id, page, line_no, mode, {_CAP} AS kind, CASE style_key WHEN 'at' THEN ['scannedContent', 'supportedExistingFont'] WHEN 'upper' THEN ['substituteFontRequired'] WHEN 'digit' THEN ['supportedExistingFont', 'malformedContent'] ELSE [] END AS reasons
  FROM v_atoms),
g AS (SELECT doc_id, page, line_no, max(CASE WHEN mode >= 4 OR kind = 'readOnly' THEN 2 WHEN kind = 'replacementWithSubstitution' THEN 1 ELSE 0 END) AS sv, list_distinct(flatten(list(reasons))) AS rs, bool_or(mode >= 4) AS clip FROM s GROUP BY ALL),
o AS (SELECT *, list_filter(['supportedExistingFont', 'substituteFontRequired', 'replacementOverflow', 'unsupportedEncoding', 'ambiguousTransform', 'sharedResource', 'outlinedText', 'scannedContent', 'fontEmbeddingProhibited', 'unsupportedOperator', 'malformedContent'],
   lambda r: (list_contains(rs, r) OR (clip AND r = 'unsupportedOperator')) AND NOT (sv = 2 AND r IN ('supportedExistingFont', 'substituteFontRequired'))) AS fin FROM g)
SELECT doc_id, page, line_no, ['safeReplacement', 'replacementWithSubstitution', 'readOnly'][sv + 1] AS kind, CASE WHEN sv = 0 AND len(fin) = 0 THEN 'supportedExistingFont' ELSE array_to_string(fin, ',') END AS reasons FROM o""",
)
def rollup(spark: SparkSession, d: str) -> DataFrame:
    style = F.col("style_key")
    empty = F.array().cast("array<string>")
    spans = (
        views.atoms(spark, d)
        .select(
            "doc_id",
            "page",
            "line_no",
            "mode",
            F.when(style == "at", "readOnly")
            .when(style == "upper", "replacementWithSubstitution")
            .otherwise("safeReplacement")
            .alias("kind"),
            F.when(style == "at", F.array(F.lit("scannedContent"), F.lit("supportedExistingFont")))
            .when(style == "upper", F.array(F.lit("substituteFontRequired")))
            .when(style == "digit", F.array(F.lit("supportedExistingFont"), F.lit("malformedContent")))
            .otherwise(empty)
            .alias("reasons"),
        )
    )
    out = A.rollup_capability(spans, ["doc_id", "page", "line_no"])
    return out.withColumn("reasons", F.array_join("reasons", ","))


# Style runs of lines with char ranges, for the two range questions.
RUNS_SQL = f"""{ATOMS}, ch AS (SELECT *, CASE WHEN lag(style_key) OVER w IS DISTINCT FROM style_key THEN 1 ELSE 0 END AS c FROM v_atoms WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS run_no FROM ch),
ru AS (SELECT doc_id, line_no, run_no, any_value(style_key) AS style_key, sum(length(text)) AS len FROM rn GROUP BY doc_id, line_no, run_no),
runs AS (SELECT *, CAST(sum(len) OVER (PARTITION BY doc_id, line_no ORDER BY run_no) AS BIGINT) AS char_end, CAST(sum(len) OVER (PARTITION BY doc_id, line_no ORDER BY run_no) - len AS BIGINT) AS char_start FROM ru),
asked AS (SELECT event_id AS req_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, CAST(user_id % 70 + 1 AS INTEGER) AS line_no, CAST(k % 60 AS BIGINT) AS s, CAST(k % 60 + CASE WHEN k % 5 = 0 THEN 0 ELSE k % 17 END AS BIGINT) AS e
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
tot AS (SELECT doc_id, line_no, max(char_end) AS n FROM runs GROUP BY ALL)"""


def runs_and_ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = S.style_runs(
        views.atoms(spark, d).select("doc_id", "line_no", "tok_no", "style_key", "text"),
        ["doc_id", "line_no"],
        "tok_no",
        ["style_key"],
        "text",
    )
    ranged = S.char_ranges(runs, ["doc_id", "line_no"], ["run_no"], "run_text")
    k = F.get_json_object("props", "$.k").cast("int")
    asked = read_table(spark, d, "events").select(
        F.col("event_id").alias("req_id"),
        (F.col("event_id") % views.document_span(spark, d)).alias("doc_id"),
        (F.col("user_id") % 70 + 1).cast("int").alias("line_no"),
        (k % 60).cast("bigint").alias("start"),
        (k % 60 + F.when(k % 5 == 0, 0).otherwise(k % 17)).cast("bigint").alias("end"),
    )
    return ranged, asked


@query(
    "agg12_format_state",
    f"""WITH {RUNS_SQL}, q AS (SELECT req_id, doc_id, line_no, n, greatest(0, least(s, n)) AS lo, greatest(greatest(0, least(s, n)), least(e, n)) AS hi FROM asked JOIN tot USING (doc_id, line_no)),
h AS (SELECT q.req_id, q.doc_id, q.line_no, style_key FROM q JOIN runs r ON q.doc_id = r.doc_id AND q.line_no = r.line_no AND (lo = hi OR (char_start < hi AND char_end > lo))),
c AS (SELECT req_id, doc_id, line_no, count(*) AS n, count(*) FILTER (style_key = 'upper') AS b, count(*) FILTER (style_key = 'digit') AS i, count(*) FILTER (style_key = 'at') AS u, count(*) FILTER (style_key <> 'other') AS k FROM h GROUP BY ALL)
SELECT req_id, doc_id, line_no, {", ".join(f"CASE WHEN {c} = 0 THEN 'off' WHEN {c} = n THEN 'on' ELSE 'mixed' END AS {o}" for c, o in (("b", "bold"), ("i", "italic"), ("u", "underline"), ("k", "strike")))} FROM c""",
)
def format_state(spark: SparkSession, d: str) -> DataFrame:
    runs, asked = runs_and_ranges(spark, d)
    style = F.col("style_key")
    styled = runs.withColumns(
        {
            "weight": F.when(style == "upper", 700),
            "angle": F.when(style == "digit", -12.0),
            "underline": style == "at",
            "strike": style != "other",
        }
    )
    return A.format_state(styled, asked, ["doc_id", "line_no"])


@query(
    "agg13_uniform_requirement",
    f"""WITH {RUNS_SQL}, q AS (SELECT req_id, a.doc_id, a.line_no, CASE WHEN s = e THEN 0 ELSE greatest(0, least(s, coalesce(n, 0))) END AS lo, CASE WHEN s = e THEN coalesce(n, 0) ELSE greatest(greatest(0, least(s, coalesce(n, 0))), least(e, coalesce(n, 0))) END AS hi FROM asked a LEFT JOIN tot USING (doc_id, line_no)),
h AS (SELECT q.req_id, q.doc_id, q.line_no, CASE WHEN style_key IS NULL THEN NULL WHEN style_key IN ('upper', 'at') THEN 'sans' ELSE 'serif' END AS nk, CASE style_key WHEN 'at' THEN 700 ELSE 400 END AS wt, char_start FROM q LEFT JOIN runs r ON q.doc_id = r.doc_id AND q.line_no = r.line_no AND char_start < hi AND char_end > lo)
SELECT req_id, doc_id, line_no, CASE WHEN count(nk) = 0 THEN 'empty' WHEN count(DISTINCT nk || wt) = 1 THEN 'ready' ELSE 'mixed' END AS kind, CASE WHEN count(DISTINCT nk || wt) = 1 THEN min(nk) END AS name_key FROM h GROUP BY ALL""",
)
def uniform_requirement(spark: SparkSession, d: str) -> DataFrame:
    runs, asked = runs_and_ranges(spark, d)
    style = F.col("style_key")
    name = F.when(style.isin("upper", "at"), "sans").otherwise("serif")
    styled = runs.withColumns(
        {
            "name_key": name,
            "family": name,
            "weight": F.when(style == "at", 700).otherwise(400),
            "italic": F.lit(False),
        }
    )
    return A.uniform_requirement(styled, asked, ["doc_id", "line_no"])


@query(
    "agg14_page_text",
    """SELECT conv_id, sha256(string_agg(role || ': ' || text, '|' ORDER BY turn)) AS digest, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""",
)
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    conv = read_table(spark, d, "conversations").withColumn("_t", F.concat_ws(": ", "role", "text"))
    whole = A.page_text(conv, ["conv_id"], "turn", "_t", "|")
    sizes = conv.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    return whole.select("conv_id", F.sha2("page_text", 256).alias("digest")).join(sizes, "conv_id")


@query(
    "agg14_distinct_sizes",
    f"""WITH {ATOMS} SELECT doc_id, page, string_agg(CAST(CAST(w AS BIGINT) AS VARCHAR), ',' ORDER BY w) AS sizes FROM (SELECT DISTINCT doc_id, page, w FROM v_atoms WHERE mode < 4) GROUP BY doc_id, page""",
)
def sizes(spark: SparkSession, d: str) -> DataFrame:
    found = A.distinct_sizes(views.atoms(spark, d).filter("mode < 4"), ["doc_id", "page"], F.col("w").cast("bigint"))
    return found.withColumn("sizes", F.array_join("sizes", ","))


_CASES_SQL = """cs AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'crossConsumerControl' WHEN 1 THEN 'rejected' ELSE 'capability' END AS ek,
   CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'RESOURCE_LIMIT' WHEN 2 THEN 'readOnly' ELSE 'safeReplacement' END AS ec, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)),
co AS (SELECT *, CASE WHEN toxic = 1 AND id % 4 = 1 THEN 'capability' ELSE ek END AS ok, CASE WHEN toxic = 1 AND id % 4 = 3 THEN 'readOnly' ELSE ec END AS oc,
   ek = 'capability' AND ec <> 'readOnly' AS editable, (ek = 'capability' AND ec <> 'readOnly') OR ek = 'crossConsumerControl' AS looked FROM cs)"""


_REASONS_SQL = f"""WITH {_CASES_SQL}, r AS (
SELECT 'unexpected-outcome:' || id AS reason FROM co WHERE NOT coalesce(ek = ok AND CASE WHEN ek = 'crossConsumerControl' THEN true ELSE ec = oc END, false)
UNION ALL SELECT 'non-atomic-failure:' || id FROM co WHERE n_chars % 97 = 0
UNION ALL SELECT 'missing-independent-validation' FROM co WHERE looked AND n_chars % 50 = 0
UNION ALL SELECT 'missing-true-removal' FROM co WHERE editable AND n_chars % 31 = 0
UNION ALL SELECT 'missing-extractable-redraw' FROM co WHERE editable AND n_chars % 37 = 0
UNION ALL SELECT 'unedited-region-fidelity-failed' FROM co WHERE looked AND n_chars % 41 = 0
UNION ALL SELECT 'determinism-failed' FROM co WHERE looked AND n_chars % 43 = 0
UNION ALL SELECT 'failure-not-closed:' || id FROM co WHERE NOT looked AND n_chars % 53 = 0
UNION ALL SELECT 'case-failed:' || id FROM co WHERE quality = 0
UNION ALL SELECT 'missing-case:' || doc_id FROM documents WHERE doc_id % 10 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'visual-threshold-not-separated:' || lang FROM (SELECT lang, max(n_chars) FILTER (quality = 1) AS a, min(n_chars) FILTER (quality = 0) AS b FROM documents JOIN labels USING (doc_id) GROUP BY lang) WHERE NOT coalesce(b > a, false)
UNION ALL SELECT 'missing-resource-sweep:image_pixels')"""


@query("agg15_gate_reasons", _REASONS_SQL + " SELECT reason, count(*) AS hits FROM r GROUP BY reason")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return gate(spark, d)


@query(
    "agg15_gate_decision",
    _REASONS_SQL
    + " SELECT CASE WHEN count(*) = 0 THEN 'GO' ELSE 'NO_GO' END AS decision, count(DISTINCT reason) AS reasons FROM r",
)
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    return E.gate_decision(gate(spark, d))


def gate(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    case, n = F.col("doc_id") % 4, F.col("n_chars")
    kind = F.when(case == 0, "crossConsumerControl").when(case == 1, "rejected").otherwise("capability")
    code = F.when(case == 1, "RESOURCE_LIMIT").when(case == 2, "readOnly").when(case == 3, "safeReplacement")
    toxic = F.col("toxic") == 1
    cases = docs.join(read_table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        kind.alias("expected_kind"),
        code.alias("expected_code"),
        F.lit(None).cast("string").alias("expected_reason"),
        F.when(toxic & (case == 1), "capability").otherwise(kind).alias("observed_kind"),
        F.when(toxic & (case == 3), "readOnly").otherwise(code).alias("observed_code"),
        F.array().cast("array<string>").alias("observed_reasons"),
        (n % 97 != 0).alias("atomic_failure"),
        (n % 50 != 0).alias("consumer_a"),
        F.lit(True).alias("consumer_b"),
        (n % 31 != 0).alias("true_removal"),
        (n % 37 != 0).alias("extractable_redraw"),
        (n % 41 != 0).alias("region_fidelity"),
        F.lit(True).alias("independent_rendering"),
        (n % 43 != 0).alias("deterministic"),
        (n % 53 != 0).alias("failure_closed"),
        F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"),
    )
    required = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("id"))
    names = [*DOC_LIMITS, "image_pixels"]
    limits = docs.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("limit"))
    swept = docs.select(F.explode(F.array(*[F.lit(n) for n in DOC_LIMITS])).alias("limit"))
    separation = (
        docs.join(read_table(spark, d, "labels"), "doc_id")
        .groupBy(F.col("lang").alias("consumer"))
        .agg(
            F.coalesce(
                F.min(F.when(F.col("quality") == 0, n)) > F.max(F.when(F.col("quality") == 1, n)), F.lit(False)
            ).alias("separates")
        )
    )
    return E.evaluate_gate(cases, required, separation, swept, limits)


@query(
    "agg16_sweep_summary",
    f"""WITH {METRICS_SQL}, u AS (SELECT doc_id, unnest(['file_bytes', 'objects', 'nesting_depth', 'stream_bytes', 'operations']) AS "limit",
   unnest([20000, 40, 12, 2500, 1500]) AS bound, unnest([file_bytes, objects, nesting_depth, stream_bytes, operations]) AS value FROM m),
a AS (SELECT *, CASE WHEN doc_id % 100 = 99 THEN NOT value <= bound ELSE value <= bound END AS accepted, doc_id % 3 AS run FROM u)
SELECT "limit", CAST(max(value) FILTER (accepted) AS BIGINT) AS largest_passing, CAST(min(value) FILTER (NOT accepted) AS BIGINT) AS smallest_rejected, count(DISTINCT run) AS repeats, count(*) FILTER (accepted <> (value <= bound)) AS contradictions FROM a GROUP BY "limit" """,
)
def sweeps(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("limit"), F.lit(b).cast("bigint").alias("bound"), F.col(n).alias("value"))
            for n, b in DOC_LIMITS.items()
        ]
    )
    measured = doc_metrics(spark, d).select("doc_id", F.inline(rows))
    within = F.col("value") <= F.col("bound")
    return E.sweep_summary(
        measured.select(
            "limit",
            "bound",
            "value",
            (F.col("doc_id") % 3).alias("run"),
            F.when(F.col("doc_id") % 100 == 99, ~within).otherwise(within).alias("accepted"),
        )
    )


@query(
    "agg17_agreement",
    """WITH e AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'other' ELSE regexp_extract(html, '<h1>([^<]*)', 1) END AS x, regexp_extract(html, '<title>([^<]*)', 1) AS a, CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_extract(html, '<h1>([^<]*)', 1) END AS b FROM pages)
SELECT page_id, a = x AS consumer_a, coalesce(b = x, false) AS consumer_b, a = x AND coalesce(b = x, false) AS agreed FROM e""",
)
def agreement(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select("page_id", "html")
    by_regex = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("observed"))
    items = extract(pages, "page_id", "html").filter("kind = 'h1' and page_id % 4 <> 0")
    by_items = items.groupBy("page_id").agg(F.min_by("text", "ordinal").alias("observed"))
    wanted = pages.select(
        "page_id",
        F.when(F.col("page_id") % 9 == 0, "other").otherwise(F.regexp_extract("html", "<h1>([^<]*)", 1)).alias("expected"),
    )
    return E.agreement(by_regex, by_items, wanted, "page_id")

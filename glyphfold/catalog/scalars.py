"""Scalar queries (SCL1-SCL20, UDF3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.sqlviews import ATOMS, EDITS, LINES, PAGES
from glyphfold.functions import geometry as G
from glyphfold.functions import keys as K
from glyphfold.functions import text as T
from glyphfold.operators import sequences as S
from glyphfold.plans import views
from glyphfold.sources.corpus import read_table

STYLES = ["Bold", "Light Italic", "Black", "Demi-Bold Oblique", "Regular", "Thin", "Extra Light", "Medium_Italic", "", "Ultra Bold", "Heavy", "Semi Bold"]
SUFFIX = "|".join(T.STYLE_SUFFIXES)
STYLE_SQL = "[" + ", ".join(f"'{s}'" for s in STYLES) + "][p_partkey % 12 + 1]"
# The fixed white-space class in RE2 spelling.
SPACE = T.SPACE_CLASS


def style_word() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.col("p_partkey") % 12 + 1).cast("int"))


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@query(
    "scl1_name_key",
    """SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '^[A-Z]{6}\\+', '', 'i'), '[\\s_-]+', '', 'g')) AS name_key,
  lower(regexp_replace(regexp_replace('aBcDeF+' || p_brand || '_' || p_name, '^[A-Z]{6}\\+', '', 'i'), '[\\s_-]+', '', 'g')) AS prefixed_key
FROM part""",
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(
        "p_partkey",
        T.name_key(F.col("p_name")).alias("name_key"),
        T.name_key(F.concat(F.lit("aBcDeF+"), "p_brand", F.lit("_"), "p_name")).alias("prefixed_key"),
    )


@query(
    "scl2_family_key",
    f"""SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || '-' || {STYLE_SQL}, '[\\s_-]+', '', 'g')),
  '^(.+?)(?:{SUFFIX})$', '\\1') AS family_key,
  regexp_replace(lower(regexp_replace({STYLE_SQL}, '[\\s_-]+', '', 'g')), '^(.+?)(?:{SUFFIX})$', '\\1') AS style_only
FROM part""",
)
def family_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(
        "p_partkey",
        T.family_key(F.concat("p_name", F.lit("-"), style_word())).alias("family_key"),
        T.family_key(style_word()).alias("style_only"),
    )


@query(
    "scl3_parse_style",
    f"""SELECT p_partkey, CASE WHEN regexp_matches(c, 'black|heavy') THEN 900 WHEN regexp_matches(c, 'extrabold|ultrabold') THEN 800
  WHEN regexp_matches(c, 'semibold|demibold') THEN 600 WHEN contains(c, 'bold') THEN 700 WHEN contains(c, 'medium') THEN 500
  WHEN regexp_matches(c, 'extralight|ultralight') THEN 200 WHEN contains(c, 'light') THEN 300 WHEN contains(c, 'thin') THEN 100
  ELSE 400 END AS weight, regexp_matches(c, 'italic|oblique') AS italic
FROM (SELECT p_partkey, lower(regexp_replace(p_type || ' ' || {STYLE_SQL}, '[\\s_-]+', '', 'g')) AS c FROM part)""",
)
def styles(spark: SparkSession, d: str) -> DataFrame:
    parsed = T.parse_style(F.concat("p_type", F.lit(" "), style_word()))
    return read_table(spark, d, "part").select("p_partkey", parsed.alias("s")).select("p_partkey", "s.weight", "s.italic")


@query(
    "scl4_weight_slant",
    f"""WITH n AS (SELECT p_partkey, lower(regexp_replace(nm, '^[A-Z]{{6}}\\+', '')) AS low,
    CASE WHEN p_partkey % 5 = 0 THEN p_size * 30 END AS dw, CASE WHEN p_partkey % 7 = 0 THEN -1.0 * p_size END AS da
  FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'ABCDEF+Unknown' WHEN p_partkey % 10 = 1 THEN 'Unknown'
      ELSE 'GHIJKL+' || p_name || '-' || {STYLE_SQL} END AS nm FROM part))
SELECT p_partkey, CAST(CASE WHEN dw > 0 AND dw <= 1000 THEN dw WHEN low = 'unknown' THEN NULL
    WHEN contains(low, 'black') OR contains(low, 'heavy') THEN 900 WHEN contains(low, 'bold') OR contains(low, 'demi') THEN 700
    WHEN contains(low, 'light') THEN 300 ELSE 400 END AS DOUBLE) AS weight,
  CAST(CASE WHEN da IS NOT NULL THEN da WHEN low = 'unknown' THEN NULL
    WHEN contains(low, 'italic') OR contains(low, 'oblique') THEN -12 ELSE 0 END AS DOUBLE) AS angle FROM n""",
)
def weight_slant(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = (
        F.when(k % 10 == 0, "ABCDEF+Unknown")
        .when(k % 10 == 1, "Unknown")
        .otherwise(F.concat(F.lit("GHIJKL+"), "p_name", F.lit("-"), style_word()))
    )
    return read_table(spark, d, "part").select(
        k,
        T.infer_weight(name, F.when(k % 5 == 0, F.col("p_size") * 30)).alias("weight"),
        T.infer_italic_angle(name, F.when(k % 7 == 0, -1.0 * F.col("p_size"))).alias("angle"),
    )


@query(
    "scl5_sanitised_names",
    """WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
n AS (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(
    CASE page_id % 4 WHEN 0 THEN 'ABCDEF+' || title WHEN 1 THEN chr(9) || title || chr(8203) WHEN 2 THEN '  ' || chr(27) ELSE title || ' ' END),
    '^[A-Z]{6}\\+', ''), '[\\x00-\\x1F\\x7F-\\x{9F}\\p{Cf}]', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 96) AS clean FROM t)
SELECT page_id, coalesce(nullif(clean, ''), 'Unnamed ' || page_id) AS name FROM n""",
)
def sanitised(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    case = F.col("page_id") % 4
    raw = (
        F.when(case == 0, F.concat(F.lit("ABCDEF+"), title))
        .when(case == 1, F.concat(F.lit("\t"), title, F.lit("\u200b")))
        .when(case == 2, F.lit("  \x1b"))
        .otherwise(F.concat(title, F.lit(" ")))
    )
    formed = read_table(spark, d, "pages").select("page_id", T.nfkc(raw).alias("n"))
    return formed.select(
        "page_id", T.first_usable(F.col("n"), fallback=F.concat(F.lit("Unnamed "), "page_id")).alias("name")
    )


@query(
    "scl6_searchable_text",
    f"""SELECT doc_id, sha256(s) AS digest, CAST(length(s) AS INTEGER) AS chars FROM (
  SELECT doc_id, regexp_replace(nfc_normalize(replace(text, 'é', 'e' || chr(769)) || chr(160)), '{SPACE}+', '', 'g') AS s FROM documents)""",
)
def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    spread = F.concat(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("\u00a0"))
    clean = docs.select("doc_id", T.searchable(spread).alias("s"))
    return clean.select("doc_id", F.sha2("s", 256).alias("digest"), F.length("s").alias("chars"))


@query(
    "scl7_occurrences",
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the,
  CAST((length(text) - length(replace(text, 'enen', ''))) // 4 AS BIGINT) AS n_enen,
  CAST((length(text) - length(replace(text, lang, ''))) // length(lang) AS BIGINT) AS n_lang, CAST(0 AS BIGINT) AS n_empty
FROM documents""",
)
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "documents").select(
        "doc_id",
        T.count_occurrences(t, F.lit("the")).alias("n_the"),
        T.count_occurrences(t, F.lit("enen")).alias("n_enen"),
        T.count_occurrences(t, F.col("lang")).alias("n_lang"),
        T.count_occurrences(t, F.lit("")).alias("n_empty"),
    )


@query(
    "scl8_box_transform",
    f"""WITH {ATOMS}, c AS (SELECT doc_id, page, 1.5*px - 0.25*py + doc_id % 7 AS tx, 0.5*px + 2.0*py + 3.0 AS ty, tok_no, line_no
  FROM (SELECT *, unnest([x, x, x + w, x + w]) AS px, unnest([y, y + h, y, y + h]) AS py FROM v_atoms)),
b AS (SELECT doc_id, page, line_no, tok_no, min(tx) AS x, min(ty) AS y, max(tx) - min(tx) AS w, max(ty) - min(ty) AS h
  FROM c GROUP BY ALL)
SELECT doc_id, page, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, round(sum(w), 3) AS sw, round(max(h), 3) AS mh
FROM b GROUP BY doc_id, page""",
)
def box_transform(spark: SparkSession, d: str) -> DataFrame:
    m = G.matrix(1.5, 0.5, -0.25, 2.0, F.col("doc_id") % 7, 3.0)
    box = G.transform_box(m, *[F.col(c) for c in ("x", "y", "w", "h")])
    moved = views.atoms(spark, d).select("doc_id", "page", box.alias("b"))
    return moved.groupBy("doc_id", "page").agg(
        F.round(F.sum("b.x"), 3).alias("sx"),
        F.round(F.sum("b.y"), 3).alias("sy"),
        F.round(F.sum("b.w"), 3).alias("sw"),
        F.round(F.max("b.h"), 3).alias("mh"),
    )


@query(
    "scl8_matrix_algebra",
    """WITH m AS (SELECT p_partkey, p_size::DOUBLE AS a, 2.0::DOUBLE AS b, CASE WHEN p_partkey % 13 = 0 THEN p_size * 2.0 ELSE 1.0 END::DOUBLE AS c,
   CASE WHEN p_partkey % 13 = 0 THEN 4.0 ELSE p_size + 5.0 END::DOUBLE AS d, p_retailprice AS e, -7.0::DOUBLE AS f FROM part),
n AS (SELECT *, a*d - b*c AS det FROM m)
SELECT p_partkey, det = 0 AS singular,
  round(a*a + c*b, 6) AS sq_a, round(b*a + d*b, 6) AS sq_b, round(a*e + c*f + e, 6) AS sq_e,
  CASE WHEN det <> 0 THEN round(d / det, 6) END AS inv_a, CASE WHEN det <> 0 THEN round((c*f - d*e) / det, 6) END AS inv_e FROM n""",
)
def matrix_algebra(spark: SparkSession, d: str) -> DataFrame:
    singular = F.col("p_partkey") % 13 == 0
    size = F.col("p_size").cast("double")
    m = G.matrix(
        size,
        2.0,
        F.when(singular, size * 2.0).otherwise(1.0),
        F.when(singular, 4.0).otherwise(size + 5.0),
        F.col("p_retailprice"),
        -7.0,
    )
    rows = read_table(spark, d, "part").select("p_partkey", m.alias("m"))
    rows = rows.select("p_partkey", G.mat_mul(F.col("m"), F.col("m")).alias("sq"), G.mat_inv(F.col("m")).alias("inv"))
    return rows.select(
        "p_partkey",
        F.col("inv").isNull().alias("singular"),
        *[F.round(f"sq.{c}", 6).alias(f"sq_{c}") for c in "abe"],
        *[F.round(f"inv.{c}", 6).alias(f"inv_{c}") for c in "ae"],
    )


_VIS = """vis AS (SELECT *, CASE WHEN cx0 IS NOT NULL THEN greatest(x0, cx0) ELSE x0 END AS vx0,
    CASE WHEN cx0 IS NOT NULL THEN greatest(y0, cy0) ELSE y0 END AS vy0,
    CASE WHEN cx0 IS NOT NULL THEN least(x1, cx1) ELSE x1 END AS vx1,
    CASE WHEN cx0 IS NOT NULL THEN least(y1, cy1) ELSE y1 END AS vy1 FROM v_page_space)"""


@query(
    "scl9_canonical_space",
    f"""WITH {ATOMS}, {PAGES}, {_VIS},
p AS (SELECT a.doc_id, a.page, a.line_no, a.tok_no, user_unit AS u, v.* EXCLUDE (doc_id, page, x0, y0, x1, y1, cx0, cy0, cx1, cy1, user_unit),
    unnest([x, x, x + w, x + w]) AS px, unnest([y, y + h, y, y + h]) AS py FROM v_atoms a JOIN vis v USING (doc_id, page)),
q AS (SELECT *, CASE WHEN u <= 0 THEN NULL WHEN rotate = 0 THEN u*(px - vx0) WHEN rotate = 90 THEN u*(py - vy0) WHEN rotate = 180 THEN u*(vx1 - px) ELSE u*(vy1 - py) END AS tx,
    CASE WHEN u <= 0 THEN NULL WHEN rotate = 0 THEN u*(py - vy0) WHEN rotate = 90 THEN u*(vx1 - px) WHEN rotate = 180 THEN u*(vy1 - py) ELSE u*(px - vx0) END AS ty FROM p),
b AS (SELECT doc_id, page, line_no, tok_no, any_value(u) AS u, min(tx) AS x, min(ty) AS y, max(tx) - min(tx) AS w, max(ty) - min(ty) AS h,
    any_value(CASE WHEN u <= 0 THEN NULL WHEN rotate IN (90, 270) THEN (vy1 - vy0)*u ELSE (vx1 - vx0)*u END) AS pw,
    any_value(CASE WHEN u <= 0 THEN NULL WHEN rotate IN (90, 270) THEN (vx1 - vx0)*u ELSE (vy1 - vy0)*u END) AS ph
  FROM q GROUP BY doc_id, page, line_no, tok_no)
SELECT doc_id, page, CASE WHEN any_value(u) <= 0 THEN 'user-unit' END AS reason, max(pw) AS page_width, max(ph) AS page_height,
  round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, round(sum(w), 3) AS sw, round(sum(h), 3) AS sh,
  round(sum(x * 1.5), 3) AS view_x, round(sum((ph - y) * 1.5), 3) AS view_y FROM b GROUP BY doc_id, page""",
)
def canonical_space(spark: SparkSession, d: str) -> DataFrame:
    placed = G.to_canonical(views.atoms(spark, d), views.page_space(spark, d))
    vx, vy = G.to_viewport(F.col("x"), F.col("y"), F.col("page_height"), 1.5)
    return placed.groupBy("doc_id", "page").agg(
        F.max("reason").alias("reason"),
        F.max("page_width").alias("page_width"),
        F.max("page_height").alias("page_height"),
        *[F.round(F.sum(c), 3).alias(f"s{c}") for c in ("x", "y", "w", "h")],
        F.round(F.sum(vx), 3).alias("view_x"),
        F.round(F.sum(vy), 3).alias("view_y"),
    )


@query(
    "scl10_address_keys",
    f"""WITH {LINES}, n AS (SELECT *, substr(text, 1, 12) AS nm FROM v_lines),
k AS (SELECT *, doc_id || ':' || page AS ref, 'pageContents:' || doc_id || ':0:-/formXObject:' || line_no || ':1:' ||
  replace(replace(replace(replace(replace(url_encode(nm), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS path FROM n)
SELECT doc_id, line_no, ref || '|' || path || '|' || line_no || ':' || (line_no + 1) || '|0:' || length(text) AS span_key,
  ref || '|' || path || '|' || line_no || ':' || (line_no + 1) || '|3:4' AS glyph_key,
  ref || '|' || path || '|' || line_no || ':' || (line_no + 2) AS graphic_key FROM k""",
)
def address_keys(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line_no")

    def ref(obj: Column, gen: Column) -> Column:
        return F.struct(obj.cast("bigint").alias("obj"), gen.cast("int").alias("gen"))

    def segment(kind: str, r: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), r.alias("ref"), name.alias("name"))

    page = ref(F.col("doc_id"), F.col("page"))
    path = F.array(
        segment("pageContents", ref(F.col("doc_id"), F.lit(0)), F.lit(None).cast("string")),
        segment("formXObject", ref(line, F.lit(1)), F.substring("text", 1, 12)),
    )
    return views.lines(spark, d).select(
        "doc_id",
        "line_no",
        K.span_key(page, path, line, line + 1, F.lit(0), F.length("text")).alias("span_key"),
        K.glyph_key(page, path, line, line + 1, F.lit(3)).alias("glyph_key"),
        K.graphic_key(page, path, line, line + 2).alias("graphic_key"),
    )


@query(
    "scl11_command_hash",
    f"""WITH {LINES}, {EDITS} SELECT doc_id, sha256('{{"schema":1,"revision":' || doc_id % 4 || ',"page":' || page || ',"address":' ||
  to_json(doc_id || '|' || line_no) || ',"replacement":' || to_json(replacement) || ',"source":"' || sha256(source_text) ||
  '","font":' || to_json(left(source_text, 8)) || ',"consents":' || CASE WHEN accept_substitution THEN '["layout","substitution"]' ELSE '[]' END || '}}') AS command_hash
FROM v_edits""",
)
def command_hashes(spark: SparkSession, d: str) -> DataFrame:
    consents = F.when(F.col("accept_substitution"), F.array(F.lit("substitution"), F.lit("layout"))).otherwise(
        F.array().cast("array<string>")
    )
    return views.edits(spark, d).select(
        "doc_id",
        K.command_hash(
            F.col("doc_id") % 4,
            F.col("page"),
            F.concat_ws("|", "doc_id", "line_no"),
            F.col("replacement"),
            F.sha2("source_text", 256),
            F.substring("source_text", 1, 8),
            consents,
        ).alias("command_hash"),
    )


@query(
    "scl12_rights",
    """WITH f AS (SELECT p_partkey, (p_size * 37) % 1024 AS v FROM part),
b AS (SELECT *, (v & 2) <> 0 AS r, (v & 4) <> 0 AS p, (v & 8) <> 0 AS e, (v & 512) <> 0 AS bm FROM f),
u AS (SELECT *, CASE WHEN r::INT + p::INT + e::INT > 1 THEN 'invalid' WHEN r THEN 'restricted' WHEN p THEN 'preview-print' WHEN e THEN 'editable' ELSE 'installable' END AS usage FROM b)
SELECT p_partkey, usage, NOT bm AND usage IN ('installable', 'editable') AS editing_allowed, (v & 256) = 0 AS subsetting_allowed, bm AS bitmap_only FROM u""",
)
def rights(spark: SparkSession, d: str) -> DataFrame:
    flags = (F.col("p_size") * 37) % 1024
    return read_table(spark, d, "part").select("p_partkey", G.decode_rights(flags).alias("r")).select("p_partkey", "r.*")


@query(
    "scl13_decoration_metrics",
    """WITH v AS (SELECT p_partkey, 1000.0 AS upem, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size * 10.0 - 450 END AS up,
  CASE WHEN p_partkey % 7 = 0 THEN 'nan'::DOUBLE ELSE p_size * 4.0 - 20 END AS ut, p_retailprice - 700 AS sp, p_size * 1.0 AS st FROM part)
SELECT p_partkey,
 round(CASE WHEN up < 0 THEN greatest(-0.35, least(-0.05, up / upem)) ELSE -0.1 END, 6)::DOUBLE AS underline_pos,
 round(CASE WHEN NOT isnan(ut) AND ut > 0 THEN greatest(0.025, least(0.12, ut / upem)) ELSE 0.05 END, 6)::DOUBLE AS underline_thick,
 round(CASE WHEN sp > 0 THEN greatest(0.2, least(0.6, sp / upem)) ELSE 0.3 END, 6)::DOUBLE AS strike_pos,
 round(CASE WHEN st > 0 THEN greatest(0.025, least(0.12, st / upem)) ELSE 0.05 END, 6)::DOUBLE AS strike_thick FROM v""",
)
def decoration_metrics(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    m = G.decoration_metrics(
        F.lit(1000.0),
        F.when(k % 6 != 0, size * 10 - 450),
        F.when(k % 7 == 0, float("nan")).otherwise(size * 4 - 20),
        F.col("p_retailprice") - 700,
        size,
    )
    names = ("underline_pos", "underline_thick", "strike_pos", "strike_thick")
    return read_table(spark, d, "part").select("p_partkey", m.alias("m")).select(
        "p_partkey", *[F.round(f"m.{n}", 6).alias(n) for n in names]
    )


@query(
    "scl14_direction",
    """WITH s AS (SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN 'שלום' WHEN 1 THEN 'سلام' WHEN 2 THEN '֯' ELSE '' END AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[\\p{Arabic}\\p{Hebrew}]') THEN 'rtl' ELSE 'ltr' END AS direction,
  regexp_matches(t, '[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFD}\\x{FE70}-\\x{FEFC}]') AS has_rtl FROM s""",
)
def directions(spark: SparkSession, d: str) -> DataFrame:
    case = F.col("doc_id") % 10
    seeded = F.concat("text", F.when(case == 0, "שלום").when(case == 1, "سلام").when(case == 2, "֯").otherwise(""))
    return read_table(spark, d, "documents").select(
        "doc_id", T.direction(seeded).alias("direction"), T.contains_rtl(seeded).alias("has_rtl")
    )


@query(
    "scl15_code_points",
    """WITH c AS (SELECT doc_id, unicode(ch) AS cp, min(i) AS first FROM (
  SELECT doc_id, unnest(string_split(text || '😀', '')) AS ch, generate_subscripts(string_split(text || '😀', ''), 1) AS i FROM documents) GROUP BY ALL)
SELECT doc_id, string_agg(CAST(cp AS VARCHAR), ' ' ORDER BY first) AS code_points, CAST(count(*) AS INTEGER) AS n FROM c GROUP BY doc_id""",
)
def code_point_sets(spark: SparkSession, d: str) -> DataFrame:
    points = read_table(spark, d, "documents").select(
        "doc_id", T.code_points(F.concat("text", F.lit("😀"))).alias("p")
    )
    return points.select("doc_id", F.array_join("p", " ").alias("code_points"), F.size("p").alias("n"))


@query(
    "scl16_graphemes",
    f"""WITH {LINES}, t AS (SELECT doc_id, line_no, replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) AS t FROM v_lines)
SELECT doc_id, line_no, CAST(length_grapheme(t) AS BIGINT) AS clusters, CAST(length(t) AS BIGINT) AS chars,
  CAST(length(t) - length_grapheme(t) AS BIGINT) AS marks FROM t WHERE t <> ''""",
)
def grapheme_rows(spark: SparkSession, d: str) -> DataFrame:
    split = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    lines = views.lines_of(views.dealt(spark, d))
    clusters = S.graphemes(lines.select("doc_id", "line_no", split.alias("t")), ["doc_id", "line_no"], "t")
    return clusters.groupBy("doc_id", "line_no").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.max("end").alias("chars"),
        F.sum(F.col("end") - F.col("start") - 1).alias("marks"),
    )


@query(
    "scl17_colours",
    """WITH c AS (SELECT p_partkey, p_size % 2 AS s1, p_partkey % 2 AS s2, [p_size / 50.0, 0.5, p_retailprice % 10 / 10.0]::DOUBLE[] AS a,
   CASE WHEN p_partkey % 5 = 0 THEN [p_size / 50.0] ELSE [p_size / 50.0 + (p_partkey % 7) * 0.004, 0.5, (p_retailprice % 10) / 10.0 - 0.01] END::DOUBLE[] AS b FROM part)
SELECT p_partkey, s1 = s2 AND len(a) = len(b) AND coalesce(abs(a[1] - b[1]) <= 0.02 + 2.220446049250313e-16 AND abs(a[2] - b[2]) <= 0.02
  AND abs(a[3] - b[3]) <= 0.02, false) AS compatible FROM c""",
)
def colours(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") / 50.0
    price = F.col("p_retailprice") % 10 / 10.0
    a = F.array(size, F.lit(0.5), price)
    b = F.when(k % 5 == 0, F.array(size)).otherwise(F.array(size + (k % 7) * 0.004, F.lit(0.5), price - 0.01))
    same = G.colour_compatible((F.col("p_size") % 2).cast("int"), a, (k % 2).cast("int"), b)
    return read_table(spark, d, "part").select(k, same.alias("compatible"))


@query(
    "scl18_identifiers",
    """WITH x AS (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<r std:part="1" std:conformance=''b''/>' WHEN 1 THEN '<Std:Part> 2 </Std:Part><std:conformance>u</std:conformance>'
  WHEN 2 THEN '<r STD:part=''3''/>' WHEN 3 THEN '<r std:conformance="a"/>' ELSE '' END AS xml FROM pages),
m AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(xml, '(?i)std:part="([^"]+)"', 1)), ''), nullif(trim(regexp_extract(xml, '(?i)std:part=''([^'']+)''', 1)), ''),
    nullif(trim(regexp_extract(xml, '(?i)<std:part>\\s*([^<]+)\\s*</std:part>', 1)), '')) AS part,
  coalesce(nullif(trim(regexp_extract(xml, '(?i)std:conformance="([^"]+)"', 1)), ''), nullif(trim(regexp_extract(xml, '(?i)std:conformance=''([^'']+)''', 1)), ''),
    nullif(trim(regexp_extract(xml, '(?i)<std:conformance>\\s*([^<]+)\\s*</std:conformance>', 1)), '')) AS level FROM x)
SELECT page_id, CASE WHEN part IS NOT NULL THEN 'STD/A-' || part || coalesce(upper(level), '') END AS identifier FROM m""",
)
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    forms = [
        "<r std:part=\"1\" std:conformance='b'/>",
        "<Std:Part> 2 </Std:Part><std:conformance>u</std:conformance>",
        "<r STD:part='3'/>",
        '<r std:conformance="a"/>',
        "",
    ]
    xml = F.concat("html", pick(forms, F.col("page_id") % 5))
    return read_table(spark, d, "pages").select("page_id", T.extract_identifier(xml, "std", "STD/A").alias("identifier"))


@query(
    "scl19_painted",
    f"""WITH {ATOMS} SELECT doc_id, page, count(*) AS atoms,
  CAST(coalesce(sum(CASE WHEN line_no % 7 <> 0 AND tok_no % 11 <> 0 AND ((mode IN (0,2,4,6) AND (tok_no % 3) > 0) OR (mode IN (1,2,5,6) AND (line_no % 2) > 0)) THEN 1 END), 0) AS BIGINT) AS painted,
  CAST(coalesce(sum(CASE WHEN w > 0 AND h > 0 AND x < 60 AND x + w > 0 AND y < 1 AND y + h > 0 - 20 + 20 THEN 1 END), 0) AS BIGINT) AS on_page
FROM v_atoms GROUP BY doc_id, page""",
)
def painted(spark: SparkSession, d: str) -> DataFrame:
    ink = G.is_painted(
        F.col("mode"), (F.col("tok_no") % 3).cast("double"), (F.col("line_no") % 2).cast("double"), F.col("line_no") % 7 == 0, F.col("tok_no") % 11 == 0
    )
    there = G.on_page(*[F.col(c) for c in ("x", "y", "w", "h")], F.lit(60.0), F.lit(1.0))
    return views.atoms(spark, d).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("atoms"), F.count_if(ink).alias("painted"), F.count_if(there).alias("on_page")
    )


@query(
    "scl20_advance",
    f"""WITH {ATOMS} SELECT doc_id, page, line_no, round(CASE WHEN s > 0 THEN s ELSE 0 END, 4)::DOUBLE AS run_advance FROM (
  SELECT doc_id, page, line_no, sum((w * 480 / 1000 * (8 + doc_id % 5) + 0.1 + CASE WHEN style_key = 'other' THEN 0.25 ELSE 0 END) * (CASE WHEN line_no % 9 = 0 THEN -1.0 ELSE 0.9 END)) AS s
  FROM v_atoms GROUP BY ALL)""",
)
def advances(spark: SparkSession, d: str) -> DataFrame:
    one = G.glyph_advance(
        F.col("w") * 480,
        (8 + F.col("doc_id") % 5).cast("double"),
        F.lit(0.1),
        F.lit(0.25),
        F.col("style_key") == "other",
        F.when(F.col("line_no") % 9 == 0, -1.0).otherwise(0.9),
    )
    total = views.atoms(spark, d).groupBy("doc_id", "page", "line_no").agg(F.sum(one).alias("s"))
    return total.select("doc_id", "page", "line_no", F.round(G.positive_or_zero(F.col("s")), 4).alias("run_advance"))


@query(
    "udf3_normal_forms",
    """SELECT doc_id, sha256(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ç', 'c' || chr(807)))) AS nfc_digest,
  sha256(nfc_normalize(text) || 'fi') AS nfkc_digest FROM documents""",
)
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    loose = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ç"), F.lit("c\u0327"))
    return read_table(spark, d, "documents").select(
        "doc_id",
        F.sha2(T.nfc(loose), 256).alias("nfc_digest"),
        F.sha2(T.nfkc(F.concat("text", F.lit("ﬁ"))), 256).alias("nfkc_digest"),
    )

"""Join queries (JON1-JON14, SET1, SET2, TOP1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import ORACLE, query
from glyphfold.catalog.scalars import STYLE_SQL, SUFFIX, style_word
from glyphfold.catalog.sqlviews import ATOMS, CATALOGUE, EDITS, LINES, SPANS
from glyphfold.functions import text as T
from glyphfold.operators import aggregates as A
from glyphfold.operators import joins as J
from glyphfold.operators import sequences as S
from glyphfold.operators import spatial as X
from glyphfold.plans import views
from glyphfold.session import deal
from glyphfold.sources.corpus import read_table


def docs_by_id(spark: SparkSession, d: str) -> DataFrame:
    return views.dealt(spark, d)


def spans_of(lines: DataFrame) -> DataFrame:
    """Lines with their place in the document text (line breaks count one)."""
    from glyphfold.operators.ordered import Sequence

    return (
        Sequence(lines, ["doc_id"], ["line_no"])
        .running_sum("char_end", F.length("text") + 1)
        .with_column("char_end", F.col("char_end") - 1)
        .with_column("char_start", F.col("char_end") - F.length("text"))
        .done()
    )


@query(
    "jon1_locate",
    f"""WITH {ATOMS}, s AS (SELECT *, e - length(text) - 1 AS char_start, e AS char_end FROM (
    SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM v_lines)),
p AS (SELECT a.doc_id, a.line_no, a.tok_no, CAST(a.x + s.char_start + CASE WHEN a.doc_id % 9 = 0 THEN 1000000 ELSE 0 END AS BIGINT) AS pos FROM v_atoms a JOIN s USING (doc_id, line_no))
SELECT p.doc_id, count(*) AS points, count(s.line_no) AS located, CAST(coalesce(sum(s.line_no), 0) AS BIGINT) AS line_sum,
  CAST(coalesce(sum(CASE WHEN s.line_no = p.line_no THEN 1 ELSE 0 END), 0) AS BIGINT) AS own_line
FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND s.char_start <= p.pos AND p.pos < s.char_end GROUP BY p.doc_id""",
)
def locate(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines_of(docs_by_id(spark, d))
    ranges = spans_of(lines).select(
        "doc_id", F.col("line_no").alias("owner"), "char_start", (F.col("char_end") + 1).alias("range_end")
    )
    starts = ranges.select("doc_id", F.col("owner").alias("line_no"), "char_start")
    far = F.when(F.col("doc_id") % 9 == 0, 1_000_000).otherwise(0)
    points = (
        views.tokens_of(lines)
        .join(starts, ["doc_id", "line_no"])
        .select("doc_id", "line_no", "tok_no", (F.col("x") + F.col("char_start") + far).cast("bigint").alias("pos"))
    )
    found = X.locate(
        points, ranges, ["doc_id"], "pos", "char_start", "range_end", ["owner"], ["owner"], ["doc_id", "line_no", "tok_no"]
    )
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.count("owner").alias("located"),
        F.coalesce(F.sum("owner"), F.lit(0)).cast("bigint").alias("line_sum"),
        F.count_if(F.col("owner") == F.col("line_no")).alias("own_line"),
    )


@query(
    "jon2_resolve_unique",
    f"""WITH {LINES}, t AS (SELECT doc_id, length(text) % 40 AS k, count(*) AS n, min(line_no) AS line_no FROM v_lines GROUP BY ALL),
r AS (SELECT event_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 40 AS k FROM events)
SELECT event_id, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'STALE_REVISION' WHEN n > 1 THEN 'READ_ONLY_SPAN' ELSE 'RESOLVED' END AS outcome,
  CASE WHEN n = 1 THEN line_no END AS line_no FROM r LEFT JOIN t USING (doc_id, k)""",
)
def resolve_unique(spark: SparkSession, d: str) -> DataFrame:
    targets = views.lines(spark, d).select("doc_id", (F.length("text") % 40).alias("k"), "line_no")
    requests = read_table(spark, d, "events").select(
        "event_id",
        (F.col("event_id") % views.document_span(spark, d)).alias("doc_id"),
        (F.get_json_object("props", "$.k").cast("int") % 40).alias("k"),
    )
    return J.resolve_unique(requests, targets, ["doc_id", "k"], ["line_no"]).select(
        "event_id", "matches", "outcome", "line_no"
    )


@query(
    "jon3_box_overlap",
    f"""WITH {ATOMS}, {EDITS}, t AS (SELECT doc_id, page, line_no, 5.5::DOUBLE AS x, CAST(-((line_no - 1) % 50) AS DOUBLE) - 0.5 AS y,
    CAST(20 + (doc_id % 30) * 10 AS DOUBLE) AS w, CASE WHEN doc_id % 4 = 0 THEN 9.0 ELSE 1.0 END::DOUBLE AS h FROM v_edits)
SELECT a.doc_id, a.page, count(*) AS pairs, round(sum(a.x), 3) AS sx, CAST(sum(a.tok_no) AS BIGINT) AS toks
FROM v_atoms a JOIN t ON a.doc_id = t.doc_id AND a.page = t.page AND a.x < t.x + t.w AND a.x + a.w > t.x AND a.y < t.y + t.h AND a.y + a.h > t.y
GROUP BY a.doc_id, a.page""",
)
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    targets = views.edits(spark, d).select(
        "doc_id",
        "page",
        F.lit(5.5).alias("x"),
        (-((F.col("line_no") - 1) % 50) - 0.5).cast("double").alias("y"),
        (20 + (doc % 30) * 10).cast("double").alias("w"),
        F.when(doc % 4 == 0, 9.0).otherwise(1.0).alias("h"),
    )
    pairs = X.join_intersects(views.atoms(spark, d), targets, ["doc_id", "page"], ["tok_no"], [])
    return pairs.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.sum("l_x"), 3).alias("sx"),
        F.sum("l_tok_no").cast("bigint").alias("toks"),
    )


# Runs and line graphics derived from lines: one run per line of some length,
# one graphic per run, placed well for most and badly, in one way each, for the rest.
_DECO_SQL = f"""{LINES}, runs AS (SELECT doc_id, page, line_no, 0 AS run_start, length(text) AS run_end, 0.0::DOUBLE AS bx0, -3.0*((line_no-1) % 50) AS by0,
    length(text)::DOUBLE AS bx1, -3.0*((line_no-1) % 50) AS by1, 2.0::DOUBLE AS em, 'rgb' AS space, [0.1, 0.2, (doc_id % 3) / 10.0]::DOUBLE[] AS comps FROM v_lines WHERE length(text) > 3),
gr AS (SELECT doc_id, page, line_no AS graphic_id, CASE WHEN line_no % 11 = 4 THEN -0.2 WHEN line_no % 11 = 5 THEN -0.5 ELSE 0.0 END::DOUBLE AS gx0, by0 + CASE line_no % 4 WHEN 0 THEN -0.2 WHEN 1 THEN 0.8 WHEN 2 THEN -0.6 ELSE 1.3 END AS gy0,
    bx1 * CASE WHEN line_no % 11 = 6 THEN 0.5 WHEN line_no % 11 = 7 THEN 0.95 ELSE 1.0 END AS gx1, by0 + CASE line_no % 4 WHEN 0 THEN -0.2 WHEN 1 THEN 0.8 WHEN 2 THEN -0.6 ELSE 1.3 END + CASE WHEN line_no % 11 = 8 THEN bx1 * 0.05 ELSE 0 END AS gy1,
    CASE WHEN line_no % 13 = 5 THEN 0.6 WHEN line_no % 13 = 6 THEN 0.4 ELSE 0.1 END::DOUBLE AS thickness, CASE WHEN line_no % 17 = 3 THEN 'gray' ELSE 'rgb' END AS space,
    [0.1, 0.2, (doc_id % 3) / 10.0 + (line_no % 5) * 0.006]::DOUBLE[] AS comps, CASE WHEN line_no % 19 = 2 THEN 2 ELSE 1 END AS refs FROM runs)"""


@query(
    "jon4_decorations",
    f"""WITH {_DECO_SQL}, pr AS (SELECT g.doc_id, g.page, g.graphic_id, g.refs, r.line_no, r.run_start, r.run_end, r.em, r.bx1 - r.bx0 AS len,
    sqrt((gx1-gx0)**2 + (gy1-gy0)**2) AS gl, gx1 - gx0 AS hx, ((gy0 + gy1) / 2 - r.by0) / r.em AS off, least(gx0, gx1) AS lo, greatest(gx0, gx1) AS hi,
    thickness / em AS te, g.space = r.space AND list_max([abs(g.comps[1]-r.comps[1]), abs(g.comps[2]-r.comps[2]), abs(g.comps[3]-r.comps[3])]) <= 0.02 + 2.220446049250313e-16 AS col
  FROM gr g JOIN runs r ON g.doc_id = r.doc_id AND g.page = r.page),
ev AS (SELECT *, CASE WHEN off BETWEEN -0.35 AND -0.02 THEN 'underline' WHEN off BETWEEN 0.2 AND 0.65 THEN 'strikethrough' END AS kind,
    greatest(0, least(len, hi) - greatest(0, lo)) / len AS ov FROM pr),
pl AS (SELECT *, col AND ov + 2.220446049250313e-16 >= 0.9 AND greatest(0, -lo)/em <= 0.15 + 2.220446049250313e-16 AND greatest(0, hi - len)/em <= 0.15 + 2.220446049250313e-16 AS exact FROM ev
  WHERE abs(hx) / gl + 2.220446049250313e-16 >= cos(radians(1.0)) AND kind IS NOT NULL AND te + 2.220446049250313e-16 >= 0.02 AND te <= 0.2 + 2.220446049250313e-16 AND ov > 0.1),
j AS (SELECT doc_id, page, graphic_id, count(*) AS plausible, count(*) FILTER (exact) AS exact, min(kind) AS kind, min(line_no) AS line_no, count(DISTINCT line_no) AS nl, min(run_end) AS run_end FROM pl GROUP BY ALL)
SELECT gr.doc_id, gr.page, gr.graphic_id, CASE WHEN refs = 1 AND exact = 1 AND plausible = 1 THEN j.kind END AS kind,
  CASE WHEN refs <> 1 THEN 'shared-content' WHEN exact = 1 AND plausible = 1 THEN NULL WHEN plausible > 1 THEN 'multiple-owners' ELSE 'ambiguous-geometry' END AS warning,
  CASE WHEN nl = 1 THEN j.line_no END AS line_no, coalesce(plausible, 0) AS plausible
FROM gr LEFT JOIN j USING (doc_id, page, graphic_id)""",
)
def decorations(spark: SparkSession, d: str) -> DataFrame:
    graphics, runs = decoration_inputs(views.lines(spark, d))
    return X.match_decorations(graphics, runs, ["doc_id", "page"]).drop("run_start", "run_end")


def decoration_inputs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    line, doc = F.col("line_no"), F.col("doc_id")
    base = (-3.0 * ((line - 1) % 50)).cast("double")
    length = F.length("text").cast("double")
    runs = lines.filter(F.length("text") > 3).select(
        "doc_id",
        "page",
        "line_no",
        F.lit(0).alias("run_start"),
        F.length("text").alias("run_end"),
        F.lit(0.0).alias("bx0"),
        base.alias("by0"),
        length.alias("bx1"),
        base.alias("by1"),
        F.lit(2.0).alias("em"),
        F.lit("rgb").alias("space"),
        F.array(F.lit(0.1), F.lit(0.2), (doc % 3) / 10.0).alias("comps"),
    )

    def case(mod: int, values: dict[int, float], other: float) -> Column:
        out = F.lit(other)
        for k, v in values.items():
            out = F.when(line % mod == k, v).otherwise(out)
        return out

    level = F.col("by0") + case(4, {0: -0.2, 1: 0.8, 2: -0.6}, 1.3)
    graphics = runs.select(
        "doc_id",
        "page",
        line.alias("graphic_id"),
        case(11, {4: -0.2, 5: -0.5}, 0.0).alias("gx0"),
        level.alias("gy0"),
        (F.col("bx1") * case(11, {6: 0.5, 7: 0.95}, 1.0)).alias("gx1"),
        (level + F.when(line % 11 == 8, F.col("bx1") * 0.05).otherwise(0.0)).alias("gy1"),
        case(13, {5: 0.6, 6: 0.4}, 0.1).alias("thickness"),
        F.when(line % 17 == 3, "gray").otherwise("rgb").alias("space"),
        F.array(F.lit(0.1), F.lit(0.2), (doc % 3) / 10.0 + (line % 5) * 0.006).alias("comps"),
        F.when(line % 19 == 2, 2).otherwise(1).alias("refs"),
    )
    return graphics, runs


@query(
    "jon5_requirements",
    f"""WITH {CATALOGUE}, m AS (SELECT *, CASE WHEN font_id % 10 = 0 THEN 'm' || font_id % 50 END AS metrics, ['regular', 'condensed'][font_id % 2 + 1] AS subfamily FROM v_catalogue),
q AS (SELECT p_partkey AS req_id, CASE p_partkey % 8 WHEN 2 THEN 'regular' WHEN 7 THEN 'condensed' END AS sub, CASE WHEN p_partkey % 4 = 0 THEN 'absent' ELSE lower(replace(p_name, ' ', '')) END AS name_key,
   CASE WHEN p_partkey % 4 = 1 THEN 'absent' ELSE string_split(p_name, ' ')[-1] END AS family_key,
   CASE WHEN p_partkey % 6 = 0 THEN 900 WHEN p_size % 2 = 0 THEN 400 ELSE 700 END AS weight, p_size % 3 = 0 AS italic,
   list_distinct(list_transform(string_split(CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 25 = 1 THEN p_name || 'é' ELSE replace(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '#' END, '') END, ''), lambda c: unicode(c))) AS need,
   CASE WHEN p_partkey % 5 = 0 THEN sha256(p_name || '|' || p_brand) END AS hash, CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey % 50 END AS metrics FROM part),
n AS (SELECT * EXCLUDE (need), list_filter(need, lambda c: c > 0) AS need FROM q),
x AS (SELECT req_id, font_id, source_rank, q.weight = c.weight AND q.italic = c.italic AND (q.sub IS NULL OR q.sub = c.subfamily) AS style,
   CASE WHEN q.hash = c.hash THEN 0 WHEN q.weight = c.weight AND q.italic = c.italic AND (q.sub IS NULL OR q.sub = c.subfamily) AND (q.name_key = c.name_key OR q.family_key = c.family_key)
     THEN CASE WHEN q.metrics = c.metrics THEN 0 ELSE 1 END ELSE 2 END AS class
  FROM n q JOIN m c ON list_has_all(c.code_points, q.need)),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY class, NOT style, source_rank, font_id) AS rn FROM x)
SELECT n.req_id, CASE class WHEN 0 THEN 'exact' WHEN 1 THEN 'compatible-version' WHEN 2 THEN 'substitute' ELSE 'unavailable' END AS kind, font_id,
  CASE class WHEN 0 THEN 'exact-font-evidence' WHEN 1 THEN 'matching-family-and-style' WHEN 2 THEN 'font-substitution-required' ELSE 'missing-glyph-coverage' END AS reason
FROM n LEFT JOIN r ON n.req_id = r.req_id AND rn = 1""",
)
def requirements(spark: SparkSession, d: str) -> DataFrame:
    font = F.col("font_id")
    catalogue = views.catalogue(spark, d).withColumns(
        {
            "metrics": F.when(font % 10 == 0, F.concat(F.lit("m"), (font % 50).cast("string"))),
            "subfamily": F.when(font % 2 == 0, "Regular").otherwise("Con densed"),
        }
    )
    k = F.col("p_partkey")
    wanted = (
        F.when(k % 9 == 0, "")
        .when(k % 25 == 1, F.concat("p_name", F.lit("é")))
        .otherwise(F.replace("p_name", F.when(k % 2 == 0, " ").otherwise("#"), F.lit("")))
    )
    reqs = read_table(spark, d, "part").select(
        k.alias("req_id"),
        F.when(k % 4 == 0, "absent").otherwise(F.lower(F.replace("p_name", F.lit(" "), F.lit("")))).alias("name_key"),
        F.when(k % 4 == 1, "absent").otherwise(F.element_at(F.split("p_name", " "), -1)).alias("family_key"),
        F.when(k % 6 == 0, 900).when(F.col("p_size") % 2 == 0, 400).otherwise(700).alias("weight"),
        (F.col("p_size") % 3 == 0).alias("italic"),
        T.code_points(wanted).alias("code_points"),
        F.when(k % 5 == 0, F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256)).alias("hash"),
        F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 50).cast("string"))).alias("metrics"),
        F.when(k % 8 == 2, "regular").when(k % 8 == 7, "Condensed").alias("subfamily"),
    )
    return J.resolve_requirements(reqs, catalogue)


_COMPACT = "lower(regexp_replace({}, '[\\s_-]+', '', 'g'))"


@query(
    "jon6_tiered",
    f"""WITH c AS (SELECT p_partkey AS font_id, {_COMPACT.format("p_brand || ' ' || p_name")} AS nk,
    regexp_replace({_COMPACT.format("p_name")}, '^(.+?)(?:{SUFFIX})$', '\\1') AS fk, {_COMPACT.format(STYLE_SQL)} AS st FROM part WHERE p_partkey % 3 <> 0),
k AS (SELECT *, CASE WHEN regexp_matches(st, 'black|heavy') THEN 900 WHEN regexp_matches(st, 'extrabold|ultrabold') THEN 800
  WHEN regexp_matches(st, 'semibold|demibold') THEN 600 WHEN contains(st, 'bold') THEN 700 WHEN contains(st, 'medium') THEN 500
  WHEN regexp_matches(st, 'extralight|ultralight') THEN 200 WHEN contains(st, 'light') THEN 300 WHEN contains(st, 'thin') THEN 100
  ELSE 400 END AS weight, regexp_matches(st, 'italic|oblique') AS italic FROM c),
q AS (SELECT p_partkey AS req_id, CASE WHEN p_partkey % 2 = 0 THEN 'QWERTY+' || p_brand || '-' || p_name ELSE p_name || ' Bold' END AS name,
   CASE WHEN p_size % 2 = 0 THEN 700 ELSE 300 END AS weight, p_size % 4 = 1 AS italic FROM part),
qq AS (SELECT *, lower(regexp_replace(regexp_replace(name, '^[A-Z]{{6}}\\+', '', 'i'), '[\\s_-]+', '', 'g')) AS nk,
   regexp_replace(lower(regexp_replace(regexp_replace(name, '^[A-Z]{{6}}\\+', '', 'i'), '[\\s_-]+', '', 'g')), '^(.+?)(?:{SUFFIX})$', '\\1') AS fk FROM q),
a AS (SELECT nk, min(font_id) AS f FROM k GROUP BY nk), b AS (SELECT fk, weight, italic, min(font_id) AS f FROM k GROUP BY ALL)
SELECT req_id, CASE WHEN a.f IS NOT NULL THEN 'postscript-name' WHEN b.f IS NOT NULL THEN 'family-style' ELSE 'no-exact-match' END AS basis, coalesce(a.f, b.f) AS font_id
FROM qq LEFT JOIN a USING (nk) LEFT JOIN b ON qq.fk = b.fk AND qq.weight = b.weight AND qq.italic = b.italic""",
)
def tiered(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    k = F.col("p_partkey")
    catalogue = part.filter(k % 3 != 0).select(
        k.alias("font_id"), F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.col("p_name").alias("family"), style_word().alias("style")
    )
    reqs = part.select(
        k.alias("req_id"),
        F.when(k % 2 == 0, F.concat(F.lit("QWERTY+"), "p_brand", F.lit("-"), "p_name"))
        .otherwise(F.concat("p_name", F.lit(" Bold")))
        .alias("name"),
        F.when(F.col("p_size") % 2 == 0, 700).otherwise(300).alias("weight"),
        (F.col("p_size") % 4 == 1).alias("italic"),
    )
    return J.match_tiered(reqs, catalogue)


@query(
    "jon7_decode",
    f"""WITH {LINES}, mp AS (SELECT n_nationkey % 3 AS font_id, n_nationkey AS ordinal, 97 + n_nationkey AS first, 100 + n_nationkey AS last, 900 + n_nationkey * 3 AS target FROM nation),
e AS (SELECT font_id, ordinal, unnest(range(first, last + 1)) AS code, first, target FROM mp),
t AS (SELECT font_id, code, arg_max(target + code - first, ordinal) AS cp FROM e GROUP BY ALL),
wd AS (SELECT n_nationkey % 3 AS font_id, 97 + n_nationkey AS code, 300.0 + n_nationkey AS width FROM nation),
c AS (SELECT doc_id, line_no, doc_id % 3 AS font_id, unicode(ch) AS code FROM (SELECT doc_id, line_no, unnest(string_split(text, '')) AS ch FROM v_lines) WHERE ch <> '')
SELECT doc_id, count(*) AS codes, count(cp) AS known, CAST(coalesce(sum(cp), 0) AS BIGINT) AS cp_sum, sum(coalesce(width, 500.0))::DOUBLE AS width
FROM c LEFT JOIN t USING (font_id, code) LEFT JOIN wd USING (font_id, code) GROUP BY doc_id""",
)
def decode(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "nation")
    n = F.col("n_nationkey")
    mappings = nation.select(
        (n % 3).cast("bigint").alias("font_id"),
        n.alias("ordinal"),
        (97 + n).alias("first"),
        (100 + n).alias("last"),
        (900 + n * 3).alias("target"),
        F.lit(None).cast("array<string>").alias("targets"),
    )
    widths = nation.select((n % 3).cast("bigint").alias("font_id"), (97 + n).alias("code"), (300.0 + n).alias("width"))
    codes = read_table(spark, d, "documents").select(
        "doc_id",
        (F.col("doc_id") % 3).alias("font_id"),
        F.explode(F.transform(F.split("text", ""), lambda c: F.ascii(c))).alias("code"),
    )
    # Line breaks and the empty end piece of a split are no codes.  Counted before they meet the tables.
    counted = codes.filter("code > 0 and code <> 10").groupBy("doc_id", "font_id", "code").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return J.decode_codes(counted, J.code_table(mappings), widths, 500.0).groupBy("doc_id").agg(
        F.sum(n).alias("codes"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), n)), F.lit(0)).alias("known"),
        F.coalesce(F.sum(n * F.ascii("text")), F.lit(0)).cast("bigint").alias("cp_sum"),
        F.sum(n * F.col("width")).alias("width"),
    )


@query(
    "jon7_outcomes",
    """WITH m AS (SELECT p_partkey % 40 AS font_id, p_partkey % 2 + 1 AS len, p_size * 10 AS first, p_size * 10 + CASE WHEN p_partkey % 163 = 0 THEN -1 WHEN p_partkey % 149 = 0 THEN 70000 ELSE p_size % 9 END AS last, p_partkey % 131 = 0 AS listed FROM part),
c AS (SELECT DISTINCT font_id, len, unnest(range(first, last + 1)) AS code FROM m WHERE last >= first AND last - first < 250),
n AS (SELECT font_id, count(*) AS codes FROM c GROUP BY font_id),
r AS (SELECT font_id, bool_or(last < first) AS inverted, bool_or(last - first + 1 > 250) AS long, bool_or(listed AND last > first) AS short FROM m GROUP BY font_id)
SELECT font_id, CASE WHEN inverted THEN 'inverted-range' WHEN long THEN 'range-limit' WHEN short THEN 'short-list' WHEN codes > 250 THEN 'code-limit' ELSE 'ok' END AS outcome FROM r LEFT JOIN n USING (font_id)""",
)
def code_outcomes(spark: SparkSession, d: str) -> DataFrame:
    part, key, size = read_table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    first = size * 10
    mappings = part.select(
        (key % 40).alias("font_id"),
        (key % 2 + 1).alias("code_len"),
        key.alias("ordinal"),
        first.alias("first"),
        (first + F.when(key % 163 == 0, -1).when(key % 149 == 0, 70_000).otherwise(size % 9)).alias("last"),
        F.lit(900).alias("target"),
        F.when(key % 131 == 0, F.array(F.lit("x"))).alias("targets"),
    )
    return J.code_outcomes(mappings, 250)


@query(
    "jon8_coverage",
    """WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(s.k, c.k) AS order_key, CASE WHEN n IS NULL THEN 'missing' WHEN s.k IS NULL THEN CASE WHEN n > 1 THEN 'unexpected-duplicated' ELSE 'unexpected' END
  WHEN n > 1 THEN 'duplicated' ELSE 'covered' END AS status FROM s FULL JOIN c ON s.k = c.k""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    source = read_table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("order_key"))
    covered = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"))
    return J.coverage(source, covered, ["order_key"])


@query(
    "jon9_positional",
    """WITH e AS (SELECT conv_id, turn AS pos, role AS v FROM conversations),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS v FROM conversations WHERE (conv_id + turn) % 7 <> 0),
j AS (SELECT coalesce(e.conv_id, a.conv_id) AS conv_id, coalesce(e.pos, a.pos) AS pos, e.v AS expected, a.v AS actual, e.conv_id IS NOT NULL AND a.conv_id IS NOT NULL AND e.v = a.v AS valid
  FROM e FULL JOIN a ON e.conv_id = a.conv_id AND e.pos = a.pos)
SELECT conv_id, pos, expected, actual, valid FROM j""",
)
def positional(spark: SparkSession, d: str) -> DataFrame:
    from glyphfold.operators.ordered import HOT_ROWS, Sequence

    conv = read_table(spark, d, "conversations")
    expected = conv.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("v"))
    kept = conv.filter((F.col("conv_id") + F.col("turn")) % 7 != 0).select("conv_id", "turn")
    actual = (
        Sequence(kept, ["conv_id"], ["turn"], HOT_ROWS)
        .row_number("n")
        .select(
            "conv_id",
            (F.col("n") - 1).cast("bigint").alias("pos"),
            F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("v"),
        )
    )
    return J.compare_positional(expected, actual, ["conv_id"], "pos", "v")


@query(
    "jon9_verdict",
    ORACLE["jon9_positional"].replace("SELECT conv_id, pos, expected, actual, valid FROM j", """, g AS (SELECT conv_id, count(*) AS compared, count(*) FILTER (NOT coalesce(valid, false) AND actual IS NULL) AS missing, count(*) FILTER (NOT coalesce(valid, false) AND expected IS NULL) AS unexpected,
  count(*) FILTER (NOT coalesce(valid, false) AND expected IS NOT NULL AND actual IS NOT NULL) AS different FROM j GROUP BY conv_id),
p AS (SELECT conv_id, count(*) + CASE WHEN conv_id % 5 = 2 THEN 1 ELSE 0 END AS positions FROM conversations GROUP BY conv_id UNION ALL SELECT -1 - n_nationkey, 3 FROM nation)
SELECT p.conv_id, positions, coalesce(compared, 0) AS compared, coalesce(missing, 0) AS missing, coalesce(unexpected, 0) AS unexpected, coalesce(different, 0) AS different,
  coalesce(missing + unexpected + different = 0 AND compared = positions, false) AS valid FROM p LEFT JOIN g USING (conv_id)"""),
)
def positional_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations; some declare another length, some are declared and not there."""
    conv = F.col("conv_id")
    sizes = read_table(spark, d, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) + F.when(conv % 5 == 2, 1).otherwise(0)).alias("positions"))
    absent = read_table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("conv_id"), F.lit(3).cast("bigint").alias("positions"))
    return J.positional_verdict(positional(spark, d), ["conv_id"], sizes.unionByName(absent))


@query(
    "jon10_snapshot_diff",
    """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id + 10000000, text, lang FROM documents WHERE doc_id % 17 = 0),
j AS (SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN d.text = a.text AND d.lang IS NOT DISTINCT FROM a.lang THEN 'unchanged' ELSE 'changed' END AS status
  FROM documents d FULL JOIN a ON d.doc_id = a.doc_id)
SELECT doc_id, status, doc_id % 14 = 0 AS authorised, CASE WHEN doc_id % 14 = 0 THEN status = 'changed' ELSE status = 'unchanged' END AS ok FROM j""",
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    doc = F.col("doc_id")
    edited = docs.filter(doc % 11 != 0).withColumns(
        {
            "text": F.when(doc % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
            "lang": F.when(doc % 13 != 0, F.col("lang")),
        }
    )
    after = edited.unionByName(docs.filter(doc % 17 == 0).withColumn("doc_id", doc + 10_000_000))
    listed = docs.unionByName(docs.withColumn("doc_id", doc + 10_000_000)).filter(doc % 14 == 0).select("doc_id")
    return J.diff_snapshots(docs, after, ["doc_id"], listed)


@query(
    "jon10_verdict",
    f"""WITH r AS ({ORACLE["jon10_snapshot_diff"]}) SELECT doc_id % 10 AS part, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (NOT ok) AS violations, count(*) FILTER (NOT ok) = 0 AS valid FROM r GROUP BY part""",
)
def snapshot_verdict(spark: SparkSession, d: str) -> DataFrame:
    return J.snapshot_verdict(snapshot_diff(spark, d).withColumn("part", F.col("doc_id") % 10), ["part"])


_POINTS_SQL = """pts AS (SELECT event_id AS point_id, doc_id, CAST((line_no - 1) // 50 AS INTEGER) AS page, line_no, px, -((line_no - 1) % 50)::DOUBLE + 0.5 AS py FROM
  (SELECT event_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, CAST(user_id % 70 + 1 AS INTEGER) AS line_no, value * 1.5 AS px FROM events))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each event, over all documents and the lines of their first pages."""
    line = F.col("line_no")
    asked = read_table(spark, d, "events").select(
        F.col("event_id").alias("point_id"),
        (F.col("event_id") % views.document_span(spark, d)).alias("doc_id"),
        (F.col("user_id") % 70 + 1).cast("int").alias("line_no"),
        (F.col("value") * 1.5).alias("px"),
    )
    return asked.select(
        "point_id",
        "doc_id",
        F.floor((line - 1) / views.LINES_PER_PAGE).cast("int").alias("page"),
        "line_no",
        "px",
        (0.5 - (line - 1) % views.LINES_PER_PAGE).cast("double").alias("py"),
    )


def points_and_atoms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, tuple[int, str]]:
    """Points and atoms dealt out alike, so that they meet without another exchange, and how."""
    parts = views.document_parts(spark, d)
    return deal(points(spark, d), "doc_id", parts), views.atoms(spark, d, parts), (parts, "doc_id")


@query(
    "jon11_hit_test",
    f"""WITH {ATOMS}, {_POINTS_SQL}, h AS (SELECT p.point_id, min(a.line_no * 100000 + a.tok_no) AS hit FROM pts p JOIN v_atoms a
  ON p.doc_id = a.doc_id AND p.page = a.page AND px >= x AND px <= x + w AND py >= y AND py <= y + h GROUP BY p.point_id)
SELECT point_id, CAST(hit // 100000 AS INTEGER) AS hit_line, CAST(hit % 100000 AS INTEGER) AS hit_tok FROM pts LEFT JOIN h USING (point_id)""",
)
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    asked, atoms, _ = points_and_atoms(spark, d)
    hits = X.hit_test(asked.drop("line_no"), atoms, ["doc_id", "page"], ["line_no", "tok_no"])
    return hits.select("point_id", F.col("line_no").alias("hit_line"), F.col("tok_no").alias("hit_tok"))


@query(
    "jon11_nearest",
    f"""WITH {ATOMS}, {_POINTS_SQL}, r AS (SELECT point_id, tok_no, abs(px - (x + w / 2)) AS dist, row_number() OVER (PARTITION BY point_id ORDER BY abs(px - (x + w / 2)), tok_no) AS rn
  FROM pts p JOIN v_atoms a ON p.doc_id = a.doc_id AND p.page = a.page AND p.line_no = a.line_no)
SELECT point_id, tok_no, round(dist, 6) AS distance FROM pts LEFT JOIN r USING (point_id) WHERE rn = 1 OR rn IS NULL""",
)
def nearest(spark: SparkSession, d: str) -> DataFrame:
    asked, atoms, _ = points_and_atoms(spark, d)
    found = X.nearest_on_line(asked, atoms, ["doc_id", "page", "line_no"], "point_id", "px", "tok_no")
    return found.select("point_id", "tok_no", F.round("distance", 6).alias("distance"))


@query(
    "jon11_targets",
    f"""WITH {ATOMS}, {_POINTS_SQL}, q AS (SELECT point_id, doc_id, page, px, py + (point_id % 7 - 3) * 3 AS py FROM pts),
h AS (SELECT q.point_id, min(a.line_no * 100000 + a.tok_no) AS hit FROM q JOIN v_atoms a ON q.doc_id = a.doc_id AND q.page = a.page AND px >= x AND px <= x + w AND py >= y AND py <= y + h GROUP BY q.point_id),
l AS (SELECT doc_id, page, line_no, min(y) - 4 AS low, max(y + h) + 4 AS high FROM v_atoms GROUP BY ALL),
n AS (SELECT q.point_id, any_value(q.doc_id) AS doc_id, any_value(q.page) AS page, any_value(px) AS px, min(line_no) AS line_no FROM q JOIN l ON q.doc_id = l.doc_id AND q.page = l.page AND py >= low AND py <= high WHERE q.point_id NOT IN (SELECT point_id FROM h) GROUP BY q.point_id),
c AS (SELECT n.point_id, n.line_no, a.tok_no, abs(px - (x + w / 2)) AS dist, row_number() OVER (PARTITION BY n.point_id ORDER BY abs(px - (x + w / 2)), a.tok_no) AS rn FROM n JOIN v_atoms a ON n.doc_id = a.doc_id AND n.page = a.page AND n.line_no = a.line_no),
t AS (SELECT point_id, hit // 100000 AS line_no, hit % 100000 AS tok_no, 0.0::DOUBLE AS distance FROM h UNION ALL SELECT point_id, line_no, tok_no, round(dist, 6) FROM c WHERE rn = 1)
SELECT q.point_id, CAST(line_no AS INTEGER) AS line_no, CAST(tok_no AS INTEGER) AS tok_no, distance, CAST((tok_no - 1) // 5 AS INTEGER) AS group_no FROM q LEFT JOIN t USING (point_id)""",
)
def targets(spark: SparkSession, d: str) -> DataFrame:
    """Points on, between, above and beside lines; groups of five tokens."""
    dots, atoms, lie = points_and_atoms(spark, d)
    asked = dots.select("point_id", "doc_id", "page", "px", (F.col("py") + (F.col("point_id") % 7 - 3) * 3).alias("py"))
    group = F.floor((F.col("tok_no") - 1) / 5).cast("int")
    groups = atoms.groupBy("doc_id", "page", "line_no", group.alias("group_no")).agg(
        F.min("tok_no").alias("start"), (F.max("tok_no") + 1).alias("end")
    )
    found = X.point_targets(asked, atoms, groups, ["doc_id", "page"], lie=lie)
    return found.select("point_id", "line_no", "tok_no", F.round("distance", 6).alias("distance"), "group_no")


@query(
    "jon12_bind_edits",
    f"""WITH {LINES}, {EDITS}, g AS (SELECT doc_id, page, text, count(*) AS n, min(line_no) AS line_no FROM v_lines GROUP BY ALL),
e AS (SELECT doc_id, page, CASE WHEN doc_id % 8 = 0 THEN source_text || '?' ELSE source_text END AS source_text FROM v_edits)
SELECT e.doc_id, e.page, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'STALE_REVISION' WHEN n > 1 THEN 'READ_ONLY_SPAN' ELSE 'RESOLVED' END AS outcome,
  CASE WHEN n = 1 THEN line_no END AS line_no, greatest(coalesce(n, 0) - 1, 0) AS elsewhere FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.page = g.page AND e.source_text = g.text""",
)
def bind_edits(spark: SparkSession, d: str) -> DataFrame:
    asked = views.edits(spark, d).select(
        "doc_id",
        "page",
        F.when(F.col("doc_id") % 8 == 0, F.concat("source_text", F.lit("?"))).otherwise(F.col("source_text")).alias("source_text"),
    )
    return J.bind_edits(asked, views.lines(spark, d), ["doc_id", "page"], "source_text", "text", ["line_no"]).drop("source_text")


@query(
    "jon13_overlay",
    f"""WITH {ATOMS}, r AS (SELECT doc_id, line_no, 2 AS s, 5 AS e, true AS u, false AS k FROM v_lines WHERE line_no % 2 = 0
  UNION ALL SELECT doc_id, line_no, 4, 4 + CAST(doc_id % 9 AS INTEGER), doc_id % 4 = 0, true FROM v_lines WHERE doc_id % 3 = 0)
SELECT a.doc_id, a.line_no, count(*) AS atoms, count(*) FILTER (u) AS underlined, count(*) FILTER (k) AS struck FROM (
  SELECT a.doc_id, a.line_no, a.tok_no, coalesce(bool_or(r.u), false) AS u, coalesce(bool_or(r.k), false) AS k
  FROM v_atoms a LEFT JOIN r ON a.doc_id = r.doc_id AND a.line_no = r.line_no AND a.tok_no >= r.s AND a.tok_no < r.e GROUP BY ALL) a GROUP BY ALL""",
)
def overlay(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines_of(docs_by_id(spark, d))
    doc = F.col("doc_id")
    first = lines.filter("line_no % 2 = 0").select(
        "doc_id", "line_no", F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit(True).alias("underline"), F.lit(False).alias("strike")
    )
    second = lines.filter(doc % 3 == 0).select(
        "doc_id",
        "line_no",
        F.lit(4).alias("start"),
        (4 + doc % 9).cast("int").alias("end"),
        (doc % 4 == 0).alias("underline"),
        F.lit(True).alias("strike"),
    )
    flagged = J.overlay_flags(
        views.tokens_of(lines), J.union_all(first, second), ["doc_id", "line_no"], "tok_no", ["underline", "strike"]
    )
    return flagged.groupBy("doc_id", "line_no").agg(
        F.count(F.lit(1)).alias("atoms"), F.count_if("underline").alias("underlined"), F.count_if("strike").alias("struck")
    )


@query(
    "jon14_upsert",
    # A repeated key, whose last change wins; a key that is new; and null keys, which are one key.
    """WITH b AS (SELECT CASE WHEN s_suppkey % 33 = 0 THEN NULL ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier),
c AS (SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 1000000 ELSE 0 END AS s_suppkey, s_name || '-' || v AS s_name, CASE WHEN s_suppkey % 15 = 0 THEN (s_nationkey + v) % 25 ELSE s_nationkey END::INTEGER AS s_nationkey, s_acctbal + v AS s_acctbal, v FROM supplier, (SELECT unnest([1, 2, 3]) AS v) WHERE s_suppkey % 5 = 0 AND v <= s_suppkey % 3 + 1
  UNION ALL SELECT NULL, 'none-' || s_suppkey, s_nationkey, 0.0, s_suppkey FROM supplier WHERE s_suppkey <= 2),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY v DESC) = 1)
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s_suppkey IS NOT DISTINCT FROM b.s_suppkey)""",
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    base, changes = supplier_changes(spark, d)
    return J.upsert(base, changes, ["s_suppkey"], ["v"])


def supplier_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    given, k = read_table(spark, d, "supplier"), F.col("s_suppkey")
    base = given.withColumn("s_suppkey", F.when(k % 33 != 0, k))
    versions = given.filter(k % 5 == 0).withColumn("v", F.explode(F.sequence(F.lit(1).cast("bigint"), k % 3 + 1)))
    changes = versions.select(
        (k + F.when(k % 10 == 0, 1_000_000).otherwise(0)).alias("s_suppkey"),
        F.concat("s_name", F.lit("-"), F.col("v").cast("string")).alias("s_name"),
        F.when(k % 15 == 0, (F.col("s_nationkey") + F.col("v")) % 25).otherwise(F.col("s_nationkey")).cast("int").alias("s_nationkey"),
        (F.col("s_acctbal") + F.col("v")).alias("s_acctbal"),
        "v",
    )
    unnamed = given.filter(k <= 2).select(
        F.lit(None).cast("bigint").alias("s_suppkey"), F.concat(F.lit("none-"), k.cast("string")).alias("s_name"), "s_nationkey", F.lit(0.0).alias("s_acctbal"), k.alias("v")
    )
    return base, changes.unionByName(unnamed)


@query("jon14_copy_on_write", ORACLE["jon14_upsert"])
def copy_on_write(spark: SparkSession, d: str) -> DataFrame:
    """The same on a table by nation, of which only the touched parts are written; some suppliers move to another nation."""
    from glyphfold.catalog.sources import scratch

    base, changes = supplier_changes(spark, d)
    path = f"{scratch(spark)}/supplier"
    base.write.partitionBy("s_nationkey").parquet(path)
    J.upsert_table(spark, path, changes, ["s_suppkey"], "s_nationkey", ["v"])
    return spark.read.parquet(path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(
    "set1_tagged_union",
    """SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier""",
)
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    s = read_table(spark, d, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")
    )
    return J.union_all(c, s)


@query(
    "set2_relation",
    """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0),
n AS (SELECT count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL) AS common, count(*) FILTER (r.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right FROM l FULL JOIN r ON l.k = r.k)
SELECT common, only_left, only_right, only_left + only_right = 0 AS equal, only_left = 0 AS left_in_right FROM n""",
)
def relation(spark: SparkSession, d: str) -> DataFrame:
    left = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    right = read_table(spark, d, "customer").filter("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("k"))
    return J.set_relation(left, right, ["k"])


@query(
    "set2_except",
    "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    left = read_table(spark, d, "orders").select("o_custkey")
    right = read_table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.set_difference(left, right, ["o_custkey"])


@query(
    "top1_ranked",
    """SELECT p_brand, p_partkey, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def ranked(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("p_type"), F.col("p_size").desc(), F.col("p_partkey")]
    return A.top_k(read_table(spark, d, "part"), ["p_brand"], order, 3).select("p_brand", "p_partkey", "rank")


@query(
    "top2_ordered_reasons",
    """WITH r AS (SELECT l_orderkey, [CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' END, CASE WHEN bool_or(l_linestatus = 'O') THEN 'open' END, CASE WHEN bool_or(l_discount > 0.05) THEN 'discounted' END] AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(a, lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def reasons_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = (
        read_table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.collect_set(
                F.when(F.col("l_returnflag") == "R", "returned")
            ).alias("a"),
            F.collect_set(F.when(F.col("l_linestatus") == "O", "open")).alias("b"),
            F.collect_set(F.when(F.col("l_discount") > 0.05, "discounted")).alias("c"),
        )
    )
    merged = F.concat("c", "a", "b")
    return found.select(
        "l_orderkey", F.array_join(T.ordered_reasons(merged, ["returned", "open", "discounted"]), ",").alias("reasons")
    )

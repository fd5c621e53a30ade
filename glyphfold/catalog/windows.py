"""Window and sequence queries (WIN1-WIN19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.joins import docs_by_id, spans_of
from glyphfold.catalog.sqlviews import ATOMS, EDITS, LINES, SPANS
from glyphfold.operators import sequences as S
from glyphfold.operators.ordered import HOT_ROWS, Sequence
from glyphfold.plans import views
from glyphfold.sources.corpus import read_table

LINE = ["doc_id", "page", "line_no"]


@query(
    "win1_placement",
    f"""WITH {ATOMS}, p AS (SELECT doc_id, line_no, tok_no, CASE WHEN tok_no % 4 = 0 THEN 0.25 WHEN tok_no % 7 = 0 THEN -0.125 END AS adj,
   coalesce(sum(w * 0.5) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   + sum(CASE WHEN tok_no % 4 = 0 THEN 0.25 WHEN tok_no % 7 = 0 THEN -0.125 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS st FROM v_atoms)
SELECT doc_id, line_no, sum(st)::DOUBLE AS starts, max(st)::DOUBLE AS last_start, count(adj) AS gaps FROM p GROUP BY ALL""",
)
def placement(spark: SparkSession, d: str) -> DataFrame:
    tok = F.col("tok_no")
    adjust = F.when(tok % 4 == 0, 0.25).when(tok % 7 == 0, -0.125)
    placed = S.place(views.atoms(spark, d), LINE, ["tok_no"], F.col("w") * 0.5, adjust)
    return placed.groupBy("doc_id", "line_no").agg(
        F.sum("start").alias("starts"), F.max("start").alias("last_start"), F.count("gap_before").alias("gaps")
    )


def page_atoms(spark: SparkSession, d: str, jitter: bool) -> DataFrame:
    """Atoms with baselines: apart by more than any tolerance, or close and overlapping."""
    atoms = views.atoms(spark, d)
    tok, line = F.col("tok_no"), F.col("line_no")
    by = F.col("y") * 10 + (tok % 3) * 0.2 if not jitter else F.col("y") * 1.5 + (tok * 7 % 13) * 0.1
    return atoms.select(
        "doc_id",
        "page",
        (line.cast("bigint") * 1_000_000 + tok).alias("atom_id"),
        F.col("x").alias("bx"),
        by.cast("double").alias("by"),
        F.lit(2.0).alias("h") if not jitter else (1.0 + line % 3).cast("double").alias("h"),
        # Close lines are turned now and then; lines far apart stay level.
        F.when(F.lit(jitter) & (line % 9 == 5), 0.0).otherwise(1.0).alias("dx"),
        F.when(F.lit(jitter) & (line % 9 == 5), 1.0).otherwise(0.0).alias("dy"),
    )


@query(
    "win2_lines_separable",
    # Baselines of different lines are far apart, so the greedy result is the derived line itself, from the top.
    f"""WITH {ATOMS}, a AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS line_id FROM v_atoms)
SELECT doc_id, page, line_no, tok_no, CAST(line_id AS INTEGER) AS line_id FROM a""",
)
def lines_separable(spark: SparkSession, d: str) -> DataFrame:
    assigned = S.assign_lines(page_atoms(spark, d, False))
    line = F.floor(F.col("atom_id") / 1_000_000)
    return assigned.select(
        "doc_id", "page", line.cast("int").alias("line_no"), (F.col("atom_id") % 1_000_000).cast("int").alias("tok_no"), "line_id"
    )


@query(
    "win2_lines_greedy",
    # One visit a step: the lines that can still be reached, with their heights.
    f"""WITH RECURSIVE {ATOMS}, a AS (SELECT doc_id, page, line_no * 1000000 + tok_no AS id, x AS bx, y * 1.5 + (tok_no * 7 % 13) * 0.1::DOUBLE AS yy, (1.0 + line_no % 3)::DOUBLE AS h, CASE WHEN line_no % 9 = 5 THEN 0.0 ELSE 1.0 END::DOUBLE AS dx, CASE WHEN line_no % 9 = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS dy FROM v_atoms),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY yy DESC, bx, id) AS n, count(*) OVER (PARTITION BY doc_id, page) AS total FROM a),
w AS (SELECT DISTINCT doc_id, page, 0::BIGINT AS n, []::STRUCT(i BIGINT, bx DOUBLE, yy DOUBLE, dx DOUBLE, dy DOUBLE, hs DOUBLE[])[] AS ls, 0::BIGINT AS made, 0::BIGINT AS ids FROM o UNION ALL
 SELECT doc_id, page, n, CASE WHEN hit IS NULL THEN list_append(alive, {{'i': made, 'bx': bx, 'yy': yy, 'dx': dx, 'dy': dy, 'hs': [h]}}) ELSE list_transform(alive, lambda l: CASE WHEN l.i = hit THEN {{'i': l.i, 'bx': l.bx, 'yy': l.yy, 'dx': l.dx, 'dy': l.dy, 'hs': list_append(l.hs, h)}} ELSE l END) END,
  made + CASE WHEN hit IS NULL THEN 1 ELSE 0 END, ids + coalesce(hit, made)
 FROM (SELECT *, list_filter(alive, lambda l: abs((yy - l.yy) * l.dx - (bx - l.bx) * l.dy) <= greatest(1.0, 0.35 * list_aggregate(l.hs, 'median')) AND l.dx * dx + l.dy * dy >= 0.99984)[1].i AS hit
  FROM (SELECT o.*, w.made, w.ids, list_filter(w.ls, lambda l: l.dy <> 0 OR abs(o.yy - l.yy) <= greatest(1.0, 0.35 * list_aggregate(l.hs, 'median'))) AS alive FROM w JOIN o ON o.doc_id = w.doc_id AND o.page = w.page AND o.n = w.n + 1)))
SELECT w.doc_id, w.page, CAST(made AS INTEGER) AS lines, n AS atoms, ids AS id_sum FROM w JOIN (SELECT DISTINCT doc_id, page, total FROM o) t ON t.doc_id = w.doc_id AND t.page = w.page AND t.total = w.n""",
)
def lines_greedy(spark: SparkSession, d: str) -> DataFrame:
    assigned = S.assign_lines(page_atoms(spark, d, True))
    return assigned.groupBy("doc_id", "page").agg(
        (F.max("line_id") + 1).alias("lines"), F.count(F.lit(1)).alias("atoms"), F.sum("line_id").alias("id_sum")
    )


@query(
    "win3_reading_order",
    # Raised tokens, and every ninth line turned upwards.
    f"""WITH {ATOMS}, r AS (SELECT doc_id, page, line_no, tok_no, x, y * 4 + (tok_no * 7 % 13) * 0.125 AS y, line_no % 9 = 5 AS up FROM v_atoms),
b AS (SELECT *, min(y) OVER l AS top, min(x) OVER l AS lft, CASE WHEN up THEN y ELSE x END AS along FROM r WINDOW l AS (PARTITION BY doc_id, page, line_no))
SELECT doc_id, page, line_no, tok_no, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top DESC, lft, line_no, along, tok_no) AS INTEGER) AS ordinal FROM b""",
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    raised = F.col("y") * 4 + (F.col("tok_no") * 7 % 13) * 0.125
    atoms = views.atoms(spark, d).withColumn("y", raised.cast("double"))
    up = F.col("line_no") % 9 == 5
    out = S.reading_order(atoms, "line_no", F.when(up, 0.0).otherwise(1.0), F.when(up, 1.0).otherwise(0.0))
    return out.select("doc_id", "page", "line_no", "tok_no", "ordinal")


_HEIGHT = "(1.0 + doc_id % 3)"


@query(
    "win4_groups",
    f"""WITH {ATOMS}, g AS (SELECT doc_id, line_no, tok_no, {_HEIGHT} AS h, x - lag(x + w) OVER p AS gap, lag(CASE WHEN tok_no % 11 = 4 THEN chr(65532) ELSE text END) OVER p AS pt FROM v_atoms WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
c AS (SELECT *, CASE WHEN gap > 0.75 * h OR (regexp_matches(pt, ':$') AND gap > 0.25 * h) THEN 1 ELSE 0 END AS cut FROM g),
n AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS group_no FROM c)
SELECT doc_id, line_no, CAST(max(group_no) AS INTEGER) AS last_group, CAST(sum(group_no * tok_no) AS BIGINT) AS mix FROM n GROUP BY ALL""",
)
def groups(spark: SparkSession, d: str) -> DataFrame:
    atoms = views.atoms(spark, d).withColumn("h", (1.0 + F.col("doc_id") % 3).cast("double"))
    # Now and then a glyph has no text: it splits like any other.
    out = S.split_groups(atoms.withColumn("text", F.when(F.col("tok_no") % 11 != 4, F.col("text"))))
    return out.groupBy("doc_id", "line_no").agg(
        F.max("group_no").alias("last_group"), F.sum(F.col("group_no") * F.col("tok_no")).cast("bigint").alias("mix")
    )


@query(
    "win5_synthetic_spaces",
    f"""WITH {ATOMS}, g AS (SELECT *, {_HEIGHT} AS hh, x - lag(x + w) OVER p AS gap, CASE WHEN tok_no % 3 = 0 THEN (tok_no % 5) * 0.5 END AS sg FROM v_atoms WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
s AS (SELECT *, CASE WHEN gap IS NULL THEN false WHEN sg IS NOT NULL THEN sg >= 0.2 * (4 + doc_id % 4) * 0.9 ELSE gap > 0.15 * hh AND gap <= 0.75 * hh END AS sp FROM g)
SELECT doc_id, line_no, count(*) FILTER (sp) AS spaces, sha256(string_agg(CASE WHEN sp THEN ' ' ELSE '' END || text, '' ORDER BY tok_no)) AS digest FROM s GROUP BY ALL""",
)
def synthetic_spaces(spark: SparkSession, d: str) -> DataFrame:
    tok = F.col("tok_no")
    atoms = views.atoms(spark, d).withColumn("h", (1.0 + F.col("doc_id") % 3).cast("double"))
    out = S.needs_space(
        atoms, F.when(tok % 3 == 0, (tok % 5) * 0.5), (4 + F.col("doc_id") % 4).cast("double"), F.lit(0.9)
    )
    out = out.withColumn("_t", F.concat(F.when(F.col("space_before"), " ").otherwise(""), "text"))
    return out.groupBy("doc_id", "line_no").agg(
        F.count_if("space_before").alias("spaces"),
        F.sha2(F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY tok_no)"), 256).alias("digest"),
    )


@query(
    "win6_style_runs",
    f"""WITH {ATOMS}, c AS (SELECT *, tok_no > 1 AND tok_no % 6 <> 0 AS sp, CASE WHEN lag(style_key) OVER p IS DISTINCT FROM style_key THEN 1 ELSE 0 END AS ch FROM v_atoms WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
r AS (SELECT *, sum(ch) OVER p AS run_no, row_number() OVER p AS rn, lead(sp) OVER p AS nsp FROM c WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY tok_no))
SELECT doc_id, line_no, CAST(run_no AS BIGINT) AS run_no, CAST(min(rn) - 1 AS INTEGER) AS run_start, CAST(max(rn) AS INTEGER) AS run_end, style_key, string_agg(CASE WHEN tok_no % 11 = 4 THEN chr(65532) ELSE text END || CASE WHEN nsp THEN ' ' ELSE '' END, '' ORDER BY tok_no) AS run_text FROM r GROUP BY doc_id, line_no, run_no, style_key""",
)
def style_runs(spark: SparkSession, d: str) -> DataFrame:
    tok = F.col("tok_no")
    atoms = views.atoms(spark, d).withColumns(
        {"space_before": (tok > 1) & (tok % 6 != 0), "text": F.when(tok % 11 != 4, F.col("text"))}
    )
    return S.style_runs(atoms, ["doc_id", "line_no"], "tok_no", ["style_key"], "text", "space_before")


@query(
    "win6_event_runs",
    """WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER p IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM c)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, event_type, count(*) AS events FROM r GROUP BY ALL""",
)
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select("user_id", "event_id", "event_type")
    runs = S.style_runs(events, ["user_id"], "event_id", ["event_type"], None, max_group_rows=HOT_ROWS)
    length = F.col("run_end") - F.col("run_start")
    return runs.select("user_id", "run_no", "event_type", length.cast("bigint").alias("events"))


@query(
    "win7_slices",
    f"""WITH RECURSIVE {ATOMS}, o AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS n,
    tok_no - CASE WHEN tok_no % 5 = 0 THEN 1 WHEN tok_no % 7 = 0 THEN 3 ELSE 0 END AS s, tok_no + 1 - CASE WHEN tok_no % 5 = 0 THEN 1 WHEN tok_no % 7 = 0 THEN 1 WHEN tok_no % 11 = 0 THEN 2 ELSE 0 END AS e FROM v_atoms),
f AS (SELECT doc_id, line_no, n, s, e, 1 AS slice, s AS rs FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.line_no, o.n, CASE WHEN f.s = o.s AND f.e = o.e OR f.e = o.s THEN f.s ELSE o.s END, o.e, f.slice + CASE WHEN f.s = o.s AND f.e = o.e OR f.e = o.s THEN 0 ELSE 1 END, o.s
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.line_no = f.line_no AND o.n = f.n + 1)
SELECT doc_id, line_no, CAST(slice AS BIGINT) AS slice_no, CAST(min(rs) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e, count(*) AS members FROM f GROUP BY ALL""",
)
def slices(spark: SparkSession, d: str) -> DataFrame:
    tok = F.col("tok_no")
    back = F.when(tok % 5 == 0, 1).when(tok % 7 == 0, 3).otherwise(0)
    short = F.when(tok % 5 == 0, 1).when(tok % 7 == 0, 1).when(tok % 11 == 0, 2).otherwise(0)
    ranges = views.atoms(spark, d).select("doc_id", "line_no", "tok_no", (tok - back).alias("s"), (tok + 1 - short).alias("e"))
    return S.coalesce_ranges(ranges, ["doc_id", "line_no"], ["tok_no"], "s", "e")


@query(
    "win8_selections",
    f"""WITH RECURSIVE {ATOMS}, g AS (SELECT * EXCLUDE (text), CASE WHEN tok_no % 9 = 4 THEN '\ufffc' WHEN tok_no % 11 = 3 THEN '\u0301' ELSE text END AS text, tok_no % 11 = 3 AND tok_no % 9 <> 4 AS mark,
  tok_no // 6 AS op, CASE WHEN tok_no % 13 = 5 THEN 2 * tok_no - 2 ELSE 2 * tok_no END AS gs FROM v_atoms),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - 1 AS ix, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM g),
i AS (SELECT *, coalesce(max(CASE WHEN NOT mark THEN ix END) OVER (PARTITION BY doc_id, line_no ORDER BY ix), 0) AS lo,
  coalesce(min(CASE WHEN NOT mark THEN ix END) OVER (PARTITION BY doc_id, line_no ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS hi, lag(style_key) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS pk FROM h),
q AS (SELECT event_id AS req_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, CAST(user_id % 70 // 50 AS INTEGER) AS page, CAST(user_id % 70 + 1 AS INTEGER) AS line_no, k % 13 AS a, (k * 3) % 17 AS f FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
z0 AS (SELECT q.*, coalesce(l.n, 0) AS n FROM q LEFT JOIN (SELECT doc_id, page, line_no, any_value(n) AS n FROM i GROUP BY ALL) l USING (doc_id, page, line_no)),
z AS (SELECT z0.*, a < z0.n AND f < z0.n AS ok, lo.lo AS s, hi.hi AS e FROM z0 LEFT JOIN i lo ON lo.doc_id = z0.doc_id AND lo.line_no = z0.line_no AND lo.page = z0.page AND lo.ix = least(a, f) LEFT JOIN i hi ON hi.doc_id = z0.doc_id AND hi.line_no = z0.line_no AND hi.page = z0.page AND hi.ix = greatest(a, f)),
pt AS (SELECT z.req_id, z.s, z.e, i.* FROM z JOIN i ON i.doc_id = z.doc_id AND i.page = z.page AND i.line_no = z.line_no AND ix >= z.s AND ix < z.e WHERE z.ok),
sl AS (SELECT req_id, ix, op, gs AS b, gs + 2 AS e, 1 AS slices FROM pt WHERE ix = s UNION ALL
  SELECT pt.req_id, pt.ix, pt.op, CASE WHEN pt.op = sl.op AND (pt.gs = sl.e OR sl.b = pt.gs AND sl.e = pt.gs + 2) THEN sl.b ELSE pt.gs END, pt.gs + 2,
    CASE WHEN pt.op = sl.op AND (pt.gs = sl.e OR sl.b = pt.gs AND sl.e = pt.gs + 2) THEN sl.slices ELSE sl.slices + 1 END FROM sl JOIN pt ON pt.req_id = sl.req_id AND pt.ix = sl.ix + 1),
sn AS (SELECT req_id, max(slices) AS slices FROM sl GROUP BY req_id),
m AS (SELECT req_id, string_agg(CASE WHEN ix > s AND tok_no > 1 THEN ' ' ELSE '' END || text, '' ORDER BY ix) AS t, min(x) AS x, max(x + w) - min(x) AS w, 1 + count(*) FILTER (ix > s AND pk <> style_key) AS runs FROM pt GROUP BY req_id)
SELECT z.req_id, CASE WHEN ok THEN 'SELECTED' ELSE 'OUT_OF_RANGE' END AS outcome, CASE WHEN ok THEN CAST(s AS INTEGER) END AS sel_start, CASE WHEN ok THEN CAST(e AS INTEGER) END AS sel_end,
  m.t AS sel_text, CAST(m.runs AS INTEGER) AS runs, CAST(sn.slices AS INTEGER) AS slices, m.x, m.w,
  CASE WHEN ok THEN CASE WHEN line_no % 2 = 0 AND s <= 2 AND e >= 5 THEN 1 ELSE 0 END END AS decorations,
  CASE WHEN ok THEN CASE WHEN line_no % 2 = 0 AND s < 5 AND e > 2 AND NOT (s <= 2 AND e >= 5) THEN 1 ELSE 0 END END AS partial_warnings,
  CASE WHEN ok THEN CASE WHEN line_no % 5 = 0 OR line_no % 5 = 1 AND (s < 2 AND e > 1 OR s < 9 AND e > 7) THEN 1 ELSE 0 END END AS line_warnings
FROM z LEFT JOIN m USING (req_id) LEFT JOIN sn USING (req_id)""",
)
def selections(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs without text, and accents that are glyphs of their own; sources of six tokens an operator, some of them repeated."""
    # A task sorts its glyphs several times over, so it gets a quarter of the usual text.
    lines = views.lines_of(views.dealt(spark, d, 4 * views.document_parts(spark, d)))
    tok = F.col("tok_no")
    atoms = views.tokens_of(lines).withColumns(
        {
            "text": F.when(tok % 9 == 4, None).when(tok % 11 == 3, "\u0301").otherwise(F.col("text")),
            "space_before": tok > 1,
            "op_no": F.floor(tok / 6).cast("int"),
            "g_start": F.when(tok % 13 == 5, 2 * tok - 2).otherwise(2 * tok),
        }
    ).withColumn("g_end", F.col("g_start") + 2)
    k = F.get_json_object("props", "$.k").cast("int")
    requests = read_table(spark, d, "events").select(
        F.col("event_id").alias("req_id"),
        (F.col("event_id") % views.document_span(spark, d)).alias("doc_id"),
        F.floor(F.col("user_id") % 70 / views.LINES_PER_PAGE).cast("int").alias("page"),
        (F.col("user_id") % 70 + 1).cast("int").alias("line_no"),
        (k % 13).alias("anchor"),
        (k * 3 % 17).alias("focus"),
    )
    deco = lines.filter("line_no % 2 = 0").select(*LINE, F.lit(2).alias("start"), F.lit(5).alias("end"))
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 2), (7, 9))])
    warned = lines.filter("line_no % 5 < 2").select(
        *LINE, F.when(F.col("line_no") % 5 == 1, ranges).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("ranges")
    )
    out = S.select_range(atoms, requests, deco, warned)
    return out.drop("doc_id", "page", "line_no", "y", "h")


@query(
    "win9_char_ranges",
    """WITH r AS (SELECT conv_id, turn, text, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations),
s AS (SELECT *, e - length(text) AS b FROM r), c AS (SELECT *, greatest(0, 100 + conv_id - b) AS lo, least(e, 900 + conv_id * 2) - b AS hi FROM s)
SELECT conv_id, turn, CAST(b + lo AS BIGINT) AS char_start, CAST(b + hi AS BIGINT) AS char_end, substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) AS text FROM c WHERE lo < hi""",
)
def char_ranges(spark: SparkSession, d: str) -> DataFrame:
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    ranged = S.char_ranges(conv, ["conv_id"], ["turn"], "text", HOT_ROWS)
    return S.slice_runs(ranged, "text", 100 + F.col("conv_id"), 900 + F.col("conv_id") * 2)


@query(
    "win10_advance_profile",
    f"""WITH {ATOMS}, a AS (SELECT doc_id, line_no, style_key, tok_no, (coalesce(lead(x) OVER p, x + w) - x - CASE WHEN tok_no % 50 = 0 THEN 20 ELSE 0 END) / 2.0 AS adv FROM v_atoms WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY tok_no))
SELECT doc_id, line_no, round(sum(adv), 4)::DOUBLE AS total, bool_and(adv > 0) AS usable FROM a GROUP BY ALL""",
)
def advance_profile(spark: SparkSession, d: str) -> DataFrame:
    # Every fiftieth atom claims to start twenty units late; the next start is the real one.
    atoms = views.atoms(spark, d).select("doc_id", "line_no", "tok_no", "x", "w")
    late = F.when(F.col("tok_no") % 50 == 0, 20.0).otherwise(0.0)
    profile = S.advance_profile(atoms, ["doc_id", "line_no"], ["tok_no"], F.col("x"), F.col("x") + F.col("w"), F.lit(1.0))
    scaled = profile.withColumn("advance", (F.col("advance") - late) / 2.0)
    return scaled.groupBy("doc_id", "line_no").agg(
        F.round(F.sum("advance"), 4).alias("total"), F.every(F.col("advance") > 0).alias("usable")
    )


@query(
    "win10_arrivals",
    """WITH a AS (SELECT user_id, (coalesce(epoch_us(lead(ts) OVER p), epoch_us(ts) + 1000000) - epoch_us(ts)) / 1000000.0 AS adv FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS events, round(max(adv), 3)::DOUBLE AS longest, bool_and(adv > 0) AS usable FROM a GROUP BY user_id""",
)
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = read_table(spark, d, "events").select("user_id", "event_id", micros.alias("t"))
    out = S.advance_profile(
        events, ["user_id"], ["t", "event_id"], F.col("t"), F.col("t") + 1_000_000, F.lit(1_000_000.0), max_group_rows=HOT_ROWS
    )
    return out.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.max("advance"), 3).alias("longest"), F.first("usable").alias("usable")
    )


@query(
    "win11_common_prefix",
    f"""WITH {ATOMS}, a AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - 1 AS pos, text FROM v_atoms),
b AS (SELECT doc_id, line_no, pos, CASE WHEN pos = 2 + doc_id % 7 THEN text || '~' ELSE text END AS text FROM a WHERE NOT (doc_id % 5 = 1 AND pos > 20)),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.pos, b.pos) AS pos, a.text AS ta, b.text AS tb FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.pos = b.pos)
SELECT doc_id, line_no, coalesce(min(pos) FILTER (ta IS DISTINCT FROM tb), count(*)) AS prefix, count(ta) AS left_len, count(tb) AS right_len FROM j GROUP BY ALL""",
)
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = Sequence(views.atoms(spark, d).select("doc_id", "line_no", "tok_no", "text"), ["doc_id", "line_no"], ["tok_no"])
    a = rows.row_number("n").done().select("doc_id", "line_no", (F.col("n") - 1).cast("bigint").alias("pos"), "text")
    changed = F.when(F.col("pos") == 2 + F.col("doc_id") % 7, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    b = a.filter(~((F.col("doc_id") % 5 == 1) & (F.col("pos") > 20))).withColumn("text", changed)
    return S.common_prefix(a, b, ["doc_id", "line_no"], "pos", "text")


def patches_of(lines: DataFrame) -> DataFrame:
    """Patches on documents: one per third line, a broken one for some documents."""
    spans = spans_of(lines).filter("char_end > char_start")
    line, doc = F.col("line_no"), F.col("doc_id")
    good = spans.filter(line % 3 == 1).select(
        "doc_id",
        F.col("char_start").cast("int").alias("start"),
        F.least(F.col("char_end"), F.col("char_start") + 12).cast("int").alias("end"),
        F.concat(F.lit("<"), line.cast("string"), F.lit(">")).alias("replacement"),
    )
    bad = spans.filter((line == 1) & (doc % 10).isin(3, 4)).select(
        "doc_id",
        (F.col("char_start") + 1).cast("int").alias("start"),
        F.when(doc % 10 == 3, F.col("char_start") + 3).otherwise(10_000_000).cast("int").alias("end"),
        F.lit("?").alias("replacement"),
    )
    return good.unionByName(bad)


_PATCHES_SQL = f"""{SPANS}, pt AS (SELECT doc_id, char_start AS s, least(char_end, char_start + 12) AS e, '<' || line_no || '>' AS r FROM v_spans WHERE line_no % 3 = 1 AND char_end > char_start
  UNION ALL SELECT doc_id, char_start + 1, CASE WHEN doc_id % 10 = 3 THEN char_start + 3 ELSE 10000000 END, '?' FROM v_spans WHERE line_no = 1 AND char_end > char_start AND doc_id % 10 IN (3, 4)),
ck AS (SELECT pt.*, length(text) AS n, lag(e) OVER (PARTITION BY pt.doc_id ORDER BY s, e, r) AS pe FROM pt JOIN documents USING (doc_id)),
vd AS (SELECT doc_id, CASE WHEN bool_or(s < 0 OR e <= s OR e > n) THEN 'invalid-range' WHEN coalesce(bool_or(pe > s), false) THEN 'overlap' ELSE 'ok' END AS verdict FROM ck GROUP BY doc_id)"""


@query("win12_check_patches", f"WITH {_PATCHES_SQL} SELECT doc_id, verdict FROM vd")
def check_patches(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_by_id(spark, d)
    return S.check_patches(patches_of(views.lines_of(docs)), docs, ["doc_id"], "text")


@query(
    "win12_apply_patches",
    f"""WITH {_PATCHES_SQL}, pc AS (SELECT ck.doc_id, s, substr(text, CAST(coalesce(pe, 0) + 1 AS BIGINT), CAST(s - coalesce(pe, 0) AS BIGINT)) || r AS piece, e FROM ck JOIN documents USING (doc_id)),
ap AS (SELECT pc.doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS e FROM pc GROUP BY pc.doc_id)
SELECT d.doc_id, coalesce(verdict, 'untouched') AS verdict, sha256(CASE WHEN verdict = 'ok' THEN head || substr(text, CAST(e + 1 AS BIGINT)) ELSE text END) AS digest
FROM documents d LEFT JOIN vd USING (doc_id) LEFT JOIN ap USING (doc_id)""",
)
def apply_patches(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_by_id(spark, d)
    out = S.apply_patches(docs, patches_of(views.lines_of(docs)), ["doc_id"], "text")
    return out.select("doc_id", "verdict", F.sha2("patched", 256).alias("digest"))


@query(
    "win13_carry_state",
    """WITH e AS (SELECT user_id, event_id, event_type, value, ts, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER p AS v, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER p AS c, sum(b) OVER p AS seg FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pos FROM s)
SELECT user_id, event_id, v AS view_now, c AS click_now, CAST(seg AS BIGINT) AS segment, round(pos, 4)::DOUBLE AS move_pos FROM m""",
)
def carry_state(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    ops = read_table(spark, d, "events").select(
        "user_id",
        "event_id",
        "ts",
        kind,
        F.when(kind == "view", value).alias("view"),
        F.when(kind == "click", value).alias("click"),
        F.when(kind == "purchase", value).alias("move"),
    )
    out = S.carry_state(
        ops, ["user_id"], ["ts", "event_id"], ["view", "click"], F.col("event_type") == "signup", ["move"], HOT_ROWS
    )
    return out.select(
        "user_id", "event_id", "view_now", "click_now", "segment", F.round("move_pos", 4).alias("move_pos")
    )


def tag_ops(spark: SparkSession, d: str) -> DataFrame:
    """Open and close tags of pages, in order, with an attribute on some."""
    tags = F.regexp_extract_all("html", F.lit(r"(</?(?:div|p|ul|li|b|article|nav)[ >])"), F.lit(1))
    rows = read_table(spark, d, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    step = F.when(F.col("tag").startswith("</"), -1).otherwise(1)
    return rows.withColumn("step", step)


_TAGS_SQL = """tg AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(</?(?:div|p|ul|li|b|article|nav)[ >])', 1) AS t FROM pages)),
op AS (SELECT *, CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS step FROM tg)"""


@query(
    "win14_balance",
    f"""WITH {_TAGS_SQL}, dp AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM op)
SELECT page_id, CAST(max(depth) AS BIGINT) AS max_depth, CASE WHEN min(depth) < 0 THEN 'MALFORMED_INPUT' WHEN max(depth) > 12 THEN 'RESOURCE_LIMIT' WHEN sum(step) <> 0 THEN 'MALFORMED_INPUT' ELSE 'BALANCED' END AS verdict FROM dp GROUP BY page_id""",
)
def balance(spark: SparkSession, d: str) -> DataFrame:
    return S.scope_balance(tag_ops(spark, d), ["page_id"], ["pos"], F.col("step"))


@query(
    "win14_scopes",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step,
    CASE WHEN event_type = 'purchase' THEN value END AS st FROM events),
w AS (SELECT user_id, event_id, n, CASE WHEN step = 1 THEN [st, NULL] ELSE [st] END::DOUBLE[] AS stack FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN step = 1 THEN list_append(stack, NULL) WHEN step = -1 AND len(stack) > 1 THEN stack[1:len(stack) - 1]
     WHEN st IS NOT NULL THEN list_append(stack[1:len(stack) - 1], st) ELSE stack END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, CAST(len(stack) - 1 AS INTEGER) AS depth, list_filter(stack, lambda x: x IS NOT NULL)[-1] AS in_force FROM w""",
)
def scopes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    ops = read_table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    step = F.when(kind == "signup", 1).when(kind == "error", -1).otherwise(0)
    out = S.resolve_scopes(
        ops, ["user_id"], ["event_id"], step, F.when(kind == "purchase", F.col("value")), max_group_rows=HOT_ROWS
    )
    return out.select("user_id", "event_id", "depth", "in_force")


@query(
    "win15_bracket_blocks",
    f"""WITH RECURSIVE {_TAGS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY page_id) AS total FROM op),
w AS (SELECT page_id, n, total, pos, CASE WHEN step = 1 THEN [pos] ELSE []::BIGINT[] END AS stack, NULL::BIGINT AS block_open, NULL::BIGINT AS depth FROM o WHERE n = 1
  UNION ALL SELECT o.page_id, o.n, o.total, o.pos, CASE WHEN step = 1 THEN list_append(stack, o.pos) WHEN len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END,
   CASE WHEN step = -1 AND len(stack) > 0 THEN stack[-1] END, CASE WHEN step = -1 AND len(stack) > 0 THEN len(stack) END FROM w JOIN o ON o.page_id = w.page_id AND o.n = w.n + 1)
SELECT page_id, CAST(block_open AS INTEGER) AS block_open, CAST(pos AS INTEGER) AS block_close, CAST(depth AS INTEGER) AS depth FROM w WHERE block_open IS NOT NULL
UNION ALL SELECT page_id, CAST(unnest(stack) AS INTEGER), NULL, CAST(generate_subscripts(stack, 1) AS INTEGER) FROM w WHERE n = total""",
)
def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, and opens that are never closed with a null end."""
    return S.bracket_blocks(tag_ops(spark, d), ["page_id"], "pos", F.col("step"))


# Events as a drawing log of blocks of twelve: a filled rectangle, then a stroked line; some are spoiled.
@query(
    "win15_graphics",
    """WITH e AS (SELECT event_id // 12 AS b, event_id % 12 AS p, event_id, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
g AS (SELECT b, min(event_id) FILTER (p = 0) AS fo, bool_or(p = 1 AND k % 9 <> 0) AND bool_or(p = 4 AND k % 8 <> 0) AND count(*) FILTER (p <= 4) = 5 AS f_ok, max(v) FILTER (p = 2) AS w, max(1.0 + k % 5) FILTER (p = 2) AS h,
  min(event_id) FILTER (p = 5) AS so, count(*) FILTER (p >= 5) = 7 AND bool_or(p = 10 AND k % 8 <> 1) AND bool_or(p = 7 AND k % 10 <> 0) AND bool_or(p = 9 AND k % 13 <> 0) AS s_ok, max(1.0 + k % 5) FILTER (p = 7) AS sw, max(v) FILTER (p = 9) AS lx, max(k) FILTER (p = 9) AS ly FROM e GROUP BY b),
u AS (SELECT b % 7 AS stream, fo AS block_open, 'fill' AS paint, CASE WHEN w > h THEN 0 ELSE w / 2 END AS gx0, CASE WHEN w > h THEN h / 2 ELSE 0 END AS gy0, CASE WHEN w > h THEN w ELSE w / 2 END AS gx1, CASE WHEN w > h THEN h / 2 ELSE h END AS gy1, least(w, h) AS thickness FROM g WHERE f_ok AND w > 0 AND w <> h
  UNION ALL SELECT b % 7, so, 'stroke', 0, 0, lx, ly, sw FROM g WHERE s_ok AND (lx <> 0 OR ly <> 0))
SELECT stream, block_open, paint, round(gx0, 3)::DOUBLE AS gx0, round(gy0, 3)::DOUBLE AS gy0, round(gx1, 3)::DOUBLE AS gx1, round(gy1, 3)::DOUBLE AS gy1, round(thickness, 3)::DOUBLE AS thickness FROM u""",
)
def graphics(spark: SparkSession, d: str) -> DataFrame:
    k, value, place = F.get_json_object("props", "$.k").cast("int"), F.col("value"), F.col("event_id") % 12
    op = (
        F.when(place.isin(0, 5), "q")
        .when(place == 1, F.when(k % 9 == 0, "w").otherwise("rg"))
        .when(place == 2, "re")
        .when(place == 3, F.when(k % 2 == 0, "f").otherwise("f*"))
        .when(place == 4, F.when(k % 8 == 0, "x").otherwise("Q"))
        .when(place == 6, "RG")
        .when(place == 7, "w")
        .when(place == 8, "m")
        .when(place == 9, "l")
        .when(place == 10, F.when(k % 8 == 1, "f").otherwise("S"))
        .otherwise("Q")
    )
    zero, wide = F.lit(0.0), (1.0 + k % 5).cast("double")
    nums = (
        F.when(place == 2, F.array(zero, zero, value, wide))
        .when(place == 7, F.array(F.when(k % 10 == 0, 0.0).otherwise(wide)))
        .when((place == 9) & (k % 13 != 0), F.array(value, k.cast("double")))
        .otherwise(F.array(zero, zero))
    )
    ops = read_table(spark, d, "events").select(
        (F.floor(F.col("event_id") / 12) % 7).alias("stream"), F.col("event_id").alias("pos"), op.alias("op"), nums.alias("nums")
    )
    found = S.classify_blocks(ops, ["stream"], "pos", HOT_ROWS).filter("paint is not null")
    return found.select("stream", "block_open", "paint", *[F.round(c, 3).alias(c) for c in ("gx0", "gy0", "gx1", "gy1", "thickness")])


@query(
    "win16_room",
    f"""WITH {ATOMS} SELECT doc_id, line_no, round(sum(room), 3)::DOUBLE AS room, round(min(room), 3)::DOUBLE AS least_room FROM (SELECT doc_id, line_no, greatest(w, coalesce(lead(x) OVER (PARTITION BY doc_id, line_no ORDER BY x, tok_no), 200.0) - x) AS room FROM v_atoms) GROUP BY ALL""",
)
def room(spark: SparkSession, d: str) -> DataFrame:
    out = S.max_width(views.atoms(spark, d), F.lit(200.0))
    return out.groupBy("doc_id", "line_no").agg(
        F.round(F.sum("room"), 3).alias("room"), F.round(F.min("room"), 3).alias("least_room")
    )


@query(
    "win17_admission",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, floor(o_totalprice / 100) AS size,
    CAST(floor(o_totalprice / 100) AS BIGINT) % 700 AS hash, CAST(floor(o_totalprice / 100) AS BIGINT) % 700 % 10 <> 7 AS allowed FROM orders),
h AS (SELECT *, min(size) OVER (PARTITION BY hash) AS sz FROM o),
w AS (SELECT o_custkey, o_orderkey, n, []::BIGINT[] AS got, 0::DOUBLE AS total, 'start' AS outcome FROM (SELECT DISTINCT o_custkey, CAST(NULL AS BIGINT) AS o_orderkey, 0 AS n FROM h)
  UNION ALL SELECT h.o_custkey, h.o_orderkey, h.n, CASE WHEN oc = 'ADMITTED' THEN list_append(got, h.hash) ELSE got END, CASE WHEN oc = 'ADMITTED' THEN total + h.sz ELSE total END, oc
  FROM w JOIN h ON h.o_custkey = w.o_custkey AND h.n = w.n + 1,
  LATERAL (SELECT CASE WHEN h.sz <= 0 THEN 'EMPTY' WHEN h.sz > 600 THEN 'ITEM_LIMIT' WHEN list_contains(got, h.hash) THEN 'DUPLICATE' WHEN len(got) >= 4 THEN 'COUNT_LIMIT' WHEN h.sz > 1200 - total THEN 'TOTAL_LIMIT' WHEN NOT h.allowed THEN 'PROHIBITED' ELSE 'ADMITTED' END AS oc))
SELECT o_custkey, o_orderkey, outcome FROM w WHERE n > 0""",
)
def admission(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.col("o_totalprice") / 100)
    digest = cents % 700
    orders = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", digest.alias("hash"), cents.alias("raw"))
    # One content has one size, whatever order brings it.
    sizes = orders.groupBy("hash").agg(F.min("raw").cast("double").alias("size"))
    items = orders.join(sizes, "hash").withColumn("allowed", F.col("hash") % 10 != 7)
    return S.admit(items, "o_custkey", "o_orderkey", 600.0, 4, 1200.0).select("o_custkey", "o_orderkey", "outcome")


@query(
    "win18_merge_spans",
    f"""WITH {LINES}, s AS (SELECT doc_id, page, line_no, text, row_number() OVER p AS ordinal, CAST(sum(length(text)) OVER p AS BIGINT) AS e, CASE WHEN doc_id % 10 = 6 AND line_no % 50 = 3 THEN 'B' ELSE 'A' END AS font FROM v_lines WINDOW p AS (PARTITION BY doc_id, page ORDER BY line_no)),
v AS (SELECT doc_id, page, bool_and(font = 'A') AS ok FROM s GROUP BY ALL)
SELECT doc_id, page, line_no, CAST(ordinal AS INTEGER) AS ordinal, e - length(text) AS char_start, e AS char_end, CASE WHEN ok THEN 'MERGED' ELSE 'REFUSED' END AS outcome FROM s JOIN v USING (doc_id, page)""",
)
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines_of(docs_by_id(spark, d))
    font = F.when((F.col("doc_id") % 10 == 6) & (F.col("line_no") % 50 == 3), "B").otherwise("A")
    expected = lines.select(
        "doc_id", "page", ((F.col("line_no") - 1) % 50 + 1).alias("ordinal"), F.lit("A").alias("font")
    )
    merged = S.merge_spans(lines.withColumn("font", font), ["doc_id", "page"], "line_no", "text", expected)
    return merged.select(*LINE, "ordinal", "char_start", "char_end", "outcome")


_REDRAW_SQL = f"""{LINES}, s AS (SELECT doc_id, page, line_no, text, row_number() OVER p - 1 AS n, CAST(sum(length(text)) OVER p AS BIGINT) AS e, doc_id % 10 = 6 AND line_no % 50 = 3 OR doc_id % 12 = 5 AND line_no % 50 = 2 AS odd, line_no % 4 * 1.5::DOUBLE AS x, -((line_no - 1) % 50)::DOUBLE AS y FROM v_lines WINDOW p AS (PARTITION BY doc_id, page ORDER BY line_no)),
m AS (SELECT doc_id, page, count(*) AS spans, NOT bool_or(odd) AND doc_id % 7 <> 2 AND max(e) > 0 AS ok, min(x) AS x, min(y) AS y, max(x + length(text)) - min(x) AS w, max(y + 1.0) - min(y) AS h, max(e) AS glyphs FROM s GROUP BY doc_id, page)"""


@query(
    "win18_controlled",
    f"""WITH {_REDRAW_SQL} SELECT doc_id, page, CASE WHEN ok THEN 'MERGED' ELSE 'REFUSED' END AS outcome, CASE WHEN ok THEN 'redrawn ' || doc_id END AS text, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h,
  CASE WHEN ok THEN 0 END AS op_start, CASE WHEN ok THEN CAST(3 * spans + 1 AS INTEGER) END AS op_end, CASE WHEN ok THEN CAST(glyphs AS INTEGER) END AS glyphs FROM m""",
)
def controlled(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_controlled(*redraws(spark, d), ["doc_id", "page"], "line_no")[0]


@query(
    "win18_controlled_pieces",
    f"""WITH {_REDRAW_SQL} SELECT doc_id, page, CAST(n AS INTEGER) AS span_no, e - length(text) AS glyph_start, e AS glyph_end, doc_id % 3 <> 0 AND n % 4 = 0 AS underline, doc_id % 3 <> 0 AND n % 4 < 2 AS strike FROM s JOIN m USING (doc_id, page) WHERE ok""",
)
def controlled_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_controlled(*redraws(spark, d), ["doc_id", "page"], "line_no")[1]


def redraws(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines as the spans of a redraw for each page; some with another font, another operation or one span too few."""
    lines = views.lines_of(docs_by_id(spark, d))
    doc, line = F.col("doc_id"), F.col("line_no")
    spans = lines.select(
        *LINE,
        "text",
        F.when((doc % 10 == 6) & (line % 50 == 3), "B").otherwise("A").alias("font"),
        (3 * ((line - 1) % 50) + F.when((doc % 12 == 5) & (line % 50 == 2), 1).otherwise(0)).alias("op_start"),
        (line % 4 * 1.5).alias("x"),
        (-((line - 1) % 50)).cast("double").alias("y"),
        F.length("text").cast("double").alias("w"),
        F.lit(1.0).alias("h"),
    )
    size = F.count(F.lit(1)).cast("int")
    counted = lines.groupBy("doc_id", "page").agg(size.alias("_n"))
    upto = F.sequence(F.lit(0), F.col("_n") - 1)
    marks = F.array(*[F.struct(F.lit(u).alias("underline"), F.lit(k).alias("strike")) for u, k in ((True, True), (False, True))])
    stated = counted.select(
        "doc_id",
        "page",
        F.concat(F.lit("redrawn "), doc.cast("string")).alias("actual_text"),
        (3 * F.col("_n") + 1).alias("operations"),
        F.transform(F.when(doc % 7 == 2, F.concat(upto, F.array("_n"))).otherwise(upto), lambda i: 3 * i).alias("op_indexes"),
        F.transform(upto, lambda i: F.lit("A")).alias("fonts"),
        F.transform(upto, lambda i: i % 4).alias("run_indexes"),
        F.when(doc % 3 != 0, marks).alias("decorations"),
    )
    return spans, stated


@query(
    "win19_cluster_text",
    f"""WITH {ATOMS}, g AS (SELECT doc_id, line_no, tok_no, CAST(x - CASE WHEN tok_no % 3 = 2 THEN 0 ELSE 0 END AS BIGINT) AS x, last_value(CASE WHEN tok_no % 3 <> 0 OR rn = 1 THEN CAST(x AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS cl
   FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS rn FROM v_atoms)),
c AS (SELECT doc_id, line_no, cl, max(tok_no) AS lt FROM g GROUP BY ALL), n AS (SELECT *, lead(cl) OVER (PARTITION BY doc_id, line_no ORDER BY cl) AS nx FROM c),
t AS (SELECT n.doc_id, n.line_no, n.cl, lt, substr(text, cl + 1, coalesce(nx, length(text)) - cl) AS own FROM n JOIN v_lines USING (doc_id, line_no))
SELECT g.doc_id, g.line_no, sha256(string_agg(CASE WHEN g.tok_no = lt THEN own ELSE '~' END, '|' ORDER BY g.tok_no)) AS digest, count(*) FILTER (g.tok_no = lt) AS clusters FROM g JOIN t ON g.doc_id = t.doc_id AND g.line_no = t.line_no AND g.cl = t.cl GROUP BY ALL""",
)
def cluster_text(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines_of(docs_by_id(spark, d))
    keys = ["doc_id", "line_no"]
    seq = Sequence(views.tokens_of(lines).select(*keys, "tok_no", "x"), keys, ["tok_no"]).row_number("rn")
    starts = F.when((F.col("tok_no") % 3 != 0) | (F.col("rn") == 1), F.col("x").cast("bigint"))
    glyphs = seq.last_known("cluster", starts).done().select(*keys, "tok_no", "cluster")
    out = S.cluster_text(glyphs, lines, keys, "tok_no", "cluster", "text", "~")
    return out.groupBy(*keys).agg(
        F.sha2(F.expr("listagg(cluster_text, '|') WITHIN GROUP (ORDER BY tok_no)"), 256).alias("digest"),
        F.count_if(F.col("cluster_text") != "~").alias("clusters"),
    )

"""Classification and redaction queries (CLS1, CLS2, RDX1-RDX12, UDF1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphfold.catalog import query
from glyphfold.catalog.joins import docs_by_id
from glyphfold.catalog.scalars import SPACE
from glyphfold.catalog.sqlviews import ATOMS, CATALOGUE, COMMANDS, EDITS, LINES, SPANS
from glyphfold.operators import aggregates as A
from glyphfold.operators import sequences as S
from glyphfold.plans import classify as K
from glyphfold.plans import flagship as FL
from glyphfold.plans import redaction as R
from glyphfold.plans.proof import PRIME
from glyphfold.plans import views
from glyphfold.session import cut_lineage
from glyphfold.sources.corpus import read_table
from glyphfold.streaming.commands import replay_commands

_SPANS_SQL = f"""{LINES}, sp AS (SELECT doc_id, line_no, doc_id % 13 = 0 AS inh, 1 + CASE WHEN line_no % 23 = 0 THEN 1 ELSE 0 END AS refs, CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS wm,
   line_no % 29 <> 0 AS geo, CASE WHEN line_no % 37 = 0 THEN NULL ELSE text END AS text, length(text) AS len, length(text) % 19 <> 0 AS con, doc_id % 4 AS f, doc_id % 6 = 0 AND doc_id % 2 = 0 AS comp FROM v_lines),
fd AS (SELECT *, refs > 1 AS r_sh, wm <> 0 OR text IS NULL AS r_enc, NOT geo AS r_amb FROM sp),
bs AS (SELECT *, CASE WHEN wm <> 0 OR inh OR r_sh OR r_amb THEN 'readOnly' WHEN NOT con THEN 'readOnly' WHEN text IS NULL OR comp OR f >= 2 THEN 'replacementWithSubstitution' ELSE 'safeReplacement' END AS kind,
   CASE WHEN wm <> 0 OR inh OR r_sh OR r_amb THEN array_to_string(list_filter([CASE WHEN r_enc THEN 'unsupportedEncoding' END, CASE WHEN r_amb THEN 'ambiguousTransform' END, CASE WHEN r_sh THEN 'sharedResource' END, CASE WHEN inh THEN 'scannedContent' END], lambda x: x IS NOT NULL), ',')
     WHEN NOT con THEN 'unsupportedEncoding' WHEN text IS NULL THEN 'substituteFontRequired,unsupportedEncoding' WHEN comp OR f >= 2 THEN 'substituteFontRequired' ELSE 'supportedExistingFont' END AS reasons FROM fd)"""


def classified_spans(spark: SparkSession, d: str) -> DataFrame:
    doc, line = F.col("doc_id"), F.col("line_no")
    fonts = F.array(*[F.lit(n) for n in ("Helvetica", "ABCDEF+Times-Roman", "CustomSans", "abcdef+Courier")])
    spans = views.lines(spark, d).select(
        "doc_id",
        "line_no",
        F.when(doc % 13 == 0, "readOnly").otherwise("safeReplacement").alias("inherited_kind"),
        F.array(F.lit("scannedContent"), F.lit("supportedExistingFont")).alias("inherited_reasons"),
        (1 + F.when(line % 23 == 0, 1).otherwise(0)).alias("refs"),
        F.when(doc % 31 == 0, 1).otherwise(0).alias("writing_mode"),
        (line % 29 != 0).alias("sound_geometry"),
        F.when(line % 37 != 0, F.col("text")).alias("text"),
        F.length("text").alias("len"),
        (F.length("text") % 19 != 0).alias("contiguous"),
        F.element_at(fonts, (doc % 4 + 1).cast("int")).alias("font_base"),
        F.when(doc % 6 == 0, "Type0").otherwise("TrueType").alias("font_subtype"),
        (doc % 2 == 0).alias("embedded"),
    )
    return K.classify_baseline(spans)


@query("cls1_baseline", f"WITH {_SPANS_SQL} SELECT doc_id, line_no, kind, reasons FROM bs")
def baseline(spark: SparkSession, d: str) -> DataFrame:
    return classified_spans(spark, d).select(
        "doc_id", "line_no", F.col("base.kind").alias("kind"), F.array_join("base.reasons", ",").alias("reasons")
    )


@query(
    "cls2_replacement",
    f"""WITH {_SPANS_SQL}, v AS (SELECT *, CASE WHEN line_no % 41 = 0 THEN 'inf'::DOUBLE ELSE 20.0 END AS rw FROM bs)
SELECT doc_id, line_no, CASE WHEN kind = 'readOnly' OR isinf(rw) OR rw > len THEN 'readOnly' WHEN kind = 'safeReplacement' THEN 'safeReplacement' WHEN doc_id % 9 = 0 OR doc_id % 7 = 0 THEN 'readOnly' ELSE 'replacementWithSubstitution' END AS kind,
  CASE WHEN kind = 'readOnly' THEN reasons WHEN isinf(rw) THEN 'ambiguousTransform' WHEN rw > len THEN 'replacementOverflow' WHEN kind = 'safeReplacement' THEN 'supportedExistingFont' WHEN doc_id % 9 = 0 THEN 'unsupportedEncoding' WHEN doc_id % 7 = 0 THEN 'fontEmbeddingProhibited' ELSE 'substituteFontRequired' END AS reasons,
  CASE WHEN kind = 'readOnly' OR isinf(rw) OR rw > len THEN false WHEN kind = 'safeReplacement' THEN true WHEN doc_id % 9 = 0 OR doc_id % 7 = 0 THEN false ELSE doc_id % 3 <> 0 END AS can_apply FROM v""",
)
def replacement(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    edits = classified_spans(spark, d).withColumns(
        {
            **{c: F.lit(0.0) for c in ("x", "y", "rx", "ry")},
            "w": F.col("len").cast("double"),
            "h": F.lit(1.0),
            "rw": F.when(F.col("line_no") % 41 == 0, float("inf")).otherwise(20.0),
            "rh": F.lit(1.0),
            "can_encode": F.col("base.kind") == "safeReplacement",
            "has_substitute": doc % 9 != 0,
            "embeddable": doc % 7 != 0,
            "accept_substitution": doc % 3 != 0,
        }
    )
    v = K.classify_replacement(edits)
    return v.select(
        "doc_id",
        "line_no",
        F.col("verdict.kind").alias("kind"),
        F.array_join("verdict.reasons", ",").alias("reasons"),
        F.col("verdict.can_apply").alias("can_apply"),
    )


_RTL = "[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFD}\\x{FE70}-\\x{FEFC}]"
_PLAN_SQL = f"""{SPANS}, {EDITS}, gp AS (SELECT doc_id, page, text, count(*) AS n, min(line_no) AS line_no, min(char_start) AS char_start, min(char_end) AS char_end FROM v_spans GROUP BY ALL),
pl AS (SELECT e.doc_id, e.page, e.source_text, e.replacement, e.accept_substitution, n AS matches, g.line_no, g.char_start, g.char_end,
   CASE WHEN regexp_matches(source_text, '{_RTL}') THEN 'readOnly' WHEN regexp_matches(source_text, '^[\\x00-\\x7F]*$') THEN 'safeReplacement' ELSE 'replacementWithSubstitution' END AS cap_kind
  FROM v_edits e JOIN gp g ON e.doc_id = g.doc_id AND e.page = g.page AND e.source_text = g.text),
po AS (SELECT *, CASE WHEN matches > 1 THEN 'READ_ONLY_SPAN' WHEN cap_kind = 'readOnly' THEN 'READ_ONLY_SPAN' WHEN length(replacement) > length(source_text) THEN 'REPLACEMENT_OVERFLOW'
  WHEN cap_kind = 'replacementWithSubstitution' AND NOT accept_substitution THEN 'FONT_CONSENT_REQUIRED' ELSE 'PLANNED' END AS plan_outcome FROM pl)"""


@query(
    "rdx1_plan",
    f"""WITH {_PLAN_SQL} SELECT doc_id, page, plan_outcome, matches, CASE WHEN matches = 1 THEN line_no END AS line_no,
  CASE WHEN matches = 1 THEN length(replacement) <= length(source_text) END AS fits,
  CASE WHEN matches = 1 AND cap_kind = 'replacementWithSubstitution' AND NOT accept_substitution THEN 'substitution' ELSE '' END AS missing_consents, sha256(source_text) AS source_digest, CAST(1 AS INTEGER) AS next_revision,
  CASE WHEN matches = 1 THEN sha256('{{"schema":1,"revision":0,"page":' || page || ',"address":"' || line_no || ':' || char_start || ':' || char_end || '","replacement":"' || replacement || '","source":"' || sha256(source_text) ||
    '","font":"' || cap_kind || '","consents":' || CASE WHEN accept_substitution THEN '["substitution"]' ELSE '[]' END || '}}') END AS command_hash FROM po""",
)
def plan(spark: SparkSession, d: str) -> DataFrame:
    planned = R.plan_edits(views.edits(spark, d).drop("line_no"), FL.line_groups(docs_by_id(spark, d)), F.lit(0))
    return planned.select(
        "doc_id",
        "page",
        "plan_outcome",
        "matches",
        "line_no",
        "fits",
        F.array_join("missing_consents", ",").alias("missing_consents"),
        "source_digest",
        "next_revision",
        # Without one target there is no address to hash.
        F.when(F.col("matches") == 1, F.col("command_hash")).alias("command_hash"),
    )


@query(
    "rdx1_plan_fonts",
    f"""WITH {SPANS}, {EDITS}, {CATALOGUE}, fo AS (SELECT font_id, family_key, weight, italic, code_points, source_rank, font_id % 7 <> 3 AS embeddable FROM v_catalogue),
gp AS (SELECT doc_id, page, text, count(*) AS n, min(line_no) AS line_no FROM v_spans GROUP BY ALL),
e AS (SELECT e.doc_id, e.page, source_text, accept_substitution, n AS matches, line_no, ['redacted', 'removed xyz', '[REDACTED]'][doc_id % 3 + 1] AS rep, CASE WHEN doc_id % 7 = 2 THEN doc_id % 50 + 3 END AS chosen,
   CASE WHEN regexp_matches(source_text, '{_RTL}') THEN 'readOnly' WHEN regexp_matches(source_text, '^[\\x00-\\x7F]*$') THEN 'safeReplacement' ELSE 'replacementWithSubstitution' END AS base
  FROM (SELECT e.*, g.n, g.line_no AS ln FROM v_edits e JOIN gp g ON e.doc_id = g.doc_id AND e.page = g.page AND e.source_text = g.text) e),
rq AS (SELECT e.doc_id, f.font_id, f.source_rank, f.weight = o.weight AND f.italic = o.italic AS style, CASE WHEN f.weight = o.weight AND f.italic = o.italic AND f.family_key = o.family_key THEN 1 ELSE 2 END AS class
  FROM e JOIN fo o ON o.font_id = e.doc_id % 50 + 1 JOIN fo f ON list_has_all(f.code_points, list_transform(string_split(rep, ''), lambda c: unicode(c))) WHERE chosen IS NULL AND matches = 1),
best AS (SELECT doc_id, font_id, class FROM rq QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY class, NOT style, source_rank, font_id) = 1),
x AS (SELECT e.*, coalesce(chosen, b.font_id) AS font, chosen IS NOT NULL AND f.font_id IS NOT NULL AND list_has_all(f.code_points, list_transform(string_split(rep, ''), lambda c: unicode(c))) AS covers, class, coalesce(f.embeddable, false) AS embeddable
  FROM e LEFT JOIN best b USING (doc_id) LEFT JOIN fo f ON f.font_id = coalesce(chosen, b.font_id)),
y AS (SELECT *, base = 'safeReplacement' AND CASE WHEN chosen IS NOT NULL THEN covers ELSE coalesce(class = 1, false) END AS enc, CASE WHEN chosen IS NOT NULL THEN covers ELSE class IS NOT NULL END AS has_sub FROM x)
SELECT doc_id, page, CASE WHEN matches > 1 OR base = 'readOnly' THEN 'READ_ONLY_SPAN' WHEN length(rep) > length(source_text) THEN 'REPLACEMENT_OVERFLOW' WHEN enc THEN 'PLANNED' WHEN NOT has_sub THEN 'FONT_UNAVAILABLE' WHEN NOT embeddable THEN 'FONT_EMBEDDING_PROHIBITED'
   WHEN NOT accept_substitution THEN 'FONT_CONSENT_REQUIRED' ELSE 'PLANNED' END AS plan_outcome, font::BIGINT AS font_id FROM y""",
)
def plan_fonts(spark: SparkSession, d: str) -> DataFrame:
    """Plans whose replacements need a font: the source's, a chosen one or a substitute."""
    doc = F.col("doc_id")
    fonts = views.catalogue(spark, d).select(
        F.col("font_id").cast("bigint").alias("font_id"), "name_key", "family_key", "weight", "italic", "code_points", "source", "hash",
        F.lit(None).cast("string").alias("metrics"), (F.col("font_id") % 7 != 3).alias("embeddable"),
    )
    own = fonts.select((F.col("font_id") - 1).alias("_slot"), "family_key", "weight", "italic")
    groups = (
        FL.line_groups(docs_by_id(spark, d))
        .withColumn("_slot", doc % 50)
        .join(own, "_slot", "left")
        .withColumns(
            {
                "base": F.struct(F.col("cap_kind").alias("kind"), F.col("cap_reasons").alias("reasons")),
                "name_key": F.lit("absent"),
                "subfamily": F.lit(None).cast("string"),
                "dx": F.lit(1.0),
                "dy": F.lit(0.0),
                "advance": F.lit(1.0),
            }
        )
    )
    texts = F.array(F.lit("redacted"), F.lit("removed xyz"), F.lit("[REDACTED]"))
    edits = views.edits(spark, d).drop("line_no").withColumns(
        {"replacement": F.element_at(texts, (doc % 3 + 1).cast("int")), "font_id": F.when(doc % 7 == 2, doc % 50 + 3)}
    )
    return R.plan_with_fonts(edits, groups, fonts, F.lit(0)).select("doc_id", "page", "plan_outcome", "font_id")


# Each document's edit, and for some a second slice: of the same selection, stale (5 of 12) or refused at planning
# (3 of 12), or of another selection and in the way of the first (7 of 12).
_APPLY_SQL = f"""{_PLAN_SQL}, sl AS (SELECT doc_id, 0 AS slice, plan_outcome AS po, char_start AS s, char_end AS e, replacement AS r FROM po
  UNION ALL SELECT doc_id, 1, CASE doc_id % 12 WHEN 3 THEN 'REPLACEMENT_OVERFLOW' ELSE 'PLANNED' END, 0, 1, replacement FROM po WHERE plan_outcome = 'PLANNED' AND doc_id % 12 IN (3, 5, 7)),
oc AS (SELECT doc_id, slice, CASE WHEN po <> 'PLANNED' THEN po WHEN doc_id % 12 = 3 AND planned THEN 'REPLACEMENT_OVERFLOW' WHEN doc_id % 12 = 5 AND planned THEN 'STALE_REVISION' WHEN doc_id % 12 = 7 AND planned THEN 'READ_ONLY_SPAN' ELSE 'APPLIED' END AS outcome, s, e, r
  FROM (SELECT *, bool_or(slice = 0 AND po = 'PLANNED') OVER (PARTITION BY doc_id) AS planned FROM sl)),
ap AS (SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN text ELSE substr(text, 1, o.s) || o.r || substr(text, o.e + 1) END AS text FROM documents d LEFT JOIN (SELECT * FROM oc WHERE outcome = 'APPLIED') o USING (doc_id))"""


@query(
    "rdx2_apply",
    f"""WITH {_APPLY_SQL} SELECT oc.doc_id, slice, outcome, sha256(ap.text) AS text_digest FROM oc JOIN ap USING (doc_id)""",
)
def apply(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_by_id(spark, d)
    doc = F.col("doc_id")
    planned = R.plan_edits(views.edits(spark, d).drop("line_no"), FL.line_groups(docs), F.lit(0)).withColumn("slice", F.lit(0))
    first_char = docs.select("doc_id", F.sha2(F.substring("text", 1, 1), 256).alias("_first"))
    line_head = F.when(doc % 12 == 7, F.col("char_start")).otherwise(0).cast("bigint")
    second = (
        planned.filter((F.col("plan_outcome") == "PLANNED") & (doc % 12).isin(3, 5, 7))
        .join(first_char, "doc_id")
        .withColumns(
            {
                "slice": F.lit(1),
                "source_digest": F.when(doc % 12 == 7, F.sha2(F.substring("source_text", 1, 1), 256))
                .when(doc % 12 == 5, F.sha2(F.lit("gone"), 256))
                .otherwise(F.col("_first")),
                "plan_outcome": F.when(doc % 12 == 3, "REPLACEMENT_OVERFLOW").otherwise("PLANNED"),
                "char_start": line_head,
                "char_end": line_head + 1,
            }
        )
        .drop("_first")
    )
    other = (F.col("slice") == 1) & (doc % 12 == 7)
    both = planned.unionByName(second).withColumn("selection_id", F.when(other, -1 - doc).otherwise(doc))
    after, outcomes = R.apply_edits(docs, both)
    return outcomes.select("doc_id", "slice", "outcome").join(
        after.select("doc_id", F.sha2("text", 256).alias("text_digest")), "doc_id"
    )


_EVID_SQL = f"""fa AS (SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN text ELSE substr(text, 1, s.char_start) || s.replacement || substr(text, s.char_end + 1) END AS text FROM documents d LEFT JOIN (SELECT * FROM po WHERE plan_outcome = 'PLANNED') s USING (doc_id)),
ou AS (SELECT p.doc_id, coalesce(regexp_replace(string_agg(l.text, ' ' ORDER BY l.line_no) FILTER (l.line_no <> p.line_no), '{SPACE}+', '', 'g'), '') AS o FROM po p JOIN v_lines l ON l.doc_id = p.doc_id AND l.page = p.page WHERE plan_outcome = 'PLANNED' GROUP BY p.doc_id),
ev AS (SELECT p.doc_id, regexp_replace(nfc_normalize(source_text), '{SPACE}+', '', 'g') AS old, regexp_replace(nfc_normalize(replacement), '{SPACE}+', '', 'g') AS new, nfc_normalize(o) AS o FROM po p JOIN ou USING (doc_id)),
vd AS (SELECT doc_id, CASE WHEN length(old) = 0 THEN true WHEN contains(new, old) THEN true ELSE NOT contains(new, old) END AS old_absent, true AS new_present,
  CASE WHEN length(old) > 0 THEN CAST((length(o) - length(replace(o, old, ''))) // length(old) AS BIGINT) ELSE 0 END AS old_outside FROM ev)"""


@query(
    "flagship_redact_and_prove",
    f"""WITH {_PLAN_SQL}, {_EVID_SQL} SELECT fa.doc_id, sha256(fa.text) AS text_digest, po.page, CASE WHEN matches = 1 THEN po.line_no END AS line_no, CASE WHEN plan_outcome = 'PLANNED' THEN 'APPLIED' ELSE plan_outcome END AS outcome,
  old_absent, new_present, old_outside, CASE WHEN old_absent IS NOT NULL THEN true END AS outside_preserved, old_absent AND new_present AS valid FROM fa JOIN po USING (doc_id) LEFT JOIN vd USING (doc_id)""",
)
def redact_and_prove(spark: SparkSession, d: str) -> DataFrame:
    return FL.redact_and_prove(docs_by_id(spark, d), views.edits(spark, d).drop("line_no"))


@query(
    "rdx3_excise",
    f"""WITH {ATOMS}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - 1 AS ix FROM v_atoms),
k AS (SELECT doc_id, line_no, ix, text, w * 0.5 AS adv, CASE WHEN ix % 4 = 1 THEN 0.25 END AS adj, ix // 2 AS cl, 1 + doc_id % 3 AS s, 4 + doc_id % 2 AS e FROM i),
c AS (SELECT doc_id, line_no, bool_or(a AND b) AS part FROM (SELECT doc_id, line_no, cl, bool_or(ix >= s AND ix < e) AS a, bool_or(ix < s OR ix >= e) AS b FROM k GROUP BY ALL) GROUP BY ALL)
SELECT k.doc_id, k.line_no, CASE WHEN any_value(part) THEN 'expandRequired' ELSE 'preserved' END AS outcome, coalesce(string_agg(text, '' ORDER BY ix) FILTER (ix < s), '') AS prefix, coalesce(string_agg(text, '' ORDER BY ix) FILTER (ix >= s AND ix < e), '') AS removed,
  sha256(coalesce(string_agg(text, '' ORDER BY ix) FILTER (ix >= e), '')) AS suffix_digest, coalesce(sum(adv) FILTER (ix >= s AND ix < e), 0)::DOUBLE + coalesce(sum(adj) FILTER (ix > s AND ix < e), 0)::DOUBLE AS gap FROM k JOIN c USING (doc_id, line_no) GROUP BY k.doc_id, k.line_no""",
)
def excise(spark: SparkSession, d: str) -> DataFrame:
    from glyphfold.operators.ordered import Sequence

    lines = views.lines_of(docs_by_id(spark, d))
    keys = ["doc_id", "line_no"]
    rows = Sequence(views.tokens_of(lines).select(*keys, "tok_no", "text", "w"), keys, ["tok_no"]).row_number("_n").done()
    ix = F.col("_n") - 1
    atoms = rows.select(
        *keys,
        ix.alias("ix"),
        "text",
        (F.col("w") * 0.5).alias("advance"),
        F.when(ix % 4 == 1, 0.25).alias("adjust_before"),
        F.floor(ix / 2).alias("cluster"),
    )
    ranges = lines.select(
        *keys, (1 + F.col("doc_id") % 3).alias("start"), (4 + F.col("doc_id") % 2).alias("end")
    )
    out = R.excise(atoms, ranges, keys, "ix")
    return out.select(*keys, "outcome", "prefix", "removed", F.sha2("suffix", 256).alias("suffix_digest"), "gap")


# Style runs of lines as characters, edited one by one: the plain definition.
_CHARS_SQL = f"""{ATOMS}, ch AS (SELECT *, CASE WHEN lag(style_key) OVER w IS DISTINCT FROM style_key THEN 1 ELSE 0 END AS c FROM v_atoms WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS run_no FROM ch),
ru AS (SELECT doc_id, line_no, run_no, any_value(style_key) AS style_key, string_agg(text, '' ORDER BY tok_no) AS t FROM rn GROUP BY doc_id, line_no, run_no),
cs AS (SELECT doc_id, line_no, run_no, style_key, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS j FROM ru),
ps AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY run_no, j) - 1 AS p, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM cs),
ed AS (SELECT *, least(3 + doc_id % 5, n) AS s, least(CASE WHEN line_no % 4 = 0 THEN 3 + doc_id % 5 ELSE 9 + line_no % 20 END, n) AS e0 FROM ps),
eg AS (SELECT * EXCLUDE (e0), greatest(s, e0) AS e FROM ed)"""


def runs_and_edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = views.lines_of(docs_by_id(spark, d))
    atoms = views.tokens_of(lines).select("doc_id", "line_no", "tok_no", "style_key", "text")
    runs = S.style_runs(atoms, ["doc_id", "line_no"], "tok_no", ["style_key"], "text")
    runs = runs.select("doc_id", "line_no", "run_no", "style_key", F.col("run_no").alias("source_run"), "run_text")
    doc, line = F.col("doc_id"), F.col("line_no")
    edits = lines.select(
        "doc_id",
        "line_no",
        (3 + doc % 5).cast("int").alias("start"),
        F.when(line % 4 == 0, 3 + doc % 5).otherwise(9 + line % 20).cast("int").alias("end"),
        F.when(line % 7 == 0, "").otherwise("«new»").alias("inserted"),
    )
    return runs, edits


@query(
    "rdx4_replace_runs",
    f"""WITH {_CHARS_SQL}, tp AS (SELECT doc_id, line_no, arg_min(style_key, CASE WHEN p = CASE WHEN s = e AND s > 0 THEN s - 1 ELSE s END THEN 0 ELSE 1000000 - p END) AS sk, arg_min(run_no, CASE WHEN p = CASE WHEN s = e AND s > 0 THEN s - 1 ELSE s END THEN 0 ELSE 1000000 - p END) AS sr,
   any_value(s) AS s, any_value(e) AS e, any_value(n) AS n FROM eg GROUP BY ALL),
al AS (SELECT doc_id, line_no, p AS o, 0 AS part, c, style_key, run_no FROM eg WHERE p < s UNION ALL SELECT doc_id, line_no, p, 2, c, style_key, run_no FROM eg WHERE p >= e
  UNION ALL SELECT doc_id, line_no, 0, 1, CASE WHEN line_no % 7 = 0 THEN '' ELSE '«new»' END, sk, sr FROM tp WHERE line_no % 7 <> 0 OR (s = 0 AND e >= n)),
cg AS (SELECT *, CASE WHEN lag(style_key) OVER w IS DISTINCT FROM style_key OR lag(run_no) OVER w IS DISTINCT FROM run_no THEN 1 ELSE 0 END AS b FROM al WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY part, o)),
gn AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, line_no ORDER BY part, o) AS g FROM cg)
SELECT doc_id, line_no, CAST(g AS BIGINT) AS run_no, style_key, CAST(run_no AS BIGINT) AS source_run, string_agg(c, '' ORDER BY part, o) AS run_text FROM gn GROUP BY doc_id, line_no, g, style_key, run_no""",
)
def replace_runs(spark: SparkSession, d: str) -> DataFrame:
    runs, edits = runs_and_edits(spark, d)
    return R.replace_in_runs(runs, edits, ["doc_id", "line_no"], ["style_key", "source_run"])


@query(
    "rdx4_format_runs",
    f"""WITH {_CHARS_SQL}, al AS (SELECT doc_id, line_no, p, c, CASE WHEN p >= s AND p < e THEN 'bold' ELSE style_key END AS style_key FROM eg),
cg AS (SELECT *, CASE WHEN lag(style_key) OVER w IS DISTINCT FROM style_key THEN 1 ELSE 0 END AS b FROM al WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY p)),
gn AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, line_no ORDER BY p) AS g FROM cg)
SELECT doc_id, line_no, CAST(g AS BIGINT) AS run_no, style_key, string_agg(c, '' ORDER BY p) AS run_text FROM gn GROUP BY doc_id, line_no, g, style_key""",
)
def format_runs(spark: SparkSession, d: str) -> DataFrame:
    runs, edits = runs_and_edits(spark, d)
    return R.format_runs(runs.drop("source_run"), edits, ["doc_id", "line_no"], ["style_key"], {"style_key": F.lit("bold")})


@query(
    "rdx5_fit",
    f"""WITH {ATOMS}, b AS (SELECT doc_id, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, 1.0::DOUBLE AS h FROM v_atoms GROUP BY ALL),
g AS (SELECT doc_id, line_no, x AS bx, y AS by, w AS bw, x, y - 1.0 AS ry, w AS rw, h + 2.0 AS rh, x AS nx, y + CASE WHEN line_no % 6 = 0 THEN 5 ELSE 0 END AS ny, 30.0 + doc_id % 60 AS nw, 1.0 AS nh, w + 40.0 AS mw FROM b)
SELECT doc_id, line_no, nx + nw <= x + rw + 1e-6 AND ny >= ry - 1e-6 AND ny + nh <= ry + rh + 1e-6 AS fits,
  CASE WHEN line_no % 5 <> 0 AND nw > rw + 1e-6 AND nw <= mw + 1e-6 AND ny >= ry - 1e-6 AND ny + nh <= ry + rh + 1e-6 THEN least(nw, mw)::DOUBLE END AS widened FROM g""",
)
def fit(spark: SparkSession, d: str) -> DataFrame:
    box = A.union_box(views.atoms(spark, d), ["doc_id", "line_no"])
    doc, line = F.col("doc_id"), F.col("line_no")
    here = F.struct("x", "y", "w", "h")
    need = F.struct(
        F.col("x").alias("x"),
        (F.col("y") + F.when(line % 6 == 0, 5).otherwise(0)).alias("y"),
        (30.0 + doc % 60).cast("double").alias("w"),
        F.lit(1.0).alias("h"),
    )
    rows = box.select(
        "doc_id", "line_no", need.alias("need"), R.fit_region(here, F.lit(1.0), F.lit(3.0), F.lit(0.0)).alias("region"), (F.col("w") + 40.0).alias("mw")
    )
    return rows.select(
        "doc_id",
        "line_no",
        R.fits(F.col("need"), F.col("region")).alias("fits"),
        R.auto_fit(F.col("need"), F.col("region"), F.col("mw"), line % 5 != 0).alias("widened"),
    )


@query(
    "rdx6_calibrate",
    f"""WITH {ATOMS}, b AS (SELECT doc_id, line_no, max(x + w) - min(x) AS ext, sum(w * 0.48 + 0.1) AS adv FROM v_atoms GROUP BY ALL)
SELECT doc_id, line_no, round(CASE WHEN line_no % 8 = 0 OR ext <= 0 OR adv <= 0 THEN 1.0 ELSE ext / ((1.0 + doc_id % 3) * adv) END, 6)::DOUBLE AS scale FROM b""",
)
def calibrate(spark: SparkSession, d: str) -> DataFrame:
    sums = views.atoms(spark, d).groupBy("doc_id", "line_no").agg(
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("ext"), F.sum(F.col("w") * 0.48 + 0.1).alias("adv")
    )
    base = F.when(F.col("line_no") % 8 == 0, float("nan")).otherwise(1.0 + F.col("doc_id") % 3)
    return sums.select(
        "doc_id", "line_no", F.round(R.spacing_scale(F.col("ext"), base.cast("double"), F.col("adv")), 6).alias("scale")
    )


@query(
    "rdx6_profile",
    f"""WITH {LINES}, c AS (SELECT doc_id, line_no, n - 1 AS pos, c, length(text) AS len FROM (SELECT doc_id, line_no, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS n FROM v_lines WHERE text <> ''))
SELECT doc_id, line_no, count(*) AS glyphs, sum(1.0 + pos % 3)::DOUBLE AS advances FROM c WHERE pos < 3 + line_no % 9 AND pos < len AND line_no % 7 <> 0 GROUP BY doc_id, line_no""",
)
def profile(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose text changes from some place on keep the advances before it; a bad profile keeps none."""
    line = F.col("line_no")
    parts = views.document_parts(spark, d)
    lines = views.lines_of(views.dealt(spark, d, parts)).select("doc_id", "line_no", "text").filter("text <> ''")
    at = (3 + line % 9).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), at), F.lit("\u0001"), F.col("text"))

    def glyphs(text: Column) -> DataFrame:
        return lines.select("doc_id", "line_no", F.posexplode(F.split(text, "")).alias("pos", "glyph")).filter("glyph <> ''")

    advance = (1.0 + F.col("pos") % 3).cast("double")
    source = glyphs(F.col("text")).withColumn("advance", F.when((line % 7 == 0) & (F.col("pos") == 0), 0.0).otherwise(advance))
    kept = R.profile_prefix(source, glyphs(changed), ["doc_id", "line_no"], "pos", "glyph", "advance", (parts, "doc_id"))
    return kept.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("glyphs"), F.sum("advance").alias("advances"))


@query(
    "rdx7_removed",
    f"""WITH {_PLAN_SQL}, {_EVID_SQL}, al AS (SELECT doc_id, CAST((n - 1) // 50 AS INTEGER) AS page, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM fa))
SELECT e.doc_id, e.page, count(*) FILTER (contains(al.text, e.source_text) AND e.source_text <> '') AS remaining, count(*) FILTER (contains(al.text, e.source_text) AND e.source_text <> '') = 0 AS removed FROM v_edits e LEFT JOIN al ON e.doc_id = al.doc_id AND e.page = al.page GROUP BY e.doc_id, e.page""",
)
def removed(spark: SparkSession, d: str) -> DataFrame:
    docs, edits = docs_by_id(spark, d), views.edits(spark, d).drop("line_no")
    _, after, _ = FL.redact_corpus(docs, edits)
    lines = views.lines_of(after.select("doc_id", "text"))
    return R.prove_removed(lines, edits.select("doc_id", "page", "source_text"), ["doc_id", "page"], "text", "source_text").drop("source_text")


# What extraction sees; the digest is the length of a text and its characters as digits of two bases, modulo a prime; lenient evidence does not ask for equality where the new text contains the old one.
_EXTRACT_SQL = f"""WITH RECURSIVE {ATOMS}, {EDITS}, ex AS (SELECT doc_id, page, line_no, CAST(-((line_no - 1) % 50) AS DOUBLE) AS y, doc_id % 4 AS c, regexp_extract(source_text, '([^ ]+)', 1) AS old FROM v_edits),
it AS (SELECT a.doc_id, a.page, a.line_no, a.tok_no, a.text, a.x < 12.0 AND a.x + a.w > 0 AND a.y < e.y + 1.0 AND a.y + a.h > e.y AS here FROM v_atoms a JOIN ex e ON a.doc_id = e.doc_id AND a.page = e.page),
tx AS (SELECT doc_id, page, coalesce(regexp_replace(nfc_normalize(string_agg(text, '' ORDER BY line_no, tok_no) FILTER (here)), '{SPACE}+', '', 'g'), '') AS t, coalesce(regexp_replace(nfc_normalize(string_agg(text, ' ' ORDER BY line_no, tok_no) FILTER (NOT here)), '{SPACE}+', '', 'g'), '') AS o FROM it GROUP BY ALL),
jn AS (SELECT ex.*, coalesce(t, '') AS t, coalesce(o, '') AS o, regexp_replace(CASE WHEN c = 0 THEN '' ELSE old END, '{SPACE}+', '', 'g') AS od, regexp_replace(CASE WHEN c = 1 THEN '' WHEN c = 2 THEN old || '!' ELSE old END, '{SPACE}+', '', 'g') AS nw FROM ex LEFT JOIN tx USING (doc_id, page)),
jm AS (SELECT *, CASE WHEN length(od) > 0 THEN CAST((length(o) - length(replace(o, od, ''))) // length(od) AS BIGINT) ELSE 0 END AS cnt FROM jn),
p1 AS (SELECT 0::BIGINT AS n, 1::BIGINT AS a, 1::BIGINT AS b, 1::BIGINT AS c, 1::BIGINT AS d, 1::BIGINT AS e, 1::BIGINT AS f UNION ALL
  SELECT n + 1, a * 131071 % 2147483647, b * {pow(131071, 256, PRIME)} % 2147483647, c * {pow(131071, 65536, PRIME)} % 2147483647, d * 524287 % 2147483647, e * {pow(524287, 256, PRIME)} % 2147483647, f * {pow(524287, 65536, PRIME)} % 2147483647 FROM p1 WHERE n < 255),
pw AS (SELECT x.n + 256 * y.n + 65536 * z.n AS n, x.a * y.b % 2147483647 * z.c % 2147483647 AS b0, x.d * y.e % 2147483647 * z.f % 2147483647 AS b1 FROM p1 x, p1 y, (FROM p1 WHERE n < 4) z),
dg AS (SELECT doc_id, page, (sum(unicode(c) * b0 % 2147483647) % 2147483647)::BIGINT AS h0, (sum(unicode(c) * b1 % 2147483647) % 2147483647)::BIGINT AS h1 FROM (SELECT doc_id, page, unnest(string_split(o, '')) AS c, generate_subscripts(string_split(o, ''), 1) - 1 AS n FROM tx WHERE o <> '') JOIN pw USING (n) GROUP BY ALL),
jo AS (SELECT *, CASE WHEN length(od) = 0 THEN true WHEN contains(nw, od) THEN t = nw ELSE NOT contains(t, od) END AS old_absent, length(nw) = 0 OR contains(t, nw) AS new_present FROM jm)
SELECT doc_id, page, t AS target_text, old_absent, new_present, cnt AS old_outside, cnt = 0 AS outside_preserved, concat_ws(':', length(o), coalesce(h0, 0), coalesce(h1, 0)) AS outside_digest, old_absent AND new_present AND cnt = 0 AS valid FROM jo LEFT JOIN dg USING (doc_id, page)"""


@query("rdx8_extraction", _EXTRACT_SQL)
def extraction(spark: SparkSession, d: str, strict: bool = True) -> DataFrame:
    case = F.col("doc_id") % 4
    old = F.regexp_extract("source_text", "([^ ]+)", 1)
    expected = views.edits(spark, d).select(
        "doc_id",
        "page",
        F.col("doc_id").alias("exp_id"),
        F.lit(0.0).alias("x"),
        (-((F.col("line_no") - 1) % 50)).cast("double").alias("y"),
        F.lit(12.0).alias("w"),
        F.lit(1.0).alias("h"),
        F.when(case == 0, "").otherwise(old).alias("old_text"),
        F.when(case == 1, "").when(case == 2, F.concat(old, F.lit("!"))).otherwise(old).alias("new_text"),
        F.lit(0).alias("expected_outside"),
    )
    parts = views.document_parts(spark, d)
    items = views.atoms(spark, d, parts).withColumn("_ord", F.struct("line_no", "tok_no"))
    out = R.extraction_evidence(items, expected, ["doc_id", "page"], "_ord", strict, lie=(parts, "doc_id"))
    return out.drop("exp_id")


@query("rdx8_extraction_lenient", _EXTRACT_SQL.replace("WHEN contains(nw, od) THEN t = nw ELSE", "ELSE"))
def extraction_lenient(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d, strict=False)


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Before and after atoms of the corpus edit, with seeded counterfeits; the last says how they are dealt out."""
    lie = (views.document_parts(spark, d), "doc_id")
    docs, edits = views.dealt(spark, d, lie[0]), views.edits(spark, d).drop("line_no")
    _, after, outcomes = FL.redact_corpus(docs, edits)
    # Every 17th document also changes its first line; every 19th changes its page.
    forged = after.select("doc_id", "text").withColumn(
        "text", F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("Forged "), "text")).otherwise(F.col("text"))
    )
    width = F.greatest(F.length("source_text"), F.length("replacement")).cast("double")
    expected = outcomes.filter("outcome = 'APPLIED'").select(
        "doc_id",
        "page",
        F.col("doc_id").alias("exp_id"),
        F.lit(0.0).alias("x"),
        (-((F.col("line_no") - 1) % 50)).cast("double").alias("y"),
        width.alias("w"),
        F.lit(1.0).alias("h"),
        F.col("source_text").alias("old_text"),
        F.col("replacement").alias("new_text"),
        F.lit(0).alias("expected_outside"),
    )
    # One narrow row per document, read several times.
    expected = cut_lineage(expected)
    sizes = expected.select(
        "doc_id", "page", F.lit(200.0).alias("page_width"), F.lit(50.0).alias("page_height")
    )
    changed = sizes.withColumn("page_width", F.when(F.col("doc_id") % 19 == 0, 199.0).otherwise(200.0))
    before_atoms = views.tokens_of(views.lines_of(docs))
    after_atoms = views.tokens_of(views.lines_of(forged.repartition(*lie)))
    order = (F.col("line_no").cast("bigint") * 1_000_000 + F.col("tok_no")).alias("ord")
    return before_atoms.withColumn("ord", order), after_atoms.withColumn("ord", order), expected, sizes, changed, lie


@query(
    "rdx9_validate",
    f"""WITH {_PLAN_SQL}, f AS (SELECT doc_id, page, line_no, source_text, replacement, doc_id % 17 = 0 AND page = 0 AND line_no <> 1 AS fo, doc_id % 17 = 0 AND page = 0 AND line_no = 1 AS ft, doc_id % 19 = 0 AS ge FROM po WHERE plan_outcome = 'PLANNED'),
c AS (SELECT *, CASE WHEN ft THEN 'Forged' || replacement ELSE replacement END AS tgt, regexp_replace(source_text, '{SPACE}+', '', 'g') AS od FROM f)
SELECT doc_id, page, array_to_string([CASE WHEN contains(CASE WHEN ft THEN '' ELSE tgt END, od) THEN 'old-text-present' ELSE 'old-text-absent' END, 'new-text-present',
  CASE WHEN ge THEN 'page-geometry-changed' ELSE 'page-geometry-preserved' END, CASE WHEN fo THEN 'outside-text-changed-from-source' ELSE 'outside-text-identical' END,
  CASE WHEN fo AND line_no > 2 THEN 'outside-cells-changed' ELSE 'outside-cells-preserved' END], ',') AS checks, NOT ge AND NOT fo AS valid FROM c""",
)
def validate(spark: SparkSession, d: str) -> DataFrame:
    before, after, expected, sizes, changed, lie = candidates(spark, d)
    out = R.validate_candidates(before, after, expected, sizes, changed, "ord", lie=lie)
    return out.select("doc_id", "page", F.array_join("checks", ",").alias("checks"), "valid")


@query(
    "rdx9_structure",
    f"""WITH {LINES}, {EDITS} SELECT doc_id, array_to_string([CASE WHEN doc_id % 17 = 0 AND line_no <> 1 THEN 'source-streams-changed' ELSE 'source-streams-preserved' END, CASE WHEN doc_id % 11 = 3 THEN 'controlled-redraw-mismatch' ELSE 'controlled-redraw-matched' END,
  CASE WHEN doc_id % 19 = 5 THEN 'font-resources-missing' ELSE 'font-resources-present' END, CASE WHEN doc_id % 11 = 3 OR doc_id % 13 = 4 THEN 'unexpected-content-stream' ELSE 'generated-content-valid' END], ',') AS checks,
  NOT (doc_id % 17 = 0 AND line_no <> 1 OR doc_id % 11 = 3 OR doc_id % 19 = 5 OR doc_id % 13 = 4) AS valid FROM v_edits""",
)
def structure(spark: SparkSession, d: str) -> DataFrame:
    out = R.validate_structure(*structure_tables(spark, d))
    return out.select("doc_id", F.array_join("checks", ",").alias("checks"), "valid")


def structure_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Lines as streams: one is mutated and one generated; some forge a line, a mark, a font or a stream."""
    doc = F.col("doc_id")
    before = views.lines(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("stream_id"), F.col("text").alias("content"))
    own = F.sha2(doc.cast("string"), 256)
    commands = views.edits(spark, d).select(
        "doc_id",
        F.array(F.col("line_no").cast("bigint")).alias("mutated"),
        own.alias("command_hash"),
        F.array(F.lit("F1"), F.lit("F2")).alias("fonts"),
        "replacement",
    )
    forged = F.when((doc % 17 == 0) & (F.col("stream_id") == 1), F.concat(F.lit("Forged "), "content")).otherwise(F.col("content"))
    made = commands.select(
        "doc_id",
        F.lit(-1).cast("bigint").alias("stream_id"),
        F.col("replacement").alias("content"),
        F.when(doc % 11 == 3, F.sha2(F.lit("other"), 256)).otherwise(own).alias("mark"),
    )
    extra = made.filter(doc % 13 == 4).select("doc_id", F.lit(-2).cast("bigint").alias("stream_id"), "content", F.lit(None).cast("string").alias("mark"))
    after = before.withColumn("content", forged).withColumn("mark", F.lit(None).cast("string")).unionByName(made).unionByName(extra)
    fonts = commands.select("doc_id", F.explode(F.when(doc % 19 == 5, F.array(F.lit("F1"))).otherwise(F.col("fonts"))).alias("font"))
    return before, after, commands.drop("replacement"), fonts


@query(
    "rdx9_verdict",
    f"""WITH {_PLAN_SQL}, f AS (SELECT doc_id, page, line_no, source_text, replacement, doc_id % 17 = 0 AND page = 0 AND line_no <> 1 AS fo, doc_id % 17 = 0 AND page = 0 AND line_no = 1 AS ft, doc_id % 19 = 0 AS ge,
  doc_id % 17 = 0 AND line_no <> 1 AS sc, doc_id % 11 = 3 AS mm, doc_id % 19 = 5 AS fm, doc_id % 13 = 4 AS ex FROM po WHERE plan_outcome = 'PLANNED'),
c AS (SELECT *, CASE WHEN ft THEN 'Forged' || replacement ELSE replacement END AS tgt, regexp_replace(source_text, '{SPACE}+', '', 'g') AS od FROM f)
SELECT doc_id, page, array_to_string([CASE WHEN contains(CASE WHEN ft THEN '' ELSE tgt END, od) THEN 'old-text-present' ELSE 'old-text-absent' END, 'new-text-present',
  CASE WHEN ge THEN 'page-geometry-changed' ELSE 'page-geometry-preserved' END, CASE WHEN fo THEN 'outside-text-changed-from-source' ELSE 'outside-text-identical' END,
  CASE WHEN fo AND line_no > 2 THEN 'outside-cells-changed' ELSE 'outside-cells-preserved' END, CASE WHEN sc THEN 'source-streams-changed' ELSE 'source-streams-preserved' END,
  CASE WHEN mm THEN 'controlled-redraw-mismatch' ELSE 'controlled-redraw-matched' END, CASE WHEN fm THEN 'font-resources-missing' ELSE 'font-resources-present' END,
  CASE WHEN mm OR ex THEN 'unexpected-content-stream' ELSE 'generated-content-valid' END], ',') AS checks, NOT (ge OR fo OR sc OR mm OR fm OR ex) AS valid,
  NOT (ge OR fo) AND (sc OR mm OR fm OR ex) AS only_structure FROM c""",
)
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """One verdict of text, cells, geometry and structure; some candidates only their structure gives away."""
    before, after, expected, sizes, changed, lie = candidates(spark, d)
    checked = R.structure_checks(*structure_tables(spark, d))
    out = R.validate_candidates(before, after, expected, sizes, changed, "ord", structure=checked, lie=lie)
    content = F.lit(True)
    for name in R.CONTENT:
        content = content & F.col(name)
    return out.select(
        "doc_id", "page", F.array_join("checks", ",").alias("checks"), "valid", (content & ~F.col("valid")).alias("only_structure")
    )


def lenient_validator(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user's validator: what is outside the page text does not matter."""
    return pdf.assign(valid=pdf["old_absent"] & pdf["new_present"] & pdf["outside_text_ok"])


@query(
    "udf1_validator",
    f"""WITH {_PLAN_SQL} SELECT doc_id, page, NOT (doc_id % 17 = 0 AND page = 0 AND line_no <> 1) AS valid FROM po WHERE plan_outcome = 'PLANNED'""",
)
def custom_validator(spark: SparkSession, d: str) -> DataFrame:
    before, after, expected, sizes, changed, lie = candidates(spark, d)
    out = R.validate_candidates(before, after, expected, sizes, changed, "ord", validator=lenient_validator, lie=lie)
    return out.select("doc_id", "page", "valid")


@query(
    "rdx10_wrappers",
    """SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'wrapped' WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrapped' WHEN 3 THEN 'malformed' ELSE 'none' END AS state FROM conversations GROUP BY conv_id""",
)
def wrappers(spark: SparkSession, d: str) -> DataFrame:
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    case = F.col("conv_id") % 5
    ends = conv.groupBy("conv_id").agg((F.min("turn") - 1).alias("lo"), (F.max("turn") + 1).alias("hi"))
    first = ends.filter(case != 4).select(
        "conv_id", F.col("lo").alias("turn"), F.when(case == 2, "<glyphfold:1>").otherwise("<glyphfold:2>").alias("text")
    )
    last = ends.filter(case.isin(0, 2, 3)).select(
        "conv_id", F.col("hi").alias("turn"), F.when(case == 0, "</glyphfold:2>").otherwise("</glyphfold:1>").alias("text")
    )
    return R.wrapper_state(conv.unionByName(first).unionByName(last), ["conv_id"], "turn", "text")


@query(
    "rdx10_second_run",
    """SELECT doc_id, 'glyphfold:2' AS tag, sha256(text) AS text_digest FROM documents WHERE doc_id % 3 <> 0""",
)
def second_run(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    marked = R.mark(docs, "text", F.sha2(F.col("doc_id").cast("string"), 256))
    first = marked.filter("doc_id % 3 = 0").select("doc_id")
    todo = R.not_yet_marked(docs, first, ["doc_id"])
    return R.mark(todo, "text", F.sha2(F.col("doc_id").cast("string"), 256)).select(
        "doc_id", "provenance.tag", "provenance.text_digest"
    )


@query(
    "rdx11_determinism",
    """SELECT lang, source, NOT bool_or(doc_id % 100 = 7) AS same, true AS failed_unchanged FROM documents GROUP BY ALL""",
)
def determinism(spark: SparkSession, d: str) -> DataFrame:
    """Plan and apply twice, dealt in different ways; and apply a plan in which every source has changed."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    edits = views.edits(spark, d).drop("line_no")
    plan, once, _ = FL.redact_corpus(docs.repartition("doc_id"), edits)
    _, twice, _ = FL.redact_corpus(docs.repartition("source", "doc_id"), edits.repartition("page", "doc_id"))
    # A seeded difference, or agreement would prove little.
    dotted = F.when(F.col("doc_id") % 100 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    columns = ["doc_id", "text", "lang", "source"]
    same = R.prove_deterministic(once.select(*columns), twice.withColumn("text", dotted).select(*columns), ["lang", "source"])
    failed, _ = R.apply_edits(docs, plan.withColumn("source_digest", F.sha2(F.lit("changed"), 256)))
    unchanged = R.prove_deterministic(docs, failed.select(*columns), ["lang", "source"])
    return same.join(unchanged.withColumnRenamed("same", "failed_unchanged"), ["lang", "source"])


@query(
    "rdx12_replay",
    f"""WITH RECURSIVE {COMMANDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq) AS n FROM v_commands),
w AS (SELECT doc_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, 0 AS n, -1::BIGINT AS rev, false AS pend, false AS expo, 'start' AS outcome FROM (SELECT DISTINCT doc_id FROM o)
  UNION ALL SELECT o.doc_id, o.seq, o.op, o.n, CASE oc WHEN 'OPENED' THEN 0 WHEN 'CLOSED' THEN -1 WHEN 'VALIDATED' THEN rev + 1 ELSE rev END, CASE WHEN oc IN ('OPENED', 'CLOSED', 'VALIDATED') OR (oc = 'VALIDATION_FAILURE' AND o.op = 'validate') THEN false WHEN oc = 'STAGED' THEN true ELSE pend END,
    CASE WHEN oc IN ('OPENED', 'CLOSED', 'EXPORTED') THEN false WHEN oc = 'VALIDATED' THEN true ELSE expo END, oc
  FROM w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1, LATERAL (SELECT CASE WHEN o.op = 'open' THEN 'OPENED' WHEN rev < 0 OR rev <> o.expected_revision THEN 'STALE_REVISION' WHEN o.op = 'preview' THEN 'PREVIEWED' WHEN o.op = 'apply' THEN 'STAGED'
    WHEN o.op = 'validate' THEN CASE WHEN NOT pend THEN 'STALE_REVISION' WHEN o.valid THEN 'VALIDATED' ELSE 'VALIDATION_FAILURE' END WHEN o.op = 'export' THEN CASE WHEN expo THEN 'EXPORTED' ELSE 'VALIDATION_FAILURE' END ELSE 'CLOSED' END AS oc))
SELECT doc_id, seq, op, outcome, rev AS revision FROM w WHERE n > 0""",
)
def replay(spark: SparkSession, d: str) -> DataFrame:
    return replay_commands(views.commands(spark, d))

"""Text column functions (SCL1-SCL7, SCL14-SCL16, SCL18, TOP2, UDF3)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Style suffixes of font names, compounds before their parts.
STYLE_SUFFIXES = """
extrabolditalic extraboldoblique ultrabolditalic ultraboldoblique semibolditalic semiboldoblique
demibolditalic demiboldoblique extralightitalic extralightoblique ultralightitalic ultralightoblique
bolditalic boldoblique blackitalic blackoblique heavyitalic heavyoblique mediumitalic mediumoblique
regularitalic regularoblique normalitalic normaloblique lightitalic lightoblique bookitalic bookoblique
thinitalic thinoblique extrabold ultrabold semibold demibold extralight ultralight regular normal medium
italic oblique black heavy light bold book thin
""".split()

# Unicode ranges whose letters make a line right-to-left.
RTL_RANGES = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFD}\x{FE70}-\x{FEFC}]"

#: Code points of a stretch in which the end of a grapheme cluster is looked for first.
CLUSTER_STRETCH = 32

ASCII_ONLY = r"^\p{ASCII}*$"
# The white space that text comparison ignores.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
UNICODE_SPACE = SPACE_CLASS + "+"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfc(value: Column) -> Column:
    """NFC (UDF3).  Use :func:`nfc_needed` to keep ASCII rows out of Python."""
    return _nfc(value)


def nfkc(value: Column) -> Column:
    """NFKC (UDF3)."""
    return _nfkc(value)


def nfc_needed(value: Column) -> Column:
    """True where the text is not plain ASCII, i.e. may change under a normal form."""
    return ~value.rlike(ASCII_ONLY)


def without_subset_prefix(value: Column, ignore_case: bool = True) -> Column:
    return F.regexp_replace(value, r"^(?i)[A-Z]{6}\+" if ignore_case else r"^[A-Z]{6}\+", "")


def name_key(value: Column) -> Column:
    """SCL1."""
    return F.lower(F.regexp_replace(without_subset_prefix(value), r"(?U)[\s_-]+", ""))


def family_key(value: Column) -> Column:
    """SCL2: the name key less one style suffix, if something is left."""
    return F.regexp_replace(name_key(value), "^(.+?)(?:" + "|".join(STYLE_SUFFIXES) + ")$", "$1")


def parse_style(value: Column) -> Column:
    """SCL3: ``struct<weight:int, italic:boolean>`` of a style string."""
    compact = F.lower(F.regexp_replace(value, r"(?U)[\s_-]+", ""))
    weight = (
        F.when(compact.rlike("black|heavy"), 900)
        .when(compact.rlike("extrabold|ultrabold"), 800)
        .when(compact.rlike("semibold|demibold"), 600)
        .when(compact.contains("bold"), 700)
        .when(compact.contains("medium"), 500)
        .when(compact.rlike("extralight|ultralight"), 200)
        .when(compact.contains("light"), 300)
        .when(compact.contains("thin"), 100)
        .otherwise(400)
    )
    return F.struct(weight.alias("weight"), compact.rlike("italic|oblique").alias("italic"))


def infer_weight(name: Column, declared: Column) -> Column:
    """SCL4: a document font's weight; a declared value in (0, 1000] wins."""
    low = F.lower(without_subset_prefix(name, ignore_case=False))
    return (
        F.when((declared > 0) & (declared <= 1000), declared.cast("double"))
        .when(low == "unknown", F.lit(None))
        .when(low.contains("black") | low.contains("heavy"), 900.0)
        .when(low.contains("bold") | low.contains("demi"), 700.0)
        .when(low.contains("light"), 300.0)
        .otherwise(400.0)
    )


def infer_italic_angle(name: Column, declared: Column) -> Column:
    """SCL4: a document font's slant; a declared angle wins."""
    low = F.lower(without_subset_prefix(name, ignore_case=False))
    return (
        F.when(declared.isNotNull(), declared.cast("double"))
        .when(low == "unknown", F.lit(None))
        .when(low.contains("italic") | low.contains("oblique"), -12.0)
        .otherwise(0.0)
    )


def sanitise_name(compatibility_form: Column, limit: int = 96) -> Column:
    """SCL5 on text that already is NFKC (see :func:`nfkc`)."""
    bare = without_subset_prefix(compatibility_form, ignore_case=False)
    clean = F.regexp_replace(bare, r"[\x{00}-\x{1F}\x{7F}-\x{9F}\p{Cf}]", "")
    trimmed = F.regexp_replace(clean, r"(?U)^\s+|\s+$", "")
    return F.nullif(F.substring(trimmed, 1, limit), F.lit(""))


def first_usable(*candidates: Column, fallback: Column) -> Column:
    """SCL5: first candidate that survives sanitising, else the fallback."""
    return F.coalesce(*[sanitise_name(c) for c in candidates], fallback)


def strip_space(value: Column) -> Column:
    return F.regexp_replace(value, UNICODE_SPACE, "")


def searchable(value: Column, normalised: bool = False) -> Column:
    """SCL6: NFC without any white space.  ``normalised`` skips the Python step
    for text that is NFC already (ASCII text always is)."""
    # Plain ASCII goes to Python as null, so only the rest pays for the trip.
    formed = value if normalised else F.coalesce(nfc(F.when(nfc_needed(value), value)), value)
    return strip_space(formed)


def count_occurrences(hay: Column, needle: Column) -> Column:
    """SCL7: left to right, not overlapping; an empty needle never occurs."""
    removed = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("bigint")).otherwise(
        F.when(hay.isNotNull() & needle.isNotNull(), F.lit(0).cast("bigint"))
    )


def direction(value: Column) -> Column:
    """SCL14: writing direction of a text."""
    return F.when(value.rlike(r"\p{IsArabic}|\p{IsHebrew}"), "rtl").otherwise("ltr")


def contains_rtl(value: Column) -> Column:
    """SCL14: the block test that forces a line to read-only."""
    return value.rlike(RTL_RANGES)


def code_points(value: Column) -> Column:
    """SCL15: distinct code points in first-seen order."""
    return F.array_distinct(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c)))


def grapheme_list(value: Column) -> Column:
    """SCL16: the grapheme clusters of a text; offsets come from
    :func:`glyphfold.operators.sequences.graphemes`."""
    return F.regexp_extract_all(value, F.lit(r"(\X)"), F.lit(1))


def widened_start(value: Column, start: Column) -> Column:
    """SCL16: ``start`` moved back to the boundary of the cluster it falls into.

    The cluster that contains the position is the last one of the prefix that
    reaches one code point beyond it, so no list of clusters is built.
    """
    head = F.regexp_extract(F.substring(value, F.lit(1), start + 1), r"(?s)^\X*?(\X)$", 1)
    return F.when(start >= F.length(value), start).otherwise(start + 1 - F.length(head))


def widened_end(value: Column, end: Column) -> Column:
    """SCL16: ``end`` moved on to the boundary of the cluster it cuts."""
    start = widened_start(value, end - 1)

    def first_cluster(length: Column) -> Column:
        return F.regexp_extract(F.substring(value, start + 1, length), r"^(\X)", 1)

    # A cluster is a few code points; only one that fills the stretch is looked for in all that follows.
    near = first_cluster(F.lit(CLUSTER_STRETCH))
    cluster = F.when(F.length(near) < CLUSTER_STRETCH, near).otherwise(first_cluster(F.length(value)))
    return F.when(end <= 0, end).otherwise(F.greatest(end, start + F.length(cluster)))


def extract_identifier(xml: Column, prefix: str, family: str) -> Column:
    """SCL18: ``FAMILY-part[LEVEL]`` from attribute or element form."""

    def member(name: str) -> Column:
        forms = [
            rf'(?i){prefix}:{name}="([^"]+)"',
            rf"(?i){prefix}:{name}='([^']+)'",
            rf"(?i)<{prefix}:{name}>\s*([^<]+)\s*</{prefix}:{name}>",
        ]
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(xml, f, 1)), F.lit("")) for f in forms])

    part = member("part")
    return F.when(
        part.isNotNull(), F.concat(F.lit(family + "-"), part, F.coalesce(F.upper(member("conformance")), F.lit("")))
    )


def ordered_reasons(reasons: Column, order: list[str]) -> Column:
    """TOP2: the members of ``order`` that occur in ``reasons``, in that order."""
    return F.filter(F.array(*[F.lit(r) for r in order]), lambda r: F.array_contains(reasons, r))

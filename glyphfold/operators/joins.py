"""Key joins (JON2, JON5-JON10, JON12-JON14, SET1, SET2)."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphfold.functions.text import family_key, name_key, parse_style
from glyphfold.session import broadcast_if_small, cut_lineage


def resolve_unique(requests: DataFrame, targets: DataFrame, on: Seq[str], keep: Seq[str]) -> DataFrame:
    """JON2: 0 targets -> STALE_REVISION, several -> READ_ONLY_SPAN, one -> the row.

    Targets are reduced to one row per key first, so a key with very many
    targets or requests never forms their product.
    """
    single = targets.groupBy(*on).agg(
        F.count(F.lit(1)).alias("matches"), *[F.min(c).alias(f"_{c}") for c in keep]
    )
    joined = requests.join(single, list(on), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.select(
        *requests.columns,
        "matches",
        F.when(F.col("matches") == 0, "STALE_REVISION")
        .when(F.col("matches") > 1, "READ_ONLY_SPAN")
        .otherwise("RESOLVED")
        .alias("outcome"),
        *[F.when(F.col("matches") == 1, F.col(f"_{c}")).alias(c) for c in keep],
    )


# Preference of font sources.
SOURCE_ORDER = ("embedded", "local", "upload", "bundled")


def _source_rank(col: Column) -> Column:
    rank = F.lit(len(SOURCE_ORDER))
    for i, name in reversed(list(enumerate(SOURCE_ORDER))):
        rank = F.when(col == name, i).otherwise(rank)
    return rank


def _least(found: DataFrame, *by: str) -> DataFrame:
    """The lowest ``order`` of each group, and its lowest ``font_id`` (none is lower than any).

    Groups are hashed by order first: a task keeps a row for each of them and
    does not sort all that was found.
    """
    per_order = found.groupBy(*by, "order").agg(F.min("font_id").alias("font_id"), F.max(F.col("font_id").isNull()).alias("_unnamed"))
    lowest = F.struct("order", F.when(~F.col("_unnamed"), F.col("font_id")).alias("font_id"))
    return per_order.groupBy(*by).agg(F.min(lowest).alias("_m")).select(*by, "_m.order", "_m.font_id")


def resolve_requirements(reqs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """JON5: best font per requirement.

    reqs: req_id, name_key, family_key, weight, italic, code_points, hash and
    metrics (the last two nullable), and maybe subfamily (null: any will do);
    catalogue: font_id, name_key, family_key, weight, italic, code_points,
    source, hash, metrics, and maybe subfamily.  Output: req_id, kind, font_id,
    reason.  Subfamily names are compared as names are elsewhere; a style
    matches by weight, italic and subfamily.

    Exact and compatible fonts are found by equality joins.  Fonts alike in all
    that a join looks at are first reduced to their best one, and each way of
    finding a font asks once for what it looks at, so that neither many fonts
    nor many requirements of a key multiply.  A substitute depends only on
    coverage, style and source, so the catalogue is reduced to its best font
    per (coverage, weight, italic), and a coverage class is a candidate only
    through the rarest code point asked for.

    ``order`` has class, style and source as decimal digits; the lowest wins.
    """
    none = F.lit(None).cast("string")
    reqs = reqs.withColumn("sub", name_key(F.col("subfamily")) if "subfamily" in reqs.columns else none)
    reqs = reqs.withColumn("need", F.array_sort(F.array_distinct("code_points")))
    fonts = catalogue.withColumn("fsub", name_key(F.col("subfamily")) if "subfamily" in catalogue.columns else none)
    fonts = fonts.withColumn("cover", F.array_sort("code_points")).withColumn("order", _source_rank(F.col("source")))
    style = ["weight", "italic", "sub"]
    covers = F.size(F.array_except("need", "cover")) == 0
    # A requirement without a subfamily asks for the best of all of them, kept under a null.
    any_sub = F.explode(F.array_distinct(F.array(F.col("fsub"), none))).alias("sub")

    asked = reqs.select("hash", *style, "need").filter(F.col("hash").isNotNull()).distinct()
    alike = _least(fonts, "hash", "weight", "italic", "fsub", "cover").select(
        "hash", "cover", "fsub", F.col("weight").alias("fw"), F.col("italic").alias("fi"), "order", "font_id"
    )
    styled_alike = (F.col("weight") == F.col("fw")) & (F.col("italic") == F.col("fi")) & (
        F.col("sub").isNull() | F.coalesce(F.col("sub") == F.col("fsub"), F.lit(False))
    )
    by_hash = _least(
        asked.join(alike, "hash").filter(covers).withColumn("order", F.when(styled_alike, 0).otherwise(10) + F.col("order")),
        "hash",
        *style,
        "need",
    )

    def by_name(key: str) -> DataFrame:
        # Equal metrics are a class of their own; fonts of any metrics are kept under a null.
        any_metrics = F.explode(F.array_distinct(F.array(F.col("metrics"), none))).alias("m")
        subs = fonts.select(key, "weight", "italic", any_sub, "metrics", "cover", "order", "font_id")
        named = _least(subs.select(key, *style, any_metrics, "cover", "order", "font_id"), key, *style, "m", "cover")
        wanted = reqs.select(key, *style, "need", "metrics").distinct().select("*", any_metrics)
        alike = [F.col(f"q.{c}") == F.col(f"f.{c}") for c in (key, "weight", "italic")]
        alike += [F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("sub", "m")]
        met = wanted.alias("q").join(named.alias("f"), alike).select("q.*", "f.cover", "f.order", "f.font_id").filter(covers)
        return _least(met.withColumn("order", F.when(F.col("m").isNull(), 100).otherwise(0) + F.col("order")), key, *style, "need", "metrics")

    classes = _least(fonts.select("cover", "weight", "italic", any_sub, "order", "font_id"), "cover", *style)
    covers_only = classes.select("cover").distinct()
    members = covers_only.select("cover", F.explode("cover").alias("cp"))
    frequency = members.groupBy("cp").agg(F.count(F.lit(1)).alias("n"))
    needs = reqs.select("need").distinct()
    rarest = (
        needs.select("need", F.explode_outer("need").alias("cp"))
        .join(frequency, "cp", "left")
        .groupBy("need")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("cp").alias("cp"))).alias("m"))
        .select("need", F.col("m.cp").alias("cp"))
    )
    suited = rarest.filter(F.col("cp").isNotNull()).join(members, "cp").filter(covers).select("need", "cover")
    # Nothing asked for: every font will do, so one best font per style stands for all.
    any_style = _least(classes, *style).select(F.array().cast("array<int>").alias("need"), *style, "order", "font_id")
    per_need = _least(suited.join(classes, "cover"), "need", *style).unionByName(any_style)
    best_any = _least(per_need, "need").select("need", F.col("order").alias("any_order"), F.col("font_id").alias("any_id"))
    same_style = [F.col("r.need") == F.col("p.need"), *[F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("weight", "italic")]]
    styled = (
        reqs.select("need", *style)
        .distinct()
        .alias("r")
        .join(per_need.alias("p"), [*same_style, F.col("r.sub").eqNullSafe(F.col("p.sub"))], "left")
        .select("r.*", "p.order", "p.font_id")
        .join(best_any, "need")
        .select(
            "need",
            *style,
            F.coalesce(200 + F.col("order"), 210 + F.col("any_order")).alias("order"),
            F.coalesce("font_id", "any_id").alias("font_id"),
        )
    )

    answered = reqs
    ways = [
        (by_hash, ["hash", *style, "need"]),
        (by_name("name_key"), ["name_key", *style, "need", "metrics"]),
        (by_name("family_key"), ["family_key", *style, "need", "metrics"]),
        (styled, ["need", *style]),
    ]
    for way, (found, keys) in enumerate(ways):
        best = F.when(F.col("b.order").isNotNull(), F.struct("b.order", "b.font_id")).alias(f"_best{way}")
        on = [F.col(f"q.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
        answered = answered.alias("q").join(found.alias("b"), on, "left").select("q.*", best)
    none_at_all = catalogue.limit(1).count() == 0
    answered = answered.select("req_id", F.least(*[f"_best{way}" for way in range(len(ways))]).alias("best"))
    cls = F.floor(F.col("best.order") / 100)
    return answered.select(
        "req_id",
        F.when(cls == 0, "exact").when(cls == 1, "compatible-version").when(cls == 2, "substitute").otherwise(
            "unavailable"
        ).alias("kind"),
        F.col("best.font_id").alias("font_id"),
        F.when(cls == 0, "exact-font-evidence")
        .when(cls == 1, "matching-family-and-style")
        .when(cls == 2, "font-substitution-required")
        .otherwise("no-fonts-registered" if none_at_all else "missing-glyph-coverage")
        .alias("reason"),
    )


def match_tiered(reqs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """JON6: by name key, else by family key, weight and italic, else none.

    reqs: req_id, name, weight, italic; catalogue: font_id (arrival order),
    name, family, style.  First catalogue row wins in each tier.
    """
    style = parse_style(F.col("style"))
    cat = catalogue.select(
        "font_id", name_key(F.col("name")).alias("nk"), family_key(F.col("family")).alias("fk"), style.alias("st")
    )
    first_name = cat.groupBy("nk").agg(F.min("font_id").alias("by_name"))
    first_family = cat.groupBy("fk", F.col("st.weight").alias("weight"), F.col("st.italic").alias("italic")).agg(
        F.min("font_id").alias("by_family")
    )
    asked = reqs.withColumns({"nk": name_key(F.col("name")), "fk": family_key(F.col("name"))})
    joined = asked.join(first_name, "nk", "left").join(first_family, ["fk", "weight", "italic"], "left")
    return joined.select(
        "req_id",
        F.when(F.col("by_name").isNotNull(), "postscript-name")
        .when(F.col("by_family").isNotNull(), "family-style")
        .otherwise("no-exact-match")
        .alias("basis"),
        F.coalesce("by_name", "by_family").alias("font_id"),
    )


def _code_key(df: DataFrame) -> list[str]:
    """Codes of different byte lengths are different codes, where the length is known.

    A code of a length that its font never declares meets no row and has no text.
    """
    return ["font_id", *(["code_len"] if "code_len" in df.columns else []), "code"]


def _code_rows(mappings: DataFrame, max_codes: int) -> DataFrame:
    """Sound ranges as one row per code; a range over the limit is never unrolled."""
    size = F.col("last") - F.col("first") + 1
    key = [c for c in _code_key(mappings) if c != "code"]
    sound = mappings.filter((size > 0) & (size <= max_codes))
    return sound.select(*key, "ordinal", "first", "target", "targets", F.explode(F.sequence("first", "last")).alias("code"))


def code_outcomes(mappings: DataFrame, max_codes: int = 65_536) -> DataFrame:
    """JON7: font_id, outcome: ``ok``, or why the whole font is refused.

    ``inverted-range``: a range ends before it begins; ``range-limit``: one
    range is longer than the limit; ``short-list``: a range lists fewer texts
    than it has codes; ``code-limit``: more distinct codes than the limit.
    """
    size = F.col("last") - F.col("first") + 1
    ranges = mappings.groupBy("font_id").agg(
        F.bool_or(size <= 0).alias("_inverted"),
        F.bool_or(size > max_codes).alias("_long"),
        F.coalesce(F.bool_or(F.size("targets") < size), F.lit(False)).alias("_short"),
    )
    key = [c for c in _code_key(mappings) if c != "code"]
    codes = _code_rows(mappings, max_codes).select(*key, "code").distinct()
    counted = codes.groupBy("font_id").agg(F.count(F.lit(1)).alias("_codes"))
    return ranges.join(counted, "font_id", "left").select(
        "font_id",
        F.when(F.col("_inverted"), "inverted-range")
        .when(F.col("_long"), "range-limit")
        .when(F.col("_short"), "short-list")
        .when(F.col("_codes") > max_codes, "code-limit")
        .otherwise("ok")
        .alias("outcome"),
    )


def code_table(mappings: DataFrame, max_codes: int = 65_536) -> DataFrame:
    """JON7: single and range mappings as one row per code; the later mapping wins.

    mappings: font_id, [code_len,] ordinal, first, last, target (code point of
    ``first``) or targets (listed texts, nullable).  Fonts that
    :func:`code_outcomes` refuses are left out as a whole, never cut.
    """
    sound = mappings.join(code_outcomes(mappings, max_codes).filter("outcome = 'ok'"), "font_id", "left_semi")
    step = (F.col("code") - F.col("first")).cast("int")
    text = F.when(F.col("targets").isNotNull(), F.get(F.col("targets"), step)).otherwise(_code_point(F.col("target") + step))
    key = [c for c in _code_key(mappings) if c != "code"]
    return _code_rows(sound, max_codes).groupBy(*key, "code").agg(F.max_by(text, F.col("ordinal")).alias("text"))


def width_table(ranges: DataFrame) -> DataFrame:
    """JON7: widths given for ranges (font_id, [code_len,] ordinal, first, last, width) as one row per code."""
    key = [c for c in _code_key(ranges) if c != "code"]
    sound = ranges.filter(F.col("last") >= F.col("first"))
    rows = sound.select(*key, "ordinal", "width", F.explode(F.sequence("first", "last")).alias("code"))
    return rows.groupBy(*key, "code").agg(F.max_by("width", "ordinal").alias("width"))


def _code_point(value: Column) -> Column:
    """A one-character string of a code point (``chr`` covers only one byte)."""
    utf32 = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.decode(F.unhex(utf32), "UTF-32")


def decode_codes(codes: DataFrame, table: DataFrame, widths: DataFrame, default_width: float) -> DataFrame:
    """JON7: text and width per code; an unknown code gives null text."""
    return (
        codes.join(broadcast_if_small(table), _code_key(table), "left")
        .join(broadcast_if_small(widths), _code_key(widths), "left")
        .withColumn("width", F.coalesce("width", F.lit(float(default_width))))
    )


def coverage(source: DataFrame, covered: DataFrame, key: Seq[str]) -> DataFrame:
    """JON8: one row per key with status missing, unexpected, duplicated or covered.

    Both sides are counted before they meet, so duplicates cost nothing.
    """
    s = source.groupBy(*key).agg(F.count(F.lit(1)).alias("_s"))
    c = covered.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    return s.join(c, list(key), "full_outer").select(
        *key,
        F.when(F.col("_c").isNull(), "missing")
        .when(F.col("_s").isNull(), F.when(F.col("_c") > 1, "unexpected-duplicated").otherwise("unexpected"))
        .when(F.col("_c") > 1, "duplicated")
        .otherwise("covered")
        .alias("status"),
    )


def compare_positional(expected: DataFrame, actual: DataFrame, keys: Seq[str], ordinal: str, value: str) -> DataFrame:
    """JON9: expected against actual by position."""
    e = expected.select(*keys, ordinal, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*keys, ordinal, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    return e.join(a, [*keys, ordinal], "full_outer").select(
        *keys,
        ordinal,
        "expected",
        "actual",
        (F.coalesce("_e", F.lit(False)) & F.coalesce("_a", F.lit(False)) & F.col("expected").eqNullSafe(F.col("actual"))).alias(
            "valid"
        ),
    )


def positional_verdict(compared: DataFrame, keys: Seq[str], declared: DataFrame | None = None) -> DataFrame:
    """JON9: one row per key: positions, missing (expected only), unexpected, different, and the verdict on all of them.

    compared: rows of :func:`compare_positional`; declared: keys, ``positions``
    (how many there must be).  A key that was declared and never seen is invalid.
    """
    rows = compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~F.col("valid") & F.col("actual").isNull()).alias("missing"),
        F.count_if(~F.col("valid") & F.col("expected").isNull()).alias("unexpected"),
        F.count_if(~F.col("valid") & F.col("expected").isNotNull() & F.col("actual").isNotNull()).alias("different"),
    )
    sound = F.col("missing") + F.col("unexpected") + F.col("different") == 0
    if declared is None:
        return rows.withColumn("valid", sound)
    joined = rows.join(declared.select(*keys, "positions"), list(keys), "full_outer")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("compared", "missing", "unexpected", "different")}
    return joined.withColumn("valid", F.coalesce(sound & (F.col("compared") == F.col("positions")), F.lit(False))).withColumns(zero)


def snapshot_verdict(diff: DataFrame, keys: Seq[str] = ()) -> DataFrame:
    """JON10: one row (per key): how many entries have each status, unauthorised changes, and the verdict of the snapshot.

    diff: rows of :func:`diff_snapshots`.  A snapshot is valid if every entry is as it should be.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")]
    wrong = F.count_if(~F.col("ok")).alias("violations")
    return diff.groupBy(*keys).agg(*counts, wrong).withColumn("valid", F.col("violations") == 0)


def diff_snapshots(before: DataFrame, after: DataFrame, key: Seq[str], allowed: DataFrame | None = None) -> DataFrame:
    """JON10: status per key and whether the change was authorised.

    ``ok`` is false for an unlisted change and for a listed key without one.
    Contents travel as 64-hex digests, not as payloads.
    """

    def digest(df: DataFrame) -> Column:
        rest = sorted(c for c in df.columns if c not in key)
        return F.sha2(F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"}), 256)

    b = before.select(*key, digest(before).alias("_b"))
    a = after.select(*key, digest(after).alias("_a"))
    status = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(F.col("_a") == F.col("_b"), "unchanged")
        .otherwise("changed")
    )
    out = b.join(a, list(key), "full_outer").select(*key, status.alias("status"))
    if allowed is None:
        return out.withColumn("ok", F.col("status") == "unchanged")
    listed = allowed.select(*key).distinct().withColumn("_listed", F.lit(True))
    return (
        out.join(listed, list(key), "left")
        .withColumn("authorised", F.coalesce("_listed", F.lit(False)))
        .withColumn("ok", F.when(F.col("authorised"), F.col("status") == "changed").otherwise(F.col("status") == "unchanged"))
        .drop("_listed")
    )


def bind_edits(edits: DataFrame, groups: DataFrame, on: Seq[str], edit_text: str, group_text: str, keep: Seq[str]) -> DataFrame:
    """JON12: attach edits to the text groups with that exact text.

    ``elsewhere`` counts equal texts beyond the bound one.  The join key is the
    digest of the text, so long texts do not travel through the join.
    """
    g = groups.withColumn("_digest", F.sha2(group_text, 256))
    e = edits.withColumn("_digest", F.sha2(edit_text, 256))
    bound = resolve_unique(e, g, [*on, "_digest"], keep)
    return bound.withColumn("elsewhere", F.greatest(F.col("matches") - 1, F.lit(0))).drop("_digest")


def overlay_flags(atoms: DataFrame, ranges: DataFrame, on: Seq[str], index: str, flags: Seq[str]) -> DataFrame:
    """JON13: flags of the ranges that cover an atom, or-ed per atom.

    Ranges become +1/-1 steps at their ends; a running count tells which flags
    are on at an atom, so overlapping ranges cost no extra rows.
    """
    steps = ranges.select(
        *on,
        F.explode(
            F.array(
                F.struct(F.col("start").cast("bigint").alias("_i"), F.lit(1).alias("_d")),
                F.struct(F.col("end").cast("bigint").alias("_i"), F.lit(-1).alias("_d")),
            )
        ).alias("_s"),
        *flags,
    )
    per_place = steps.groupBy(*on, F.col("_s._i").alias("_i")).agg(
        *[F.sum(F.when(F.col(f), F.col("_s._d")).otherwise(0)).alias(f"_{f}") for f in flags]
    )
    merged = atoms.withColumn("_i", F.col(index).cast("bigint")).withColumn("_atom", F.lit(1)).unionByName(
        per_place.withColumn("_atom", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*on).orderBy("_i", "_atom").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.select(
            *atoms.columns, "_atom", *[(F.coalesce(F.sum(f"_{f}").over(w), F.lit(0)) > 0).alias(f) for f in flags]
        )
        .filter("_atom = 1")
        .drop("_atom")
    )


def last_changes(changes: DataFrame, key: Seq[str], order: Seq[str] = ()) -> DataFrame:
    """One row per key of ``changes``: the last by ``order``; without an order repeated keys must be equal rows.

    A maximum combines map-side, so very many changes of one key cost one row per task.
    """
    rest = [c for c in changes.columns if c not in key]
    if not rest:
        return changes.distinct()
    # Rows that are equal by the order are told apart by their content, so that the result is one and the same.
    last = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])).alias("_last")
    return changes.groupBy(*key).agg(last).select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in changes.columns])


def upsert(base: DataFrame, changes: DataFrame, key: Seq[str], order: Seq[str] = ()) -> DataFrame:
    """JON14: rows of ``changes`` replace rows of ``base`` with the same key; the last change of a key wins.

    Null keys are keys like others.  ``order`` names columns of ``changes``; those that ``base`` lacks are left out.
    """
    final = last_changes(changes, key, order).select(*base.columns)
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    return base.alias("b").join(final.select(*key).alias("c"), same, "left_anti").unionByName(final)


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, key: Seq[str], partition: str, order: Seq[str] = ()) -> DataFrame:
    """JON14 on a Parquet table partitioned by ``partition``: only partitions that change are written again.

    Those are where a changed key is now or will be.  Their new content is
    written aside (a reliable checkpoint) before it replaces them, so a job that
    fails before that leaves the table as it was.  Returns the touched partitions.
    """
    base = spark.read.parquet(path)
    final = cut_lineage(last_changes(changes, key, order).select(*base.columns))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    held = base.alias("b").join(final.select(*key).alias("c"), same, "left_semi").select(partition)
    touched = cut_lineage(held.unionByName(final.select(partition)).distinct())
    inside = F.col(f"b.{partition}").eqNullSafe(F.col(f"t.{partition}"))
    affected = base.alias("b").join(broadcast_if_small(touched).alias("t"), inside, "left_semi")
    content = cut_lineage(upsert(affected, final, key))
    writer = content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)
    # A partition that lost its last row to another one has nothing that could replace it.
    emptied = touched.join(content.select(F.col(partition).alias("_p")).distinct(), F.col(partition).eqNullSafe(F.col("_p")), "left_anti")
    for row in emptied.collect():  # partitions, not rows
        _drop_partition(spark, path, partition, row[partition])
    return touched


def _drop_partition(spark: SparkSession, path: str, partition: str, value: object) -> None:
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def union_all(*frames: DataFrame) -> DataFrame:
    """SET1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_difference(left: DataFrame, right: DataFrame, key: Seq[str]) -> DataFrame:
    """SET2: distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*key).distinct().join(right.select(*key), list(key), "left_anti")


def set_relation(left: DataFrame, right: DataFrame, key: Seq[str]) -> DataFrame:
    """SET2: one row with counts, equality and subset verdicts of two key sets."""
    l = left.select(*key).distinct().withColumn("_l", F.lit(1))
    r = right.select(*key).distinct().withColumn("_r", F.lit(1))
    both = l.join(r, list(key), "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    ).select(
        "*",
        (F.col("only_left") + F.col("only_right") == 0).alias("equal"),
        (F.col("only_left") == 0).alias("left_in_right"),
    )

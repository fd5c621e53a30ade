"""Aggregations (AGG1-AGG14, TOP1)."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphfold.functions.text import ordered_reasons
from glyphfold.operators.ordered import HOT_ROWS, Sequence
from glyphfold.session import broadcast_if_small, cut_lineage

# Capability reasons in their presentation order.
REASON_ORDER = [
    "supportedExistingFont",
    "substituteFontRequired",
    "replacementOverflow",
    "unsupportedEncoding",
    "ambiguousTransform",
    "sharedResource",
    "outlinedText",
    "scannedContent",
    "fontEmbeddingProhibited",
    "unsupportedOperator",
    "malformedContent",
]
# Capability kinds from best to worst.
KINDS = ["safeReplacement", "replacementWithSubstitution", "readOnly"]


def reference_counts(edges: DataFrame, owner: str, slot: str, target: str) -> DataFrame:
    """AGG1: refs per object, each (owner, slot) counted once; more than one = shared."""
    return (
        edges.dropDuplicates([owner, slot])
        .groupBy(target)
        .agg(F.count(F.lit(1)).alias("refs"))
        .withColumn("shared", F.col("refs") > 1)
    )


def resource_usage(streams: DataFrame, doc: str, size: Column, depth: Column, file_bytes: Column) -> DataFrame:
    """AGG2: per document file bytes, objects, nesting, peak and total decoded bytes."""
    return streams.groupBy(doc).agg(
        F.max(file_bytes).alias("file_bytes"),
        F.count(F.lit(1)).alias("objects"),
        F.max(depth).alias("max_depth"),
        F.max(size).alias("peak_bytes"),
        F.sum(size).alias("total_bytes"),
    )


def _walk(starts: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """start, node, depth, path, status of every path from each start.

    What follows a node within the depth that is left does not depend on how it
    was reached.  So the nodes that can be met at each depth are found first, and
    then paths from the last to the first: a node's are those of the nodes behind
    it, each once, however many starts share them.
    """
    met = [cut_lineage(starts.select("start"))]
    ahead = []
    for _ in range(max_depth + 1):
        step = links.join(broadcast_if_small(met[-1]), F.col("node") == F.col("start"), "left_semi")
        step = cut_lineage(step)
        if step.isEmpty():
            break
        ahead.append(step)
        met.append(cut_lineage(step.select(F.col("_next").alias("start")).distinct()))

    def alone(level: int) -> DataFrame:
        status = F.lit("OK" if level <= max_depth else "RESOURCE_LIMIT")
        return met[level].select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), status.alias("status"))

    paths = alone(len(met) - 1)
    for level in reversed(range(len(ahead))):
        behind = cut_lineage(paths.withColumnRenamed("start", "_from"))
        back = F.array_position("path", F.col("start"))
        joined = ahead[level].withColumnRenamed("node", "start").join(broadcast_if_small(behind), F.col("_next").eqNullSafe(F.col("_from")))
        # A path that comes back to its start ends there.
        longer = joined.filter((back == 0) | (back == F.size("path"))).select(
            "start",
            "node",
            (F.col("depth") + 1).alias("depth"),
            F.concat(F.array("start"), F.col("path")).alias("path"),
            F.when(back > 0, "MALFORMED_INPUT").otherwise(F.col("status")).alias("status"),
        )
        paths = alone(level).unionByName(longer)
    return paths


def walk_resources(roots: DataFrame, edges: DataFrame, max_depth: int = 12) -> DataFrame:
    """AGG3: one row per path from each root: root, node, depth, path, status.

    What follows a root's first step does not depend on the root, so the walk
    starts once from each node that roots lead to (and, behind these, once from
    each node of a level), and the roots are joined to these continuations at the
    end: levels grow with the resources, not with the roots that use them.  A node met again on its own path is MALFORMED_INPUT, a
    path beyond the limit is RESOURCE_LIMIT; both end there.  A continuation that
    comes back to the root ends where it does.  Levels are checkpointed reliably.
    """
    # Written once; behind the first step only links of nodes that something leads to are read, once a level.
    links = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")))
    firsts = roots.join(links, roots["root"] == links["node"]).select("root", F.col("_next").alias("start"))
    led_to = links.select(F.col("_next").alias("_to")).distinct()
    inner = cut_lineage(links.join(led_to, F.col("node") == F.col("_to"), "left_semi"))
    onward = cut_lineage(_walk(firsts.select("start").distinct(), inner, max_depth - 1))
    back = F.array_position("path", F.col("root"))
    joined = firsts.join(onward, "start").filter((back == 0) | (back == F.size("path")))
    paths = joined.select(
        "root",
        "node",
        (F.col("depth") + 1).alias("depth"),
        F.concat(F.array("root"), F.col("path")).alias("path"),
        F.when(back > 0, "MALFORMED_INPUT").otherwise(F.col("status")).alias("status"),
    )
    itself = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit("OK").alias("status"))
    return itself.unionByName(paths)


def inventory(resources: DataFrame, doc: str, key: Column, name: Column, ordinal: Column, reason: Column) -> DataFrame:
    """AGG4: one row per document and equivalent name: first name, most urgent reason."""
    order = ["not-embedded", "embedded-not-reusable", "standard-font"]
    priority = F.when(reason == order[0], 0).when(reason == order[1], 1).otherwise(2)
    agg = resources.groupBy(doc, key.alias("key")).agg(F.min_by(name, ordinal).alias("name"), F.min(priority).alias("_p"))
    return agg.select(doc, "key", "name", F.element_at(F.array(*[F.lit(r) for r in order]), F.col("_p") + 1).alias("reason"))


def union_box(df: DataFrame, keys: Seq[str]) -> DataFrame:
    """AGG5."""
    box = df.groupBy(*keys).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("_r"),
        F.max(F.col("y") + F.col("h")).alias("_t"),
    )
    return box.select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_t") - F.col("y")).alias("h"))


def _ranked_counts(df: DataFrame, keys: Seq[str], value: Column, max_group_rows: int) -> DataFrame:
    """Distinct values with cumulative counts; equal values are merged before any sort."""
    counts = df.select(*keys, value.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = Sequence(counts, keys, ["_v"], max_group_rows).running_sum("_cum", F.col("_n"))
    return ranked.total("_total", F.col("_n")).done()


def exact_quantiles(
    df: DataFrame, keys: Seq[str], value: Column, quantiles: dict[str, float], max_group_rows: int = HOT_ROWS
) -> DataFrame:
    """AGG7: nearest-rank percentiles (element at ceil(q*n)-1), exact for groups of any size.

    ``keys`` may not be empty; add a constant column for the whole frame.
    """
    ranked = _ranked_counts(df, keys, value, max_group_rows)
    picks = [
        F.min(F.when(F.col("_cum") >= F.greatest(F.ceil(F.col("_total") * q), F.lit(1)), F.col("_v"))).alias(name)
        for name, q in quantiles.items()
    ]
    return ranked.groupBy(*keys).agg(*picks)


def exact_median(df: DataFrame, keys: Seq[str], value: Column, out: str = "median", max_group_rows: int = HOT_ROWS) -> DataFrame:
    """AGG6: middle value, mean of the two middles for even counts."""
    ranked = _ranked_counts(df, keys, value, max_group_rows)
    lower = F.floor((F.col("_total") + 1) / 2)
    upper = F.floor(F.col("_total") / 2) + 1
    return ranked.groupBy(*keys).agg(
        (
            (F.min(F.when(F.col("_cum") >= lower, F.col("_v"))) + F.min(F.when(F.col("_cum") >= upper, F.col("_v")))) / 2
        ).alias(out)
    )


def derive_thresholds(
    samples: DataFrame, consumer: str, m1: float = 1e-6, m2: float = 1e-6, max_group_rows: int = HOT_ROWS
) -> DataFrame:
    """AGG8: samples: consumer, accepted, mismatch, similarity -> thresholds per consumer."""
    if m1 <= 0 or m2 <= 0:
        raise ValueError("threshold margins must be positive")
    good = samples.filter("accepted")
    keys = [consumer]
    extremes = samples.groupBy(consumer).agg(
        F.max(F.when(F.col("accepted"), F.col("mismatch"))).alias("max_mismatch"),
        F.min(F.when(F.col("accepted"), F.col("similarity"))).alias("min_similarity"),
        F.min(F.when(~F.col("accepted"), F.col("mismatch"))).alias("_least_mismatch"),
        F.max(F.when(~F.col("accepted"), F.col("similarity"))).alias("_best_similarity"),
    )
    mis = exact_quantiles(good, keys, F.col("mismatch"), {"p99_mismatch": 0.99, "median_mismatch": 0.5}, max_group_rows)
    sim = exact_quantiles(good, keys, F.col("similarity"), {"p01_similarity": 0.01, "median_similarity": 0.5}, max_group_rows)
    out = extremes.join(mis, keys, "left").join(sim, keys, "left")
    # Every perturbed sample lies beyond a threshold when the nearest one does.
    separates = (F.col("_least_mismatch") > F.col("mismatch_threshold")) & (
        F.col("_best_similarity") < F.col("similarity_threshold")
    )
    return (
        out.withColumn("mismatch_threshold", F.col("max_mismatch") + m1)
        .withColumn("similarity_threshold", F.col("min_similarity") - m2)
        .withColumn("separates", F.coalesce(separates, F.lit(False)))
        .drop("_least_mismatch", "_best_similarity")
    )


def ssim(df: DataFrame, keys: Seq[str], a: Column, b: Column) -> DataFrame:
    """AGG9: structural similarity of two aligned series, clipped to [-1, 1]."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    stats = df.groupBy(*keys).agg(
        F.avg(a).alias("ma"),
        F.avg(b).alias("mb"),
        F.coalesce(F.var_samp(a), F.lit(0.0)).alias("va"),
        F.coalesce(F.var_samp(b), F.lit(0.0)).alias("vb"),
        F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias("cov"),
    )
    ma, mb = F.col("ma"), F.col("mb")
    score = ((2 * ma * mb + c1) * (2 * F.col("cov") + c2)) / (
        (ma * ma + mb * mb + c1) * (F.col("va") + F.col("vb") + c2)
    )
    return stats.select(*keys, F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), F.lit(1.0)).alias("ssim"))


def masked_diff(before: DataFrame, after: DataFrame, keys: Seq[str], cell: Seq[str], value: str, mask: DataFrame) -> DataFrame:
    """AGG10: cells that differ inside and outside an edit rectangle per key.

    mask: keys, x0, y0, x1, y1 (half open).  Shapes (cell sets) that are not
    equal count every cell as different; ``*_raw`` are the plain counts.
    """
    a = before.select(*keys, *cell, F.struct(F.col(value).alias("v")).alias("_a"))
    b = after.select(*keys, *cell, F.struct(F.col(value).alias("v")).alias("_b"))
    # Masks come to the cells before these meet: what a full join gives lies nowhere in particular, and only sums leave it.
    box = ["x0", "y0", "x1", "y1"]
    masks = mask.groupBy(*keys).agg(F.collect_list(F.struct(*box)).alias("_m"))
    met = a.join(masks, list(keys), "left").join(b.join(masks.withColumnRenamed("_m", "_n"), list(keys), "left"), [*keys, *cell], "full_outer")
    joined = met.withColumn("_m", F.explode_outer(F.coalesce("_m", "_n"))).select(*keys, *cell, "_a", "_b", "_m.*")
    cx, cy = (F.col(c) for c in cell)
    inside = F.coalesce(
        (cx >= F.col("x0")) & (cx < F.col("x1")) & (cy >= F.col("y0")) & (cy < F.col("y1")), F.lit(False)
    )
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    stats = joined.groupBy(*keys).agg(
        F.count_if(inside).alias("inside_cells"),
        F.count_if(~inside).alias("outside_cells"),
        F.count_if(inside & differs).alias("_in"),
        F.count_if(~inside & differs).alias("_out"),
        F.count("_a").alias("before_cells"),
        F.count("_b").alias("after_cells"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_odd"),
    )
    same_shape = F.col("_odd") == 0
    return stats.select(
        *keys,
        same_shape.alias("same_shape"),
        F.when(same_shape, F.col("_in")).otherwise(F.col("inside_cells")).alias("inside_diff"),
        F.when(same_shape, F.col("_out")).otherwise(F.col("outside_cells")).alias("outside_diff"),
        "inside_cells",
        "outside_cells",
        F.col("_in").alias("inside_raw"),
        F.col("_out").alias("outside_raw"),
    )


def severity(kind: Column) -> Column:
    return F.when(kind == KINDS[2], 2).when(kind == KINDS[1], 1).otherwise(0)


def rollup_capability(spans: DataFrame, by: Seq[str], forced: Column | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """AGG11: worst kind over members and the union of their reasons, in order.

    spans: by, kind, reasons (array), mode.  ``forced`` (array of reasons, may
    be empty) makes a group read-only.  A set of at most eleven reasons is all
    that is gathered per group, and ``also``: further aggregates of the members, by name.
    """
    empty = F.array().cast("array<string>")
    clipped = F.col("mode") >= 4
    rows = spans.withColumn(
        "_r",
        F.array_union(
            F.array_union(F.coalesce("reasons", empty), F.when(clipped, F.array(F.lit("unsupportedOperator"))).otherwise(empty)),
            empty if forced is None else F.coalesce(forced, empty),
        ),
    ).withColumn(
        "_s",
        F.greatest(
            severity(F.col("kind")),
            F.when(clipped, 2).otherwise(0),
            F.lit(0) if forced is None else F.when(F.size(F.coalesce(forced, empty)) > 0, 2).otherwise(0),
        ),
    )
    # One flag per reason: a fixed-width aggregate instead of a collected list.
    agg = rows.groupBy(*by).agg(
        F.max("_s").alias("_s"),
        *[F.bool_or(F.array_contains("_r", F.lit(r))).alias(f"_has_{i}") for i, r in enumerate(REASON_ORDER)],
        *[value.alias(name) for name, value in (also or {}).items()],
    )
    positive = {"supportedExistingFont", "substituteFontRequired"}
    chosen = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_has_{i}") & ((F.col("_s") < 2) if r in positive else F.lit(True)), r)
                for i, r in enumerate(REASON_ORDER)
            ]
        )
    )
    default = F.array(F.lit("supportedExistingFont"))
    return agg.select(
        *by,
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_s") + 1).alias("kind"),
        F.when((F.col("_s") == 0) & (F.size(chosen) == 0), default).otherwise(chosen).alias("reasons"),
        *(also or {}),
    )


def _met(runs: DataFrame, ranges: DataFrame, keys: Seq[str], carry: dict[str, Column], everything_if_empty_after_clamp: bool) -> DataFrame:
    """keys, req_id, ``_met``: of each range the runs from the one that holds its start to the one that holds its end, in order.

    ``_met`` is null where either end lies in no run.  ranges: keys, req_id, start,
    end, cut to the length of the line.  The runs of a line are gathered once,
    into one row with its length, and each range meets that row: runs are worked
    out once however they were made, and no request x run pairs are formed.
    """
    run = F.struct("char_start", "char_end", *[value.alias(name) for name, value in carry.items()])
    whole = runs.groupBy(*keys).agg(
        F.max("char_end").cast("bigint").alias("_len"),
        F.array_sort(F.collect_list(F.when(F.col("char_end") > F.col("char_start"), run))).alias("_runs"),
    )
    asked = ranges.select(*keys, "req_id", "start", "end").join(whole, list(keys), "left")
    none = F.lit(0).cast("bigint")
    size = F.coalesce("_len", none)
    asked = asked.withColumns({"_len": size, "_lo": F.greatest(none, F.least("start", size))}).withColumn(
        "_hi", F.greatest("_lo", F.least("end", "_len"))
    )
    everything = (F.col("_lo") == F.col("_hi")) if everything_if_empty_after_clamp else (F.col("start") == F.col("end"))
    asked = asked.withColumns({"_lo": F.when(everything, none).otherwise(F.col("_lo")), "_last": F.when(everything, F.col("_len")).otherwise(F.col("_hi")) - 1})

    def holding(point: str) -> Column:
        """The start of the first run that holds the point."""
        return F.get(F.filter("_runs", lambda r: (r["char_start"] <= F.col(point)) & (F.col(point) < r["char_end"])), F.lit(0))["char_start"]

    # A request without an id has no place to keep what it meets.
    ends = asked.filter("req_id is not null").withColumns({"_f": holding("_lo"), "_l": holding("_last")})
    between = F.filter(
        "_runs", lambda r: (r["char_start"] >= F.least("_f", "_l")) & (r["char_start"] <= F.greatest("_f", "_l"))
    )
    met = ends.select(*keys, "req_id", "_f", "_l", F.when(F.col("_f").isNotNull() & F.col("_l").isNotNull(), between).alias("_met"))
    unnamed = asked.filter("req_id is null").select(*keys, "req_id")
    return met.unionByName(unnamed, allowMissingColumns=True)


def format_state(runs: DataFrame, ranges: DataFrame, keys: Seq[str]) -> DataFrame:
    """AGG12: off/on/mixed for bold, italic, underline, strike over the runs that meet a range.

    runs: keys, char_start, char_end, weight, angle, underline, strike;
    ranges: keys, req_id, start, end (an empty range asks for everything).
    """
    tests = {
        "bold": F.coalesce("weight", F.lit(400)) >= 600,
        "italic": F.coalesce(F.col("angle"), F.lit(0.0)) != 0,
        "underline": F.col("underline"),
        "strike": F.col("strike"),
    }
    met = _met(runs, ranges, keys, {f"is_{n}": F.coalesce(test, F.lit(False)) for n, test in tests.items()}, True)

    def state(name: str) -> Column:
        on = F.filter("_met", lambda r: r[f"is_{name}"])
        return F.when(F.size(on) == 0, "off").when(F.size(on) == F.size("_met"), "on").otherwise("mixed").alias(name)

    return met.filter("_met is not null").select(*keys, "req_id", *[state(n) for n in tests])


def uniform_requirement(runs: DataFrame, ranges: DataFrame, keys: Seq[str]) -> DataFrame:
    """AGG13: ready / mixed / empty: do the runs in a range ask for one font.

    runs: keys, char_start, char_end, name_key, family, weight, italic.
    """
    req = F.struct("name_key", "family", "weight", "italic")
    met = _met(runs, ranges, keys, {"req": req}, False)
    first = F.filter("_met", lambda r: r["char_start"] == F.col("_f"))[0]["req"]
    same = F.forall("_met", lambda r: r["req"].eqNullSafe(first))
    return met.select(
        *keys,
        "req_id",
        F.when(F.col("_met").isNull(), "empty").when(same, "ready").otherwise("mixed").alias("kind"),
        F.when(same, first["name_key"]).alias("name_key"),
    )


def page_text(spans: DataFrame, keys: Seq[str], order: str, text: str, sep: str = "") -> DataFrame:
    """AGG14: ordered text per page (bounded by the page)."""
    return spans.groupBy(*keys).agg(F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias("page_text"))


def distinct_sizes(spans: DataFrame, keys: Seq[str], size: Column) -> DataFrame:
    """AGG14: sorted distinct sizes; distinct is taken before anything is gathered."""
    sizes = spans.select(*keys, size.alias("_v")).distinct()
    return sizes.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("sizes"))


def top_k(df: DataFrame, keys: Seq[str], order: Seq[Column], k: int) -> DataFrame:
    """TOP1: first ``k`` per key; the order must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

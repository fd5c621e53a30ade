"""URL filter: fixed rules first, mined association rules for the rest.

Urls are cut into host and path, and into tokens (labels of the host, all
directories, the file's ending, all query names; digits become one token).
Urls that a fixed rule decides are the labelled examples.  FP-growth mines
token combinations together with the label; rules are pruned by support and
confidence, and a rule is dropped where a shorter one is as confident.  The
rest of the urls are matched through an inverted index: each rule is filed
under its rarest token, so a url meets only rules whose rarest token it has.

Mining reads each labelled url once, as a Spark ML job.  Support alone bounds
the item sets, of any size.  Two kinds of sets are always redundant and not
made: those that hold a token of one label only (the rule of this token is sure
already), and those that hold two tokens of the same urls (either one will do).
So deep paths that many urls share do not double the sets with each directory.
Tokens of enough support go through the driver, as in FP-growth itself.  The
index is joined on the token without a hint.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
no tokens and the default verdict; repeated rows are judged alike; without
labelled urls nothing is mined and the default verdict holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.llm.common import ascii_lower
from glyphfold.session import cut_lineage

#: Fixed values: (verdict, host, path) of the base rules.
BASE_RULES: list[tuple[str, str, str]] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
DEFAULT = "allow"
LABEL = "label="


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(found), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict): the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(on + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url; empty without a host."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    digits = F.lit("[0-9]+")
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = F.regexp_extract(path, "\\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(folders, lambda x: F.concat(F.lit("dir:"), F.regexp_replace(x, digits, F.lit("0")))),
        F.transform(names, lambda x: F.concat(F.lit("arg:"), F.regexp_replace(x, digits, F.lit("0")))),
        F.when(ending != "", F.array(F.concat(F.lit("end:"), F.lower(ending)))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def token_counts(labelled: DataFrame, tokens_col: str, label_col: str) -> DataFrame:
    """(token, seen, verdict, h1, h2): ``verdict`` where all its urls have the same; the hashes are those of its set of urls."""
    # One row for each set and label: in an exclusive or, equal rows would cancel.
    content = F.struct(F.col(tokens_col), F.col(label_col))
    distinct = labelled.groupBy(tokens_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    hashed = distinct.select(
        F.explode(tokens_col).alias("token"), "n", F.col(label_col).alias("label"),
        F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(1), content).alias("h2"),
    )
    found = hashed.groupBy("token").agg(
        F.sum("n").alias("seen"),
        F.when(F.min("label") == F.max("label"), F.min("label")).alias("verdict"),
        F.bit_xor("h1").alias("h1"),
        F.bit_xor("h2").alias("h2"),
    )
    return cut_lineage(found)


def mine_rules(
    labelled: DataFrame,
    tokens_col: str,
    label_col: str,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(items, verdict, confidence, support, key_token): pruned association rules from tokens to a label."""
    least = math.ceil(min_support * labelled.count())
    single = token_counts(labelled, tokens_col, label_col).filter(F.col("seen") >= least)
    sure = single.filter(F.col("verdict").isNotNull()).select(
        F.array("token").alias("items"), "verdict", F.lit(1.0).alias("confidence"), F.col("seen").alias("support")
    )
    groups = single.filter(F.col("verdict").isNull()).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("same"))
    groups = cut_lineage(groups.select(F.col("same")[0].alias("rep"), "same"))
    mixed = [row.rep for row in groups.select("rep").collect()]
    sets = _label_sets(labelled, tokens_col, label_col, mixed, min_support)
    kept = sure.filter(F.lit(1.0 >= min_confidence)).unionByName(_members(_irredundant(sets, min_confidence), groups))
    rarest = (
        kept.withColumn("token", F.explode("items"))
        .join(single.select("token", "seen"), "token")
        .groupBy("items", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("seen", "token")).alias("key_token"))
    )
    return cut_lineage(rarest)


def _label_sets(labelled: DataFrame, tokens_col: str, label_col: str, among: list[str], min_support: float) -> DataFrame:
    """(items, verdict, confidence, support): each set of ``among`` that is frequent together with a label."""
    wanted = F.array(*map(F.lit, among)).cast("array<string>")
    baskets = labelled.select(
        F.concat(
            F.array_intersect(F.col(tokens_col), wanted), F.array(F.concat(F.lit(LABEL), F.col(label_col)))
        ).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets)
    is_label = lambda x: F.startswith(x, F.lit(LABEL))
    counts = model.freqItemsets.select(
        F.filter("items", lambda x: ~is_label(x)).alias("tokens"), F.filter("items", is_label).alias("labels"), "freq"
    ).filter((F.size("tokens") > 0) & (F.size("labels") <= 1))
    counts = cut_lineage(counts.withColumn("tokens", F.array_sort("tokens")))
    plain = counts.filter(F.size("labels") == 0).select("tokens", F.col("freq").alias("seen"))
    sets = (
        counts.filter(F.size("labels") == 1)
        .join(plain, "tokens")
        .select(
            F.col("tokens").alias("items"),
            F.expr(f"substring(labels[0], {len(LABEL) + 1})").alias("verdict"),
            (F.col("freq") / F.col("seen")).alias("confidence"),
            F.col("freq").alias("support"),
        )
    )
    return cut_lineage(sets)


def _irredundant(sets: DataFrame, min_confidence: float) -> DataFrame:
    """The sets that are confident, and more so than any shorter set of some of their items.

    By size: a set learns the best of its subsets from those with one item less.
    """
    names = sets.columns
    largest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    known = sets.filter(F.size("items") == 1).withColumn("_best", F.col("confidence"))
    kept = known.select(names)
    for size in range(2, largest + 1):
        parts = sets.filter(F.size("items") == size).withColumn(
            "_part", F.explode(F.transform("items", lambda x: F.array_remove("items", x)))
        )
        shorter = known.select(F.col("items").alias("_part"), "verdict", "_best")
        found = parts.join(shorter, ["_part", "verdict"]).groupBy(names).agg(F.max("_best").alias("_below"))
        found = cut_lineage(found)
        kept = kept.unionByName(found.filter(F.col("confidence") > F.col("_below")).select(names))
        known = found.withColumn("_best", F.greatest("confidence", "_below"))
    return kept.filter(F.col("confidence") >= min_confidence)


def _members(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Each rule once for each choice of tokens that stand in the same urls as its items."""
    names = rules.columns
    rest = ["verdict", "confidence", "support"]
    listed = (
        rules.withColumn("rep", F.explode("items"))
        .join(groups, "rep")
        .groupBy(names)
        .agg(F.collect_list("same").alias("_same"))
    )
    one = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate(
        "_same", one, lambda done, same: F.flatten(F.transform(done, lambda d: F.transform(same, lambda t: F.array_append(d, t))))
    )
    return listed.select(F.explode(chosen).alias("_items"), *rest).select(F.array_sort("_items").alias("items"), *rest)


def match_rules(urls: DataFrame, id_col: str, tokens_col: str, rules: DataFrame) -> DataFrame:
    """(id, verdict, items): the most confident rule whose items a url has; longer, then block, then smaller items win ties."""
    index = rules.select(F.col("key_token").alias("token"), "items", "verdict", "confidence", "support")
    met = urls.select(id_col, tokens_col, F.explode(tokens_col).alias("token")).join(index, "token")
    fitting = met.filter(F.size(F.array_except("items", tokens_col)) == 0)
    place = F.struct("confidence", F.size("items"), "support", (F.col("verdict") == "block").cast("int"), "items")
    return fitting.groupBy(id_col).agg(F.max_by(F.struct("verdict", "items"), place).alias("_best"))


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = BASE_RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(id, host, path, rule, verdict, mined): one row for each row of ``pages``; ``mined`` are a matched rule's items."""
    parted = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select(
        "_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    rule, verdict = base_rule(F.col("host"), F.col("path"), rules)
    parted = parted.withColumn("rule", rule).withColumn("_base", verdict)
    with_tokens = parted.withColumn("_tokens", tokens(F.col("_url"), F.col("host"), F.col("path")))
    found = mine_rules(
        with_tokens.filter(F.col("rule").isNotNull()), "_tokens", "_base", min_support, min_confidence
    )
    # Judged by token set, of which there are far fewer than urls; numbers are one token.
    key = F.xxhash64("_tokens")
    sets = with_tokens.filter(F.col("rule").isNull()).select(key.alias("_set"), "_tokens").distinct()
    # Written, so that the join below is one of two plain exchanges and a hot token set can be split.
    best = cut_lineage(match_rules(sets, "_set", "_tokens", found))
    joined = with_tokens.withColumn("_set", F.when(F.col("rule").isNull(), key)).join(best, "_set", "left")
    return joined.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("_base", "_best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.col("_best.items").alias("mined"),
    )


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")

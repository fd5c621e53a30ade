"""Quality rules judged with the help of each document's host.

1. Every text is measured (:func:`measures`) and held against
   limits (:data:`WIDE`, :data:`NARROW`).
2. Failures are counted by host, here the column ``source``.
3. The failure rate of a host is shrunk by a beta prior whose two parameters
   come from all hosts' rates (method of moments), so that a host with few
   documents is judged mostly like the average host.
4. The verdict goes back to the documents.  Each rule has a wide and a narrow
   limit: the wide one holds everywhere, the narrow one for documents of
   distrusted hosts (shrunken rate over ``max_rate``).  A document within the
   narrow limits stays, whatever its host.

Measuring happens inside the row, so texts are never shuffled; the narrow
measures are written once and read by both the count and the join.  Counts by
host combine map-side, and the join of documents to host verdicts is an
equality join that adaptive execution splits where one host is hot.

Repeated windows are found by 64-bit hashes of windows within one text.

Defined cases: null text has no words and fails; null host is a host of its
own; repeated rows are counted and judged each; an empty table gives an empty
result.  Other columns are passed through by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphfold.llm.common import SPACE_CHARS, let, spaced_words
from glyphfold.session import cut_lineage

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_RATE = 0.3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter")


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, in one pass over sorted hashes."""

    def covered(starts: Column) -> Column:
        # Each start covers up to the next start, the last one its whole window.
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(starts) - 1), lambda i: F.least(F.lit(size), starts[i] - starts[i - 1])
        )
        return F.when(F.size(starts) > 1, F.aggregate(gaps, F.lit(0), lambda a, g: a + g)).otherwise(F.lit(0)) + size

    def positions(hashes: Column) -> Column:
        """Ascending starts of the windows whose hash another window has."""

        def pick(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            return F.filter(
                F.transform(
                    F.sequence(F.lit(0), last),
                    lambda i: F.when(
                        ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == pairs[i]["h"]))
                        | ((i < last) & (pairs[F.least(i + 1, last)]["h"] == pairs[i]["h"])),
                        pairs[i]["p"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.sort_array(let(pairs, pick))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(positions(hashes), covered)
        )

    def of_word_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)])
        )
        return let(windows, of_hashes)

    return F.when(F.size(words) < size, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_word_hashes)
    )


def _stutter(words: Column) -> Column:
    """Words that equal the word before them."""
    places = F.sequence(F.lit(1), F.size(words) - 1)
    return F.when(F.size(words) > 1, F.size(F.filter(places, lambda i: words[i] == words[i - 1]))).otherwise(0)


def measures(text: Column, window: int = WINDOW) -> Column:
    """A struct of :data:`MEASURES` (longs) of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # A split on spaces alone would find the same words; one regular expression serves all six characters.
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            _repeated_words(words, window).cast("long").alias("n_repeat_words"),
            _stutter(words).cast("long").alias("n_stutter"),
        )

    return let(spaced_words(text), of_words)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _limits(short: int, long: int, symbols: int, lines: int, stutter: int) -> Column:
    """Any limit passed; whole numbers, so that every engine decides alike (tenths of a word for the last three)."""
    n = F.col("n_words")
    return (
        (10 * F.col("word_chars") < short * n)
        | (10 * F.col("word_chars") > long * n)
        | (10 * F.col("n_symbols") > symbols * n)
        | (10 * F.col("n_dup_lines") > lines * n)
        | (10 * F.col("n_stutter") > stutter * n)
    )


#: Mean word length (tenths of a character); symbols, repeated lines and words said twice in a row (tenths of a word).
WIDE: dict[str, int] = {"short": 20, "long": 200, "symbols": 3, "lines": 3, "stutter": 3}
NARROW: dict[str, int] = {"short": 30, "long": 120, "symbols": 1, "lines": 1, "stutter": 1}


def host_verdicts(judged: DataFrame, host: str, failed: str, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, docs, failures, rate, distrusted): shrunken failure rates.

    The prior's mean is the mean of the hosts' rates; its strength follows
    from their variance and is at least 1 and at most 1,000,000 documents, the
    latter also where the hosts do not differ.
    """
    hosts = judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col(failed).cast("long")).alias("failures")
    )
    rates = hosts.agg(F.avg(F.col("failures") / F.col("docs")).alias("m"), F.var_pop(F.col("failures") / F.col("docs")).alias("v"))
    # One row of two numbers: read by the driver and written into the plan.
    found = rates.first()
    mean, var = float(found["m"] or 0.0), float(found["v"] or 0.0)
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("distrusted", F.col("rate") > F.lit(max_rate))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_rate: float = MAX_RATE) -> DataFrame:
    """(id, host, measures, base_failed, narrow_failed, host_rate, kept): one row for each row of ``docs``."""
    measured = docs.select(
        F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), measures(F.col(text_col)).alias("_m")
    ).select("_id", "_host", "_m.*")
    judged = cut_lineage(
        measured.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("narrow_failed", F.col("base_failed") | _limits(**NARROW))
    )
    hosts = host_verdicts(judged, "_host", "narrow_failed", max_rate).select(
        F.col("_host").alias("_key"), "rate", "distrusted"
    )
    joined = judged.join(hosts, F.col("_host").eqNullSafe(F.col("_key")), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        *MEASURES,
        "base_failed",
        "narrow_failed",
        F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & ~_limits(**WIDE) & ~(F.col("distrusted") & F.col("narrow_failed"))).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept")

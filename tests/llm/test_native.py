"""Operators on DataFrame functions: line de-duplication, decontamination, quality, URL rules."""

import itertools
import random
import re

import duckdb
import pytest
from awkward_tables import awkward, empty  # noqa: F401
from brute import contained, deduped_lines, measures, quality_kept, sha256
from pyspark.sql import functions as F

from glyphfold.llm import decontaminate, line_dedup, quality, url_rules
from glyphfold.llm.oracle import ORACLE
from glyphfold.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_decontamination", "op8_host_quality", "op10_url_rules"])
def test_no_python_in_native_plans(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_line_dedup(awkward):
    rows, frame = awkward
    want = deduped_lines({r[0]: r[1] for r in rows if r[0] is not None})
    got = line_dedup.digest(frame).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is not None:
            text, before, gone = want[row.doc_id]
            assert (row.n_lines, row.n_dropped, row.kept_sha256) == (before, gone, sha256(text))
        else:
            assert row.n_dropped == 0
    assert sum(r.n_dropped for r in got) > 5


def test_line_dedup_keeps_columns_and_same_id_texts_apart(spark):
    line = "A line that is certainly longer than forty characters, is it not?"
    rows = [(i, line, i) for i in range(6)] + [(0, "another text\n" + line, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = {(r.doc_id, r.n_lines): r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert out[5, 1] == line and out[0, 1] == "" and out[0, 2] == "another text"


def test_quality(awkward):
    rows, frame = awkward
    want = sorted(zip((r[0] is None, r[0]) for r in rows), key=str)
    got = quality.digest(frame).collect()
    assert len(got) == len(want)
    kept = {}
    for row, keep in zip(rows, quality_kept([(r[0], r[1], r[3]) for r in rows]), strict=True):
        kept.setdefault((row[0], measures(row[1])), keep)
    for row in got:
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.n_stutter)
        assert kept[row.doc_id, found] == row.kept


def test_distrusted_hosts_are_held_to_narrow_limits(spark):
    good = " ".join(f"plain{i} words" for i in range(30))
    middling = good + " ####" + " # #" * 3
    bad = "& " * 60
    rows = [(i, good, "fine") for i in range(30)] + [(100, middling, "fine")]
    rows += [(200 + i, bad, "poor") for i in range(30)] + [(300, middling, "poor"), (301, good, "poor")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(frame).filter("kept").collect()}
    assert {100, 301} <= kept and 300 not in kept and 205 not in kept


@pytest.mark.parametrize("index_rows", [100_000, 40])
def test_decontamination(spark, awkward, index_rows):
    rows, frame = awkward
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    long = texts[49].split()
    items = {1: " ".join(long[100:130]).upper() + "!", 2: " ".join(long[7:27] + ["changed"] * 2 + long[30:60]), 3: "a b c d", 4: "", 5: None,
             6: "nowhere to be found in any of these texts", 7: "one", 8: " ".join(texts[3].split()[:9]) + " x y z u v w"}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = decontaminate.contained_items(frame, table, index_rows=index_rows)
    got = {(r.doc_id, r.item_id): r.containment for r in out.collect()}
    assert got == contained(texts, items)
    assert (49, 1) in got and (49, 2) in got
    left = {r.doc_id for r in decontaminate.clean(frame, table).collect()}
    assert left == {r[0] for r in rows} - {doc for doc, _ in got}


def test_short_item_in_every_size_of_document(spark):
    item = " ".join(f"item{i}" for i in range(24))
    rows = [(n, " ".join([f"w{n}x{i}" for i in range(n)] + item.split()[: 24 - n % 3])) for n in (1, 10, 100, 1000, 20_000)]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert {r.doc_id for r in got} == {1, 10, 100, 1000, 20_000}


def test_decontamination_of_rows_that_share_an_id_or_have_none(spark):
    item = " ".join(f"item{i}" for i in range(24))
    words = item.split()
    rows = [(1, "clean text of one"), (1, item), (2, " ".join(words[:14])), (2, " ".join(words[10:])), (None, "x " + item), (None, "clean"), (3, item), (3, item)]
    frame, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contained_items(frame, table).collect()) == [1, 3]
    left = sorted(((r.doc_id or 0, r.text) for r in decontaminate.clean(frame, table).collect()))
    assert left == sorted((doc or 0, text) for doc, text in (rows[0], rows[2], rows[3], rows[5]))


def brute_rule(url):
    """(host, path, rule, verdict) of the base rules."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
        path = re.split("[?#]", tail)[0]
    best = None
    for verdict, on, start in url_rules.BASE_RULES:
        if (host == on or host.endswith("." + on)) and path.startswith(start):
            best = max(best or (0, "", ""), (len(on + start), on + start, verdict))
    return host, path, best and best[1], best and best[2]


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.example.com/en/1?x=/en/",
    "http://com/", "http://com", "ftp://x.net/fr/#a", "http://x.net/fr", "http://x.net?/es/", "a://b://c.net/es/", "http://x.org/q?a=1&b=2#t",
    "http://xcom/", "http://notexample.com/en/", "http://x.com:80/en/", "//x.com/", "http://x.net/es/\nfoo", "x\ny://Z.net/es/",
]


def test_base_rules(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for row in url_rules.digest(frame).collect():
        host, path, rule, verdict = brute_rule(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def test_mined_rules_are_the_frequent_confident_and_shortest(spark):
    baskets = [(["a", "b"], "block")] * 12 + [(["a", "c"], "allow")] * 9 + [(["b", "c"], "block")] * 5 + [(["c"], "allow")] * 3 + [([], "allow")]
    frame = spark.createDataFrame(baskets, "t array<string>, l string")
    got = {(tuple(r["items"]), r.verdict, round(r.confidence, 6), r.support) for r in url_rules.mine_rules(frame, "t", "l", 0.1, 0.7).collect()}
    want = {}
    for size in (1, 2, 3):
        for items in itertools.combinations("abc", size):
            seen = [label for t, label in baskets if set(items) <= set(t)]
            for label in ("allow", "block"):
                n = seen.count(label)
                if n >= 0.1 * len(baskets) and n / len(seen) >= 0.7:
                    shorter = [want.get((p, label)) for k in range(1, size) for p in itertools.combinations(items, k)]
                    if not any(s and s[0] >= n / len(seen) for s in shorter):
                        want[items, label] = (n / len(seen), n)
    assert got == {(items, label, round(c, 6), n) for (items, label), (c, n) in want.items()}
    assert got


def test_telling_tokens_behind_the_first_ones_of_a_url(spark):
    deep, many = "https://s.example.org/1/a/b/c/casino/x", "https://s.example.org/1/a?a=1&b=2&c=3&d=4&casino=5"
    assert "dir:casino" in spark.createDataFrame([(deep,)], "u string").select(url_rules.tokens(F.col("u"), F.lit("h"), url_rules.path_of(F.col("u")))).first()[0]
    labelled = [f"http://a{i % 2}.net/{lang}/a/b/c/{w}/x?a&b&c&d&{w}" for i in range(20) for lang, w in (("es", "casino"), ("fr", "casino"))]
    labelled += [f"http://www.example.com/en/a/b/c/x?a&b&c&d&n={i}" for i in range(20)]
    frame = spark.createDataFrame(list(enumerate([*labelled, deep, many])), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.digest(frame).collect()}
    assert got[len(labelled)] == got[len(labelled) + 1] == (None, "block")


def brute_mined(baskets, support, confidence):
    """{(items, label): (confidence, count)} of all sets of any size."""
    names, want = sorted({t for items, _ in baskets for t in items}), {}
    shares = {}
    for size in range(1, len(names) + 1):
        for items in itertools.combinations(names, size):
            seen = [label for t, label in baskets if set(items) <= set(t)]
            for label in {label for _, label in baskets}:
                n = seen.count(label)
                if n >= support * len(baskets) and n:
                    shares[items, label] = n / len(seen)
                    shorter = [shares[p, label] for k in range(1, size) for p in itertools.combinations(items, k)]
                    if n / len(seen) >= confidence and n / len(seen) > max(shorter, default=-1):
                        want[items, label] = (round(n / len(seen), 6), n)
    return want


@pytest.mark.parametrize("seed", range(4))
def test_mined_rules_of_any_size(spark, seed):
    rng = random.Random(seed)
    baskets = []
    for _ in range(150):
        items = [t for t in "abcdef" if rng.random() < 0.75]
        # Two tokens that always come together, one of a single label.
        items += ["g", "h"] * (rng.random() < 0.8) + ["s"] * (rng.random() < 0.1)
        baskets.append((items, "block" if "s" in items or set("abcd") <= set(items) and rng.random() < 0.97 else "allow"))
    frame = spark.createDataFrame(baskets, "t array<string>, l string")
    rows = url_rules.mine_rules(frame, "t", "l", 0.02, 0.7).collect()
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 6), r.support) for r in rows}
    assert got == brute_mined(baskets, 0.02, 0.7) and len(got) == len(rows)
    assert (("a", "b", "c", "d"), "block") in got


def test_rules_of_deep_paths_do_not_double_with_each_directory(spark):
    path = [f"d{i}" for i in range(40)]
    frame = spark.createDataFrame([(path, "block")] * 19 + [(path, "allow")] + [(["x"], "allow")] * 20, "t array<string>, l string")
    got = {(tuple(r["items"]), r.verdict, r.support) for r in url_rules.mine_rules(frame, "t", "l", 0.01, 0.9).collect()}
    assert got == {((d,), "block", 19) for d in path} | {(("x",), "allow", 20)}


def test_urls_without_labels_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert [r.verdict for r in url_rules.digest(frame).collect()] == ["allow"]
    assert url_rules.digest(frame.limit(0)).count() == 0


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.digest(empty).count() == 0
    assert quality.digest(empty).count() == 0
    assert decontaminate.contained_items(empty, items).count() == 0
    some = empty.unionByName(spark.createDataFrame([(1, "a b c d e f", None, None, None)], empty.schema))
    assert decontaminate.clean(some, items).count() == 1
    assert line_dedup.digest(some.withColumn("text", F.lit(None).cast("string"))).first().n_lines == 1

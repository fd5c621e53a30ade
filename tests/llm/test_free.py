"""Operators that work inside tasks: licenses, languages, WARC, pages, packing, near-duplicates, components."""

import base64
import hashlib
import html as H
import random
import zlib

import numpy as np
import pytest
from awkward_tables import awkward, empty, prose, vocabulary  # noqa: F401
from brute import PLAIN, SMALL as LOWER, near_components, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphfold.llm import html_text, language, licenses, near_dups, packing, warc
from glyphfold.llm.bytescan import SPACED, shingle_set, word_bounds, word_hashes
from glyphfold.llm.components import components
from glyphfold.llm.dom import parse

SMALL = "/root/testdata/sf0.001"

# ---- licenses


def base_places(text):
    words = PLAIN.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


LICENSED = [
    "Released under the MIT License. Released under the, MIT -- license",
    "under the mit licensed work; underthe mit license; éunder the mit license",
    "Licensed under the Apache License, Version 2.0 (the License); see http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "This library is under the GNU Lesser General Public License, version 2.1 or later.",
    "CC BY-NC 4.0 and cc\nby\tnc",
    "no license here, all rights reserved",
    "mit mit mit under the mit license version 2 apache license version 2",
]


def test_license_base_and_labels(spark, awkward):
    rows, frame = awkward
    texts = LICENSED + [r[1] for r in rows]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.digest(table).collect()}
    for i, text in enumerate(texts):
        n, places = base_places(text)
        row, at = got[i], [p for p, _ in places]
        assert (row.n_words, row.n_base) == (n, len(at))
        assert (row.first_word, row.last_word) == (min(at, default=None), max(at, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}
        assert row.labels == ",".join(sorted(set(filter(None, row.labels.split(","))))) and 0 <= row.score <= 1
    labels = [set(got[i].labels.split(",")) for i in range(len(LICENSED))]
    assert labels[3] == {"gpl-3"} and labels[4] == {"lgpl-2.1"} and labels[6] == {"proprietary"}
    assert "apache-2" in labels[2] and "cc-by-nc" in labels[5]
    assert licenses.scan(table.limit(0)).count() == 0


def test_license_suppression_and_gates():
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300
    for rule in scanner.rules:
        # Every match of a rule holds its keyword: the prefilter never hides one.
        assert rule.keyword in rule.pattern.pattern
    for text in LICENSED:
        kept = scanner.scan(text)["detections"]
        for a in kept:
            assert not any(b is not a and b[0] <= a[0] and a[1] <= b[1] for b in kept)
    assert scanner.scan(None) == {"n_words": 0, "base": [], "detections": []}


# ---- languages


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.digest(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_ignores_labels_of_held_out_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    docs.loc[held, "lang"] = "zz"
    docs["score"] = "clash"
    got = language.digest(spark.createDataFrame(docs)).toPandas()
    assert "zz" not in set(got.lang_pred)


def test_language_edges(spark, awkward, empty):
    rows, frame = awkward
    got = language.digest(frame).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id): r for r in got}
    for doc, text, *_ in rows:
        if doc is not None and not any(c.isalpha() for c in text or ""):
            assert (by_text[doc].lang_pred, by_text[doc].score) == ("und", 0.0)
    assert language.digest(empty).count() == 0
    alone = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.digest(alone).first().lang_pred == "und"


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    examples = []
    for i in range(300):
        label = i % 3
        dims = np.unique(np.append(rng.integers(10, 200, 20), label))
        examples.append((dims, np.ones(len(dims)) / 4, label))
    weights = language.fit_ftrl(examples, 3, 400, l1=0.05)
    assert np.count_nonzero(weights[200:]) == 0 and np.count_nonzero(weights) < 600
    assert np.mean([np.argmax(v @ weights[d]) == y for d, v, y in examples]) > 0.98


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    true = rng.normal(size=(4000, 3))
    chance = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=c) for c in chance])
    assert language.fit_temperature(true * 7, labels) == pytest.approx(1 / 7, rel=0.1)


# ---- WARC


def test_warc_round_trip_and_links(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    records = warc.responses(pages).collect()
    data = b"".join(
        warc.to_bytes([(h["name"], h["value"]) for h in r.headers], bytes(r.block), i % 2 == 0) for i, r in enumerate(records[:1])
    )
    assert len(list(warc.records_of(data))) == 1
    for compress in (True, False):
        whole = b"".join(warc.to_bytes([(h["name"], h["value"]) for h in r.headers], bytes(r.block), compress) for r in records)
        (tmp_path / f"a-{compress}.warc").write_bytes(whole)
        back = warc.read_archives(spark, str(tmp_path / f"a-{compress}.warc")).collect()
        assert [(b.record_id, bytes(b.block), b.headers) for b in back] == [(r.record_id, bytes(r.block), r.headers) for r in records]
        made = warc.derivatives(warc.read_archives(spark, str(tmp_path / f"a-{compress}.warc"))).collect()
        assert len(made) == 2 * len(records)
    sources = {r.record_id: r for r in records}
    for row in made:
        headers = {h["name"]: h["value"] for h in row.headers}
        source = {h["name"]: h["value"] for h in sources[headers["WARC-Refers-To"]].headers}
        assert headers["WARC-Target-URI"] == source["WARC-Target-URI"] and headers["WARC-Date"] == source["WARC-Date"]
        block = bytes(row.block)
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert int(headers["Content-Length"]) == len(block)
        payload = bytes(sources[headers["WARC-Refers-To"]].block).split(b"\r\n\r\n", 1)[1]
        assert source["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if row.warc_type == "metadata":
            assert f"source-payload-digest: {source['WARC-Payload-Digest']}" in block.decode()
            assert "source-header-content-type: text/html" in block.decode()


def test_warc_encodings_and_edges(spark):
    import gzip

    body = gzip.compress("<p>Zürich &amp; more</p><script>x</script>".encode("latin-1"))
    chunked = b"".join(f"{len(body[i : i + 7]):x}\r\n".encode() + body[i : i + 7] + b"\r\n" for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    )
    kinds = {kind: content for kind, _, _, content in warc.derive("<urn:x>", [], block)}
    assert kinds["conversion"].decode() == "Zürich & more"
    image = warc.derive("<urn:y>", [], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    assert [kind for kind, *_ in image] == ["metadata"]
    rows = [(1, None, None, "x"), (2, "http://a/", "", "x"), (2, "http://a/", "", "x"), (None, "http://b/", "<p>" * 5000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.digest(frame).collect()
    assert len(got) == 8 and len({(r.page_id, r.record_id) for r in got}) == 6
    assert all(r.target_uri is None for r in got if r.page_id == 1)
    assert warc.digest(frame.limit(0)).count() == 0


# ---- pages


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.train_model(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_page_text_is_the_article(spark, page_model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import re

    for row in html_text.extract(pages, page_model).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer)", row.html, re.DOTALL)[1]
        parts = [" ".join(H.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert row.text == "\n\n".join(filter(None, parts)) and row.n_chars == len(row.text)


def test_page_furniture(page_model):
    page = """<html><head><title>no</title><style>p{}</style></head><body><header><nav><a href="/">Home</a></nav></header>
    <div class="cookie-notice"><p>We use cookies to give you the best experience on this site.</p></div>
    <article><h1>Caf&eacute;&nbsp;life</h1><p>The text of this article runs on for a while, as   texts do,&#10;with <b>bold</b> parts.
    <p>And here it goes on, for some more words &lt;than&gt; one would expect.<script>var no;</script></p>
    <form><p>Your name</p><input></form></article><aside class="sidebar"><p>Other things that you may like to read.</p></aside>
    <footer><p>All of this was made by us.</p></footer></body></html>"""
    want = ["Café life", "The text of this article runs on for a while, as texts do, with bold parts.", "And here it goes on, for some more words <than> one would expect."]
    assert html_text.main_blocks(page, page_model) == want


def test_page_edges(spark, page_model):
    long = "<article>" + "<p>word and another word, and so on it goes.</p>" * 3000 + "</article>"
    odd = ["<", "<p", "<!-- x", "<script>", "</p></p>", "<a b='c>d", "&#xD800;&#0;&bogus;", "<div " * 50, "<p>" * 3000, "<b>" * 3000, long]
    rows = [(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "u", "<p>x", 1)] + [(10 + i, "u", h, 1) for i, h in enumerate(odd)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(frame, page_model).collect()}
    assert got[1].text == "" and got[2].n_chars == 0
    assert got[10 + len(odd) - 1].n_blocks == 3000
    assert html_text.digest(frame.limit(0)).count() == 0


HIDING = {
    "noscript": "<noscript>{}</noscript>",
    "template": "<template>{}</template>",
    "button": "<button>{}</button>",
    "hidden": "<div hidden>{}</div>",
    "aria": '<section aria-hidden="true"><div>{}</div></section>',
    "display": '<div style="color: red; DISPLAY : none">{}</div>',
    "visibility": '<div style="visibility:hidden"><div><div>{}</div></div></div>',
    "inline": '<p><span style="display:none">{}</span></p>',
    "inline nested": "<p><b hidden>a<i>{}</i>b</b></p>",
}


@pytest.mark.parametrize("kind", HIDING)
def test_hidden_text_is_not_shown(page_model, kind):
    shown = "<p>The text of this article runs on for a while, as texts do, for many words more.</p>"
    secret = "Nobody who opens this page sees these many words, however long the sentence is."
    inner = secret if "inline" in kind else f"<p>{secret}</p>"
    page = f"<html><body><article>{shown}{HIDING[kind].format(inner)}{shown}</article></body></html>"
    found = html_text.main_blocks(page, page_model)
    assert len(found) == 2 and not any("Nobody" in f for f in found)


def test_a_page_that_is_one_form(page_model):
    page = "<body><form id=all><article><h1>Title of it</h1><p>The text of this article runs on for a while, as texts do.</p></article></form></body>"
    assert html_text.main_blocks(page, page_model) == ["Title of it", "The text of this article runs on for a while, as texts do."]


DEEP = {
    "spans": "<p>" + "<span>" * 20_000 + "x" + "</b>" * 20_000,
    "divs": "".join(f'<div class="c{i} d{i}">' for i in range(20_000)) + "x",
    "blocked": "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000,
    "items": "<ul>" + "<span>" * 20_000 + "<li>x" * 20_000,
    "wide": "<div class='" + " ".join(f"w{i}" for i in range(3_000)) + "'>" + "<p>x" * 20_000,
}


@pytest.mark.parametrize("kind", DEEP)
def test_deep_pages_take_linear_time_and_memory(page_model, kind):
    import time
    import tracemalloc

    began = time.process_time()
    html_text.main_blocks(DEEP[kind], page_model)
    assert time.process_time() - began < 6  # a second or less on a machine at rest
    tracemalloc.start()
    html_text.main_blocks(DEEP[kind], page_model)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_scores_are_the_weights_of_the_features(page_model):
    for source in ["<div class=a><p class='b a'>one<div id=a-b><p>two</p><ul><li>three<li>four</ul></div></div><main><p>five", *html_text.LABELLED]:
        nodes, _ = parse(source)
        want = [sum(page_model.weights.get(n, 0.0) for n in named) for named in html_text.features(nodes)]
        assert html_text.scores(nodes, page_model.weights) == pytest.approx(want)


def test_the_model_does_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    a, b = (html_text.train_model(pages.repartition(n), sample_pages=40) for n in (2, 9))
    assert a == b


def exact_marginals(nodes, unary, pairs):
    """By enumeration of all labellings."""
    total, on = 0.0, [0.0] * len(nodes)
    for code in range(1 << len(nodes)):
        state = [code >> i & 1 for i in range(len(nodes))]
        p = 1.0
        for i, node in enumerate(nodes):
            p *= unary[i][state[i]] * (pairs[state[node.parent]][state[i]] if i else 1.0)
        total += p
        for i, s in enumerate(state):
            on[i] += p * s
    return [x / total for x in on]


def test_messages_give_exact_marginals():
    nodes, _ = parse("<div class=a><p>one</p><div><p>two</p><ul><li>three<li>four</ul></div></div><p>five")
    weights = {"tag=p": 0.7, "tag=div": -0.3, "tag=li": 0.2, "near=a": -0.5, "bias": 0.1, "tag=ul": 0.4}
    model = html_text.Model(weights, [[1.6, 0.2], [0.3, 2.2]])
    unary = []
    for named in html_text.features(nodes):
        p = 1 / (1 + np.exp(-sum(weights.get(n, 0) for n in named)))
        unary.append((1 - p, p))
    assert html_text.marginals(nodes, model) == pytest.approx(exact_marginals(nodes, unary, model.pairs))


# ---- packing


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_ids_are_those_of_the_tokenizers_library, "both"):
        found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        found.encode_special_tokens = True
        test_ids_are_those_of_the_tokenizers_library.both = found, packing.encoder(packing.vocabulary_path())
    slow, fast = test_ids_are_those_of_the_tokenizers_library.both
    for t in (text, text + "<|endoftext|> it's  done\n\n " + text):
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_ids_of_pieces_are_those_of_tokenizers_as_it_comes(spark):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as file:
        added = json.load(file)["added_tokens"]
    assert {t["content"]: t["id"] for t in added} == packing.ADDED
    assert not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    rng, parts = random.Random(7), ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n ", "it's", "é", "word", " 12", "\u3000"]
    texts = ["<|endoftext|>", "one <|endoftext|> two  <|endoftext|><|endoftext|>\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.token_pieces(frame, with_ids=True).collect()}
    plain = Tokenizer.from_file(path)
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[0] == [50256, 0]


def test_packing(spark, awkward, hf):
    rows, frame = awkward
    pieces = packing.cut_lineage(packing.token_pieces(frame, with_ids=True))
    got = packing.pack(pieces, group_size=16).collect()
    texts = {}
    for doc, text, *_ in rows:
        texts.setdefault(doc, []).append(hf.encode(text or "", add_special_tokens=False).ids + [0])
    docs, bins = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in docs.items():
        want = texts[doc]
        if len(want) == 1:
            parts.sort()
            assert [i for _, _, ids in parts for i in ids] == want[0]
            assert [p for p, *_ in parts] == list(range(len(parts)))
            assert all(len(ids) == 2048 for p, _, ids in parts if p)
        assert sum(len(ids) for *_, ids in parts) == sum(map(len, want))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r.length for r in got])
    assert len(bins) <= packing.lower_bound(lengths) + 1
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r.ids) for r in whole) == lengths.sum() and max(len(r.ids) for r in whole) <= 2048
    assert packing.digest(frame.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=8))
def test_bounds_and_best_fit(lengths):
    lengths = np.array(lengths, np.int64)
    bins, count = packing.best_fit_decreasing(lengths, 24)
    filled = np.bincount(bins, weights=lengths, minlength=count) if len(lengths) else np.zeros(0)
    assert (filled <= 24).all() and len(filled) == count

    def fewest(items, spaces):
        if not items:
            return len(spaces)
        best, tried = len(items) + len(spaces), set()
        for i, s in enumerate(spaces):
            if s >= items[0] and s not in tried:
                tried.add(s)
                best = min(best, fewest(items[1:], spaces[:i] + [s - items[0]] + spaces[i + 1 :]))
        return min(best, fewest(items[1:], [*spaces, 24 - items[0]]))

    optimum = fewest(sorted(lengths.tolist(), reverse=True), [])
    assert packing.lower_bound(lengths, 24) <= optimum <= count


def test_exchange_closes_gaps(spark):
    # Each group alone wastes space: long pieces here, short ones there.
    rng = random.Random(4)
    rows = [(i, rng.choice([1100, 948, 700, 649, 300, 1700])) for i in range(4000)]
    frame = packing.cut_lineage(spark.createDataFrame(rows, "doc_id long, length long").repartition(7))

    def bins(rounds):
        return packing.pack(frame, group_size=40, rounds=rounds).select("sequence_id").distinct().count()

    once, often = bins(1), bins(4)
    lengths = np.array([r[1] for r in rows])
    bound, whole = packing.lower_bound(lengths), packing.best_fit_decreasing(lengths)[1]
    assert bound <= whole <= often < once and often <= 1.01 * whole


def test_exchange_goes_on_while_it_saves_bins(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1100, 948, 700, 649, 300, 1700])) for i in range(4000)]
    frame = packing.cut_lineage(spark.createDataFrame(rows, "doc_id long, length long").repartition(7))
    early, late = (packing.pack(frame, group_size=8, **limit).collect() for limit in ({"rounds": 4}, {}))
    bins = [len({r.sequence_id for r in found}) for found in (early, late)]
    assert packing.lower_bound(np.array([r[1] for r in rows])) <= bins[1] < bins[0], bins
    placed = {}
    for r in late:
        placed.setdefault(r.sequence_id, []).append(r.length)
    assert sorted(r.doc_id for r in late) == list(range(4000)) and max(map(sum, placed.values())) <= 2048


# ---- near-duplicates


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ab", "é", " ", "\n", "\x1c", " ", "x" * 40, "\x00"]), max_size=40))
def test_shingle_sets(parts):
    text = "".join(parts)
    assert len(shingle_set(text)) == len(shingles(text))
    assert (shingle_set(text) == shingle_set(text.replace("B", "b") + " ")).all()


def test_word_hashes_do_not_depend_on_the_place():
    data = b"one two " + b"z" * 3_000_000 + b" one two"
    starts, ends = word_bounds(data, SPACED)
    found = word_hashes(data, starts, ends)
    assert len(found) == 5 and found[0] == found[3] and found[1] == found[4] and len(set(found.tolist())) == 3


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 0.9):
        same = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            both = int(300 * share)
            a = pool[: both + (300 - both) // 2]
            b = np.concatenate([pool[:both], pool[both + (300 - both) // 2 :]])
            same.append((near_dups.signature(a, 192) == near_dups.signature(b, 192)).mean())
        assert np.mean(same) == pytest.approx(share, abs=0.03)


def test_near_duplicates(spark, awkward):
    rows, frame = awkward
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    want = near_components(texts)
    got = near_dups.digest(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(shingles(texts[r.doc_id]))
    assert sum(not r.kept for r in got) >= 4


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_MEMBERS", 16)
    rng, words = random.Random(9), vocabulary(9)
    base = prose(rng, words, 150).split()
    rows = []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            copy[at] = rng.choice(words)
        rows.append((1000 - i, " ".join(copy)))
    want = near_components(dict(rows))
    got = {r.doc_id: r.component_id for r in near_dups.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 2


def test_similarity_at_the_limit(spark):
    # Sets of 37 and 37 with 34 in common: 34 / 40 is 0.85 exactly; with 33 in common it is less.
    words = [f"w{i}" for i in range(200)]
    first = words[:41]
    at, below = words[:38] + words[100:103], words[:37] + words[110:114]
    texts = {1: " ".join(first), 2: " ".join(at), 3: " ".join(below)}
    want = near_components(texts)
    assert want == {1: 1, 2: 1, 3: 3}
    got = near_dups.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng, words = random.Random(4), vocabulary(4)
    a, b = prose(rng, words, 80), prose(rng, words, 80)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(rng, words, 80)), (4, a + " other"), (5, b)]
    for order in (rows, rows[::-1]):
        got = near_dups.digest(spark.createDataFrame(order, "doc_id long, text string")).collect()
        found = sorted((r.doc_id, r.component_id, r.kept) for r in got)
        assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True), (5, 1, False)]


def test_ids_of_any_type(spark):
    rng, words = random.Random(5), vocabulary(5)
    a, b = prose(rng, words, 60), prose(rng, words, 60)
    frame = spark.createDataFrame([("x", a), ("c", a + " more"), ("k", b), (None, a)], "name string, text string")
    got = {r.name: (r.component_id, r.kept) for r in near_dups.near_duplicates(frame, "name").collect()}
    assert got == {"x": ("c", False), "c": ("c", True), "k": ("k", True), None: (None, True)}


def test_near_duplicates_empty(empty):
    assert near_dups.digest(empty).count() == 0


@pytest.mark.parametrize("seed,share", [(0, 0.3), (1, 0.9)])
def test_components(spark, seed, share):
    rng, n = random.Random(seed), 400
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * share))] + [(i + n, i + n + 1) for i in range(40)]
    root = list(range(2 * n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}

"""Selections by range queries against a walk over the glyphs."""

import random

import pytest
import regex

from glyphfold.operators import sequences as S

ATOM_DDL = (
    "doc_id int, page int, line_no int, tok_no int, text string, x double, y double, w double, h double, style_key string, "
    "space_before boolean, op_no int, g_start int, g_end int"
)
PIECES = ["a", "b", "́", None, "", "ab", "\r", "\n", "é", "\U0001f468", "‍", "\U0001f469", "क्", "ष", " "]


def line_of(rng, n, plain):
    out = []
    for i in range(n):
        text = rng.choice("abcdef") if plain else rng.choice(PIECES)
        op, start = rng.randint(0, 1), rng.randint(0, 3)
        out.append((text, float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), float(rng.randint(0, 5)), 1.0, rng.choice("st"), rng.random() < 0.4, op, start, start + rng.randint(0, 2)))
    return out


def walk(glyphs, anchor, focus):
    """(start, end, text, runs, slices, box) or None."""
    if not (0 <= anchor < len(glyphs) and 0 <= focus < len(glyphs)):
        return None
    shown = ["￼" if g[0] is None else g[0] for g in glyphs]
    at, ranges = 0, []
    for t in shown:
        ranges.append((at, at + len(t)))
        at += len(t)
    s, e = min(anchor, focus), max(anchor, focus) + 1
    start, end = s, e
    for m in regex.finditer(r"\X", "".join(shown)):
        touch = [i for i, (a, b) in enumerate(ranges) if a < m.end() and b > m.start()]
        if any(s <= i < e for i in touch):
            start, end = min(start, touch[0]), max(end, touch[-1] + 1)
    part = glyphs[start:end]
    text = "".join((" " if i > 0 and g[6] else "") + t for i, (g, t) in enumerate(zip(part, shown[start:end])))
    runs = 1 + sum(a[5] != b[5] for a, b in zip(part, part[1:]))
    slices = []
    for g in part:
        if slices and slices[-1] == list(g[7:10]):
            continue
        if slices and slices[-1][0] == g[7] and slices[-1][2] == g[8]:
            slices[-1][2] = g[9]
            continue
        slices.append(list(g[7:10]))
    x, y = min(g[1] for g in part), min(g[2] for g in part)
    box = x, y, max(g[1] + g[3] for g in part) - x, max(g[2] + g[4] for g in part) - y
    return start, end, text, runs, len(slices), *box


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(11)
    return {(d, 0, n): line_of(rng, rng.choice([1, 2, 3, 8, 17, 33]), plain=d == 0) for d in range(3) for n in range(12)}


def test_selections_against_a_walk(spark, lines):
    rng = random.Random(4)
    atoms = [(*key, 2 * i, *g) for key, glyphs in lines.items() for i, g in enumerate(glyphs)]
    asked = [(i, *rng.choice(list(lines)), rng.randint(-1, 18), rng.randint(-1, 33)) for i in range(600)]
    asked += [(700, 9, 9, 9, 0, 0), (701, 0, 0, 0, None, 1)]
    # Only half of the lines are asked for by most; ties and repeats are wanted.
    rows = spark.createDataFrame(atoms, ATOM_DDL).repartition(7)
    requests = spark.createDataFrame(asked, "req_id int, doc_id int, page int, line_no int, anchor int, focus int")
    got = {r.req_id: r for r in S.select_range(rows, requests).collect()}
    assert len(got) == len(asked)
    for req, d, p, n, anchor, focus in asked:
        want = walk(lines[d, p, n], anchor, focus) if (d, p, n) in lines and anchor is not None else None
        r = got[req]
        assert r.outcome == ("SELECTED" if want else "OUT_OF_RANGE")
        if want:
            assert (r.sel_start, r.sel_end, r.sel_text, r.runs, r.slices, r.x, r.y, r.w, r.h) == want, (req, lines[d, p, n], anchor, focus)
        else:
            assert r.sel_text is None and r.slices is None


def test_warnings_and_decorations(spark):
    glyphs = [(1, 0, 0, i, "a", float(i), 0.0, 1.0, 1.0, "s", False, 0, i, i + 1) for i in range(10)]
    requests = spark.createDataFrame([(1, 1, 0, 0, 2, 4), (2, 1, 0, 0, 7, 7)], "req_id int, doc_id int, page int, line_no int, anchor int, focus int")
    deco = spark.createDataFrame([(1, 0, 0, 2, 4), (1, 0, 0, 4, 8), (1, 0, 0, 0, 2)], "doc_id int, page int, line_no int, start int, end int")
    warned = spark.createDataFrame([(1, 0, 0, []), (1, 0, 0, [(0, 1), (7, 8)]), (1, 0, 0, [(5, 6)])], "doc_id int, page int, line_no int, ranges array<struct<start:int,end:int>>")
    got = {r.req_id: (r.decorations, r.partial_warnings, r.line_warnings) for r in S.select_range(spark.createDataFrame(glyphs, ATOM_DDL), requests, deco, warned).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 2)}


def test_no_request_and_no_line(spark, lines):
    rows = spark.createDataFrame([], ATOM_DDL)
    requests = spark.createDataFrame([(1, 1, 0, 0, 0, 0)], "req_id int, doc_id int, page int, line_no int, anchor int, focus int")
    assert [r.outcome for r in S.select_range(rows, requests).collect()] == ["OUT_OF_RANGE"]
    assert S.select_range(rows, requests.limit(0)).count() == 0


def test_only_what_requests_find_is_written(spark, lines, monkeypatch):
    """The glyphs of a line are not written, however many they are."""
    written = []
    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: written.append(df.count()) or cut(df))
    atoms = [(*key, i, *g) for key, glyphs in lines.items() for i, g in enumerate(glyphs)]
    requests = spark.createDataFrame([(i, *key, 0, 0) for i, key in enumerate(lines)], "req_id int, doc_id int, page int, line_no int, anchor int, focus int")
    assert S.select_range(spark.createDataFrame(atoms, ATOM_DDL), requests).count() == len(lines)
    assert sum(written) <= len(lines)

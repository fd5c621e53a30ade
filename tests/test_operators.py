"""Operators against brute force and at their tolerances."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from glyphfold.functions import geometry as G
from glyphfold.functions import text as T
from glyphfold.operators import checks as C
from glyphfold.operators import joins as J
from glyphfold.operators import sequences as S
from glyphfold.operators import spatial as X
from glyphfold.plans import redaction as R
from glyphfold.sources import files as FS
from glyphfold.sources import layout as L
from glyphfold.sources import manifest as M
from glyphfold.sources import sinks as K


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_occurrences(spark):
    def n(hay, needle):
        return one(spark, T.count_occurrences(F.lit(hay), F.lit(needle)))[0]

    assert (n("aaaa", "aa"), n("abc", ""), n("", "x"), n("a.a.a", "a.")) == (2, 0, 0, 2)


def test_grapheme_widening(spark):
    flags = "🇩🇪🇫🇷x"
    mark = "ae\u0301b"
    for text, start, end, want in [
        (mark, 1, 2, (1, 3)),
        (mark, 2, 3, (1, 3)),
        (mark, 0, 1, (0, 1)),
        (flags, 1, 3, (0, 4)),
        (flags, 2, 3, (2, 4)),
        (flags, 4, 5, (4, 5)),
        ("ab", 2, 2, (2, 2)),
    ]:
        got = one(spark, T.widened_start(F.lit(text), F.lit(start)), T.widened_end(F.lit(text), F.lit(end)))
        assert tuple(got) == want, (text, start, end)


def test_grapheme_rows(spark):
    df = spark.createDataFrame([(1, "aé🇩🇪"), (2, "")], "id bigint, t string")
    rows = [tuple(r)[2:] for r in S.graphemes(df, ["id"], "t").orderBy("cluster_no").collect()]
    assert rows == [(0, 1, "a"), (1, 3, "é"), (3, 5, "🇩🇪")]


def test_searchable_and_names(spark):
    row = one(
        spark,
        T.searchable(F.lit("e\u0301 \u00a0\n\ufeffx")),
        T.sanitise_name(T.nfkc(F.lit(" ABCDEF+x "))),
        T.sanitise_name(T.nfkc(F.lit("ABCDEF+\ufb01\u200bx"))),
        T.sanitise_name(T.nfkc(F.lit(" \u200b "))),
        T.family_key(F.lit("Bold")),
        T.family_key(F.lit("Some Semi-Bold Italic")),
        T.name_key(F.lit(None).cast("string")),
    )
    assert tuple(row) == ("\u00e9x", "ABCDEF+x", "fix", None, "bold", "some", None)


def test_rights(spark):
    def usage(flags):
        return one(spark, G.decode_rights(F.lit(flags)).alias("r")).r

    assert usage(0).usage == "installable" and usage(8).editing_allowed
    assert usage(6).usage == "invalid" and not usage(0x0200).editing_allowed
    assert not usage(0x0108).subsetting_allowed


def test_page_reasons(spark):
    base = dict(x0=0.0, y0=0.0, x1=10.0, y1=20.0, cx0=None, cy0=None, cx1=None, cy1=None, rotate=0, user_unit=1.0)
    cases = [
        ({}, None),
        ({"user_unit": 0.0}, "user-unit"),
        ({"x1": 0.0}, "media-box"),
        ({"y1": float("nan")}, "media-box"),
        ({"cx0": 1.0, "cy0": 1.0, "cx1": 1.0, "cy1": 5.0}, "crop-box"),
        ({"cx0": 30.0, "cy0": 1.0, "cx1": 40.0, "cy1": 5.0}, "empty-intersection"),
        ({"rotate": 45}, "rotation"),
        ({"rotate": -90}, None),
    ]
    schema = "id int, x0 double, y0 double, x1 double, y1 double, cx0 double, cy0 double, cx1 double, cy1 double, rotate int, user_unit double"
    rows = [(i, *{**base, **change}.values()) for i, (change, _) in enumerate(cases)]
    got = G.page_geometry(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert [r.reason for r in got] == [w for _, w in cases]
    assert (got[7].page_width, got[7].page_height) == (20.0, 10.0)


def test_locate_against_brute_force(spark):
    rng = random.Random(2)
    ranges = [(rng.choice([1, 1, 2]), i, s, s + rng.choice([0, 1, 5, 300, 5000, 90_000])) for i, s in enumerate(rng.choices(range(-5000, 90_000), k=120))]
    points = [(rng.choice([1, 1, 2]), i, rng.randint(-6000, 120_000)) for i in range(400)]
    got = X.locate(
        spark.createDataFrame(points, "k int, pid int, p bigint"),
        spark.createDataFrame(ranges, "k int, rid int, s bigint, e bigint"),
        ["k"], "p", "s", "e", ["rid"], ["rid"], ["k", "pid"],
    )
    want = {(k, i): min([r for rk, r, s, e in ranges if rk == k and s <= p < e], default=None) for k, i, p in points}
    assert {(r.k, r.pid): r.rid for r in got.collect()} == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_box_join_against_brute_force(spark, inclusive):
    rng = random.Random(7)

    def boxes(n):
        return [
            (1 if i % 3 else 2, i, float(rng.randint(-90, 90)), float(rng.randint(-90, 90)), float(rng.choice([0, 1, 4, 40, 64, 700])), float(rng.choice([0, 1, 8, 9, 200])))
            for i in range(n)
        ]

    a, b = boxes(150), boxes(60)
    schema = "k int, id int, x double, y double, w double, h double"
    got = X.join_intersects(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ["id"], ["id"], inclusive=inclusive)
    pairs = sorted((r.l_id, r.r_id) for r in got.collect())

    def meet(p, q):
        (_, _, px, py, pw, ph), (_, _, qx, qy, qw, qh) = p, q
        if inclusive:
            return px <= qx + qw and px + pw >= qx and py <= qy + qh and py + ph >= qy
        return px < qx + qw and px + pw > qx and py < qy + qh and py + ph > qy

    assert pairs == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and meet(p, q))


def decoration(spark, **change):
    g = dict(gx0=0.0, gy0=-0.1, gx1=10.0, gy1=-0.1, thickness=0.05, space="rgb", comps=[0.0, 0.0, 0.0], refs=1)
    g.update(change)
    graphics = spark.createDataFrame([(1, 7, *g.values())], "d int, graphic_id int, gx0 double, gy0 double, gx1 double, gy1 double, thickness double, space string, comps array<double>, refs int")
    runs = spark.createDataFrame([(1, 1, 0, 9, 0.0, 0.0, 10.0, 0.0, 1.0, "rgb", [0.0, 0.0, 0.0])], "d int, line_no int, run_start int, run_end int, bx0 double, by0 double, bx1 double, by1 double, em double, space string, comps array<double>")
    row = X.match_decorations(graphics, runs, ["d"]).first()
    return row.kind or row.warning


def test_decoration_tolerances(spark):
    def at(level, **more):
        return decoration(spark, gy0=level, gy1=level, **more)

    assert decoration(spark) == "underline"
    assert (at(-0.35), at(-0.02), at(-0.36), at(-0.01)) == ("underline", "underline", "ambiguous-geometry", "ambiguous-geometry")
    assert (at(0.2), at(0.65), at(0.66)) == ("strikethrough", "strikethrough", "ambiguous-geometry")
    assert (decoration(spark, thickness=0.02), decoration(spark, thickness=0.2)) == ("underline", "underline")
    assert decoration(spark, thickness=0.21) == "ambiguous-geometry"
    assert (decoration(spark, gx1=9.0), decoration(spark, gx1=8.9)) == ("underline", "ambiguous-geometry")
    assert (decoration(spark, gx0=-0.15), decoration(spark, gx0=-0.16)) == ("underline", "ambiguous-geometry")
    assert (decoration(spark, comps=[0.02, 0.0, 0.0]), decoration(spark, comps=[0.03, 0.0, 0.0])) == ("underline", "ambiguous-geometry")
    assert decoration(spark, refs=2) == "shared-content"
    assert decoration(spark, space="gray") == "ambiguous-geometry"


def test_line_assignment_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for page in range(3):
        for i in range(120):
            turned = rng.random() < 0.2
            rows.append((1, page, i, float(rng.randint(0, 60)), rng.randint(0, 120) / 4, rng.choice([1.0, 2.0, 6.0, 9.0]), 0.0 if turned else 1.0, 1.0 if turned else 0.0))
    df = spark.createDataFrame(rows, "doc_id bigint, page int, atom_id bigint, bx double, by double, h double, dx double, dy double")
    want = {}
    for page in range(3):
        lines = []
        for _, _, i, bx, by, h, dx, dy in sorted((r for r in rows if r[1] == page), key=lambda r: (-r[4], r[3], r[2])):
            for n, line in enumerate(lines):
                across = abs((bx - line["o"][0]) * -line["d"][1] + (by - line["o"][1]) * line["d"][0])
                if line["d"] == (dx, dy) and across <= max(1, 0.35 * statistics.median(line["h"])):
                    line["h"].append(h)
                    want[page, i] = n
                    break
            else:
                want[page, i] = len(lines)
                lines.append({"o": (bx, by), "d": (dx, dy), "h": [h]})
    got = {(r.page, r.atom_id): r.line_id for r in S.assign_lines(df).collect()}
    assert got == want


def test_slices_follow_the_fold(spark):
    rng = random.Random(1)
    rows, want = [], []
    for key in range(40):
        s, slices, raw = 0, [], []
        for i in range(25):
            move = rng.choice(["touch", "same", "jump"])
            s = s + 1 if move == "touch" else s if move == "same" else s + 3
            raw.append((s, s + 1))
        for r in raw:
            if slices and slices[-1] == r:
                continue
            if slices and slices[-1][1] == r[0]:
                slices[-1] = (slices[-1][0], r[1])
            else:
                slices.append(r)
        rows += [(key, i, *r) for i, r in enumerate(raw)]
        want += [(key, *r) for r in slices]
    df = spark.createDataFrame(rows, "k int, i int, s int, e int")
    got = S.coalesce_ranges(df, ["k"], ["i"], "s", "e").select("k", "s", "e").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_patches_property(spark):
    rng = random.Random(3)
    docs, patches, want = [], [], {}
    for d in range(60):
        text = "".join(rng.choice("abéß😀 ") for _ in range(40))
        cuts = sorted(rng.sample(range(41), 6))
        mine = [(cuts[i], cuts[i + 1], f"<{i}>") for i in (0, 2, 4)]
        rng.shuffle(mine)
        out = text
        for s, e, r in sorted(mine, reverse=True):
            out = out[:s] + r + out[e:]
        docs.append((d, text))
        patches += [(d, *m) for m in mine]
        want[d] = out
    got = S.apply_patches(
        spark.createDataFrame(docs, "d int, t string"),
        spark.createDataFrame(patches, "d int, start int, end int, replacement string"),
        ["d"],
        "t",
    )
    assert {r.d: r.patched for r in got.collect()} == want


def test_replace_in_runs_property(spark):
    rng = random.Random(6)
    runs, edits, want = [], [], {}
    for d in range(50):
        pieces = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))), rng.choice("xyz")) for _ in range(4)]
        chars = [(c, s, i) for i, (t, s) in enumerate(pieces) for c in t]
        a, b = sorted(rng.choices(range(len(chars) + 1), k=2))
        ins = rng.choice(["", "NEW"])
        at = a - 1 if a == b and a > 0 else a
        tmpl = chars[min(at, len(chars) - 1)]
        new = chars[:a] + [(c, tmpl[1], tmpl[2]) for c in ins] + chars[b:]
        merged = []
        for c, s, i in new:
            if merged and merged[-1][1:] == [s, i]:
                merged[-1][0] += c
            else:
                merged.append([c, s, i])
        if not merged:
            merged = [["", tmpl[1], tmpl[2]]]
        want[d] = [tuple(m) for m in merged]
        runs += [(d, i, t, s, i) for i, (t, s) in enumerate(pieces)]
        edits.append((d, a, b, ins))
    out = R.replace_in_runs(
        spark.createDataFrame(runs, "d int, run_no int, run_text string, style string, src int"),
        spark.createDataFrame(edits, "d int, start int, end int, inserted string"),
        ["d"],
        ["style", "src"],
    ).orderBy("d", "run_no").collect()
    got = {}
    for r in out:
        got.setdefault(r.d, []).append((r.run_text, r.style, r.src))
    assert got == want


def test_nearest_ties(spark):
    atoms = spark.createDataFrame([(1, 3, 0.0, 2.0), (1, 1, 4.0, 2.0), (1, 2, 4.0, 2.0)], "k int, i int, x double, w double")
    points = spark.createDataFrame([(1, 10, 3.0), (1, 11, -5.0), (1, 12, 99.0), (2, 13, 0.0)], "k int, pid bigint, px double")
    got = {r.pid: r.i for r in X.nearest_on_line(points, atoms, ["k"], "pid", "px", "i").collect()}
    assert got == {10: 1, 11: 3, 12: 1, 13: None}


def test_code_table(spark):
    maps = spark.createDataFrame(
        [(1, 0, 10, 12, 0x1F600, None), (1, 1, 11, 11, None, ["ab"]), (2, 0, 0, 70_000, 65, None)],
        "font_id bigint, ordinal int, first int, last int, target int, targets array<string>",
    )
    rows = {(r.font_id, r.code): r.text for r in J.code_table(maps).collect()}
    assert rows == {(1, 10): "😀", (1, 11): "ab", (1, 12): "😂"}


def test_limits_pass_at_the_limit(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 11, 99), (3, 10, 6)], "id int, a bigint, b bigint")
    got = C.apply_limits(df, "id", {"a": 10, "b": 5}).orderBy("id").collect()
    assert [(r.ok, r.resource, r.observed) for r in got] == [(True, None, None), (False, "a", 11), (False, "b", 6)]


def test_relative_paths(spark):
    paths = ["a/b", "/a", "../a", "a/../b", "a\\b", "a..b/c", "a/.."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.ok for r in df.select("p", C.is_relative_path(F.col("p")).alias("ok")).collect()}
    assert [got[p] for p in paths] == [True, False, False, False, False, True, False]


def test_extraction_strictness(spark):
    items = spark.createDataFrame([(1, 1, "new old x", 0.0), (1, 2, "far", 50.0)], "d int, o int, text string, x double").selectExpr("*", "0.0D y", "5.0D w", "1.0D h")
    exp = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 1.0, "old", "new old", 0)], "d int, exp_id int, x double, y double, w double, h double, old_text string, new_text string, expected_outside int")
    strict = R.extraction_evidence(items, exp, ["d"], "o").first()
    loose = R.extraction_evidence(items, exp, ["d"], "o", strict=False).first()
    assert (strict.old_absent, strict.new_present, strict.valid) == (False, True, False)
    assert loose.old_absent is False


def test_auto_fit_rules(spark):
    def box(x, y, w, h):
        return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x, y, w, h), "xywh")])

    def width(need, room, eligible=True):
        return one(spark, R.auto_fit(need, box(0, 0, 10, 2), F.lit(float(room)), F.lit(eligible)))[0]

    assert width(box(0, 0, 15, 1), 20) == 15.0
    assert width(box(0, 0, 15, 1), 15 - 1e-7) == pytest.approx(15.0)
    assert width(box(0, 0, 15, 1), 14) is None
    assert width(box(0, 0, 10, 1), 20) is None
    assert width(box(0, 1.5, 15, 1), 20) is None
    assert width(box(0, 0, 15, 1), 20, False) is None


def test_report_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), "id")
    got = []
    for n in (1, 5):
        K.write_report(df.repartition(n), str(tmp_path / str(n)), ["a", "id"])
        got.append([r.value for r in spark.read.text(str(tmp_path / str(n) / "json")).collect()])
    assert sorted(got[0]) == sorted(got[1])
    a, b = (K.fingerprint_dataset(df.repartition(n)).first() for n in (1, 9))
    assert a == b


def test_manifest_problems(spark):
    bodies = ['{"k": 5}', '{"k": 5, "z": 1}', "{}", '{"k": "x"}', "[]", '{"k": 99}', "nonsense"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: r.problem for r in M.parse_manifest(df, "body", "k int", ranges={"k": (0, 9)}).collect()}
    assert [got[i] for i in range(7)] == [None, "unknown-key", "missing-key", "wrong-type", "not-an-object", "out-of-range", "not-an-object"]


def test_one_or_many(spark):
    df = spark.createDataFrame([(1, '{"w": {"a": 1}}'), (2, '{"w": [{"a": 1}, {"a": 2}]}'), (3, "{}")], "id int, j string")
    rows = df.select("id", F.size(L.one_or_many(F.col("j"), "$.w", "struct<a:int>")).alias("n")).collect()
    assert {r.id: r.n for r in rows} == {1: 1, 2: 2, 3: 0}


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.bin").write_bytes(b"nope")
    files = FS.inventory_files(FS.read_binary(spark, str(tmp_path), "*.bin"))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.collect()}
    assert rows["a.bin"].signature == "%PDF-" and rows["b.bin"].length == 4
    manifest = files.selectExpr("path", "length want_length", "0L min_bytes", "100L max_bytes", "sha256 want_sha256")
    got = {r.path.rsplit("/", 1)[-1]: r.reason for r in FS.verify_files(files, manifest, "%PDF-").collect()}
    assert got == {"a.bin": None, "b.bin": "signature"}

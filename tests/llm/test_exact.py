"""Operators with exact results by whole numbers: ball-tree search, vector codes, substring de-duplication."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward_tables import CLASHING, awkward, empty, prose, vocabulary  # noqa: F401
from brute import PLAIN, SMALL as LOWER, SPACED, sha256

from glyphfold.llm import ball_tree, substring_dedup, vector_codes

# ---- ranked search


def terms_of(text):
    return PLAIN.findall((text or "").translate(LOWER))


def ranking(docs, items, top=10):
    """{item: [(doc_id, score), ...]} of (doc_id, text) and (item_id, text) rows."""
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    total = sum(sum(c.values()) for _, c in counted)
    n = sum(bool(c) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms_of(text))
    out = {}
    for item, words in wanted.items():
        scored = []
        for doc, c in counted:
            score = 0
            for t in words & c.keys():
                norm = 10 + (90 * sum(c.values()) * n) // total
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * norm))
            if score > 0:
                scored.append((doc is None, doc or 0, -score))
        best = sorted(scored, key=lambda s: (s[2], s[0], s[1]))[:top]
        if best:
            out[item] = [(None if none else doc, -score) for none, doc, score in best]
    return out


def found(frame):
    rows = sorted(frame.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r["rank"]))
    out = defaultdict(list)
    for r in rows:
        out[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return dict(out)


@pytest.fixture(scope="module")
def items():
    rng, words = random.Random(5), vocabulary(1)
    rows = [(i, prose(rng, words, 12)) for i in range(20)]
    return rows + [(20, None), (21, ""), (22, "zzzunknown"), (3, words[0] + " " + words[1]), (None, prose(rng, words, 5)), (23, words[7].upper())]


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranking_against_brute_force(spark, awkward, items, partitions):
    rows, frame = awkward
    table = spark.createDataFrame(items, "item_id long, text string")
    want = ranking([(r[0], r[1]) for r in rows], items)
    assert found(ball_tree.digest(frame.repartition(partitions), table)) == want
    # Items in several blocks.
    assert found(ball_tree.search(frame, table, block_terms=60)) == want


def test_ranking_of_small_trees_and_ties(spark, monkeypatch):
    rng, words = random.Random(2), [f"w{i}" for i in range(60)]
    docs = [(i // 2, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(40)] + [(5000, "w4 " * 30_000)]
    queries = [(i, " ".join(rng.sample(words, 4))) for i in range(15)] + [(99, "w1 w2 w3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    table = spark.createDataFrame(queries, "item_id long, text string")
    assert found(ball_tree.digest(frame, table)) == ranking(docs, queries)


def test_ranking_of_empty_tables(spark, empty, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ball_tree.digest(empty, table).count() == 0
    assert ball_tree.digest(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), table.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    # Two groups of rows over different columns, as of two languages.
    rows = [np.sort(rng.choice(200, 30, replace=False)) + 200 * (i % 2) for i in range(600)]
    starts = np.cumsum([0] + [len(r) for r in rows])
    columns, values = np.concatenate(rows), rng.integers(1, 900_000, starts[-1])
    tree = ball_tree.BallTree(starts, columns, values, 400)
    dense = np.zeros((600, 400), np.int64)
    for i, r in enumerate(rows):
        dense[i, r] = values[starts[i] : starts[i + 1]]
    below = {}

    def members(node):
        if node not in below:
            below[node] = tree.members[node] if tree.members[node] is not None else np.concatenate([members(c) for c in tree.children[node]])
        return below[node]

    looked = 0
    for _ in range(20):
        at = np.sort(rng.choice(200, 6, replace=False))
        weights = rng.integers(0, 20_000, 6)
        bound = tree.bounds(at, weights)
        scores = dense[:, at] @ weights
        for node in range(len(tree.radius)):
            assert scores[members(node)].max() <= bound[node]
        dots, seen = tree._dots, []
        tree._dots = lambda r, d: seen.append(len(r)) or dots(r, d)
        best = tree.search(at, weights, [], 10, [(True, -i, -i) for i in range(600)])
        tree._dots = dots
        looked += sum(seen)
        order = sorted(range(600), key=lambda i: (-scores[i], i))[:10]
        assert sorted(best, reverse=True) == [(scores[i], True, -i, -i) for i in order if scores[i] > 0]
    assert sorted(members(0).tolist()) == list(range(600))
    # Rows of the other group are never scored.
    assert looked <= 20 * 330


# ---- vector codes


def lloyd(rows, parts=8, entries=16, rounds=6):
    """{vec_id: (code, error, label_error, sha)} of (vec_id, vector, label) rows."""
    clean = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    clean.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[math.floor(4096 * x) for x in r[1]] for r in clean]
    size = len(vectors[0]) // parts
    cut = [[tuple(v[k * size : (k + 1) * size]) for v in vectors] for k in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return min(range(len(book)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        for k in range(parts):
            groups = defaultdict(list)
            for x in cut[k]:
                groups[nearest(x, books[k])[0]].append(x)
            for e, group in groups.items():
                books[k][e] = tuple(sum(c) // len(group) for c in zip(*group, strict=True))
    sha = sha256(",".join(str(x) for book in books for c in book for x in c))
    coded = []
    for i in range(len(clean)):
        got = [nearest(cut[k][i], books[k]) for k in range(parts)]
        coded.append(("".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)))
    total = Counter()
    for r, (_, error) in zip(clean, coded, strict=True):
        total[r[2]] += error
    return [(r[0], code, error, total[r[2]], sha) for r, (code, error) in zip(clean, coded, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


def by_row(rows):
    return sorted(map(repr, map(tuple, rows)))


def clustered(seed, n, dims=16):
    """Vectors about a few centres, many of them equal, as floats of 32 bits."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    made = centres[rng.integers(0, 12, n)] + rng.normal(0, rng.choice([0, 0.01, 0.3], n)[:, None], (n, dims))
    return [[float(x) for x in v.astype(np.float32)] for v in made]


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes_against_brute_force(spark, partitions):
    vectors = clustered(1, 400)
    rows = [(i * 3 % 401, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [float("nan")] + vectors[0][1:], 1), (902, [float("inf")] + vectors[0][1:], 2), (903, [None] + vectors[0][1:], 2)]
    rows += [(904, vectors[3], 1), (904, vectors[3], 1), (None, vectors[5], None), (3, vectors[9], 2), (-5, vectors[8], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    for name in CLASHING + ["rows", "code_", "_id", "_vector"]:
        frame = frame.selectExpr("*", f"'x' AS {name}") if name not in frame.columns else frame
    got = vector_codes.digest(frame.repartition(partitions)).collect()
    assert by_row(got) == by_row(lloyd(rows))


def test_codes_of_few_odd_and_large_vectors(spark):
    few = [(i, v, 0) for i, v in enumerate(clustered(2, 5))]
    assert by_row(vector_codes.digest(spark.createDataFrame(few, VECTORS)).collect()) == by_row(lloyd(few))
    odd = vector_codes.digest(spark.createDataFrame(few + [(9, [1.0, 2.0], 0), (10, [3e38] * 16, 1)], VECTORS)).collect()
    assert len(odd) == 7 and [r.code for r in odd if r.vec_id == 9] == [None]
    assert [len(r.code) for r in odd if r.vec_id == 10] == [16]
    assert vector_codes.digest(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.digest(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    assert [r.code for r in vector_codes.digest(spark.createDataFrame([(1, [1.0], 1), (2, [], 1)], VECTORS)).collect()] == [None, None]


def test_decoded_codes_have_the_error_they_say(spark):
    rows = [(i, v, 0) for i, v in enumerate(clustered(4, 60))]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
    for r in vector_codes.decode(coded, books).collect():
        want = [math.floor(4096 * x) for x in rows[r.vec_id][1]]
        assert r.error == sum((a - b) ** 2 for a, b in zip(want, r.decoded, strict=True))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    points = vector_codes.whole(rng.normal(0, 0.02, (4000, 4)) + rng.integers(0, 4, 4000)[:, None] * 2.0)
    tree = vector_codes.Tree.unpack(vector_codes.Tree.build(points).pack())
    assert sorted(tree.order.tolist()) == list(range(4000))
    inner = points[tree.order]
    for node in range(len(tree.radius)):
        mine = inner[tree.begin[node] : tree.end[node]]
        assert (mine.sum(axis=0) == tree.total[node]).all()
        assert (np.sqrt(((mine - tree.centre[node]) ** 2).sum(axis=1)) <= tree.radius[node]).all()
    entries = np.array([[8192 * k] * 4 for k in range(4)])
    sums, numbers, who, _ = tree.assign(inner, entries)
    chosen = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.codes(inner, entries) == chosen[tree.order]).all()
    assert numbers.tolist() == np.bincount(chosen, minlength=4).tolist()
    assert all((sums[e] == points[chosen == e].sum(axis=0)).all() for e in range(4))
    # Four tight clusters: no point is looked at.
    assert (who >= 0).all() and len(who) < 20


# ---- substrings


def without_repeats(rows, window=13):
    """[(doc_id, kept text, words, removed words)] of (doc_id, text) rows."""
    split = [(doc if doc is not None else (1 << 63) - 1, SPACED.findall(text or "")) for doc, text in rows]
    low = {}
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            low[key] = min(low.get(key, doc), doc)
    out = []
    for (doc, _), (rank, words) in zip(rows, split, strict=True):
        gone = {k for i in range(len(words) - window + 1) if low[tuple(words[i : i + window])] < rank for k in range(i, i + window)}
        out.append((doc, " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone)))
    return out


def shared_rows():
    rng, words = random.Random(8), vocabulary(3, 500)
    common = prose(rng, words, 60)
    rows = [(i, f"{prose(rng, words, rng.randint(0, 90))} {common if i % 3 == 0 else ''} {prose(rng, words, 20)}") for i in range(90)]
    rows += [(200 + i, rows[4][1]) for i in range(12)]
    rows += [(300, "ha " * 400), (301, "ha\n" * 30), (301, "ha ha " * 20), (302, "Ha " * 13), (303, "ha " * 12), (304, "tick tock " * 200)]
    rows += [(None, rows[7][1]), (None, rows[7][1]), (None, common + " x"), (305, None), (306, ""), (307, " \t\n "), (308, "a b " * 14)]
    rows += [(50, common), (50, common), (1, rows[2][1]), (400, " ".join(f"u{i}" for i in range(4_000)) + " " + common)]
    return rows


@pytest.mark.parametrize("group_words", [1_500_000, 2_000, 100])
def test_removed_windows_against_brute_force(spark, group_words):
    rows = shared_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING + ["bucket", "_hash", "_marks", "n_words"]:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    got = substring_dedup.remove_repeats(frame.repartition(6), group_words=group_words)
    assert by_row(got.collect()) == by_row(without_repeats(rows))


def test_removed_windows_of_awkward_and_empty_tables(spark, awkward, empty):
    rows, frame = awkward
    got = substring_dedup.digest(frame).collect()
    want = [(doc, n, gone, sha256(text)) for doc, text, n, gone in without_repeats([(r[0], r[1]) for r in rows])]
    assert by_row(got) == by_row(want)
    assert substring_dedup.digest(empty).count() == 0


@pytest.mark.parametrize("window", [2, 3, 20])
def test_other_windows(spark, window):
    rows = shared_rows()[:95]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    assert by_row(got.collect()) == by_row(without_repeats(rows, window))


def test_groups_are_cut_where_they_are_read(spark):
    # Nothing is dealt out beforehand, so that large groups must be cut.
    rows = shared_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = substring_dedup.remove_repeats(frame, group_words=50, dealt=0)
    assert by_row(got.collect()) == by_row(without_repeats(rows))


def test_equal_hashes_are_told_apart(monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 5_000).astype(np.int32)
    at = np.arange(len(words) - 3)
    monkeypatch.setattr(substring_dedup, "_window_hashes", lambda w, k: (w[: len(w) - k + 1] % 2).astype(np.uint64))
    order, new = substring_dedup.ranks(words, at, 4)
    runs = [tuple(words[i : i + 4]) for i in at[order]]
    assert new.sum() == len(set(runs)) and all((a != b) == bool(n) for a, b, n in zip(runs, runs[1:], new[1:], strict=False))


def test_super_kmers_hold_each_window_once():
    rng, words = random.Random(1), vocabulary(2, 300)
    texts = [prose(rng, words, n).encode() for n in (0, 5, 13, 14, 200, 1000)] + [b"x " * 300]
    chunk = substring_dedup.Chunk(texts, 50, 13)
    seen = []
    for first, count in zip(chunk.first.tolist(), chunk.count.tolist(), strict=True):
        assert chunk.owner[first] == chunk.owner[first + count + 11] and 1 <= count <= substring_dedup.RUN
        seen += range(first, first + count)
    sizes = [len(t.split()) for t in texts]
    assert len(seen) == len(set(seen)) == sum(max(0, n - 12) for n in sizes)
    # Strings of several windows, not one for each.
    assert len(chunk.first) < len(seen) / 4


def test_digests_are_of_utf8(spark):
    got = substring_dedup.digest(spark.createDataFrame([(1, "é  ü")], "doc_id long, text string")).first()
    assert got.kept_sha256 == hashlib.sha256("é ü".encode()).hexdigest()

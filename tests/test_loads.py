"""Verified loads, copy-on-write upserts, walks of shared resources, targets of points."""

import os
import random
import time

import pytest

from glyphfold.operators import aggregates as A
from glyphfold.operators import joins as J
from glyphfold.operators import spatial as X
from glyphfold.sources import corpus
from glyphfold.sources.sinks import fingerprint_dataset


def test_nothing_is_handed_on_unless_it_matches(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 3 else None) for i in range(50)]
    path, ddl = str(tmp_path / "t"), "k bigint, v string"
    spark.createDataFrame(rows, ddl).write.parquet(path)
    mark = fingerprint_dataset(spark.createDataFrame(rows, ddl)).first()
    table, outcome = corpus.load_verified(spark, "t", path, ddl, 50, mark["sha256"])
    assert outcome.outcome == "LOADED" and sorted(map(tuple, table.collect())) == sorted(rows)
    # What was audited is handed on, whatever happens to the source later.
    spark.createDataFrame(rows[:3], ddl).write.mode("overwrite").parquet(path)
    assert table.count() == 50
    for args, want in [((50, mark["sha256"]), "ROWS_MISMATCH"), ((3, mark["sha256"]), "DIGEST_MISMATCH")]:
        table, outcome = corpus.load_verified(spark, "t", path, ddl, *args)
        assert (outcome.outcome, outcome.rows, table.count()) == (want, 3, 0) and table.schema.simpleString() == "struct<k:bigint,v:string>"
    table, outcome = corpus.load_verified(spark, "t", path, "k int, v string", 3, "x")
    assert (outcome.outcome, outcome.expected, outcome.observed) == ("SCHEMA_MISMATCH", "k int, v string", "k bigint, v string")
    empty = fingerprint_dataset(spark.createDataFrame([], ddl)).first()
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(path)
    assert corpus.load_verified(spark, "t", path, ddl, empty["rows"], empty["sha256"])[1].outcome == "LOADED"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "k bigint, v string, p string"
    base = [(i, f"v{i}", f"p{i % 5}") for i in range(50)] + [(None, "none", "p4"), (None, "none too", "p3"), (60, "x", None), (61, "alone", "a b/c"), (62, "left", "p9")]
    spark.createDataFrame(base, ddl).write.partitionBy("p").parquet(path)
    before = files_of(path)
    time.sleep(0.05)
    changes = [(1, "old", "p1", 1), (1, "new", "p1", 2), (100, "added", "p7", 1), (None, "one", "p4", 1), (61, "moved", "p9", 1), (60, "y", None, 1), (1, "older", "p2", 0)]
    J.upsert_table(spark, path, spark.createDataFrame(changes, ddl + ", n int"), ["k"], "p", ["n"])
    final = {1: ("new", "p1"), 100: ("added", "p7"), None: ("one", "p4"), 61: ("moved", "p9"), 60: ("y", None)}
    want = [r for r in base if r[0] not in final] + [(k, *r) for k, r in final.items()]
    got = [tuple(r) for r in spark.read.schema(ddl).parquet(path).select("k", "v", "p").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    after = files_of(path)
    same = {f for f in before if after.get(f) == before[f]}
    # Neither read nor written: where no changed key is or goes.
    assert {f.split("/p=")[1].split("/")[0] for f in same} == {"p0", "p2"}
    assert not any("a b" in f or "a%20b" in f for f in after)


def test_last_change_of_a_key(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 2), (None, "d", 1), (None, "e", 0), (2, None, 5)]
    df = spark.createDataFrame(rows, "k bigint, v string, n int")
    got = sorted(map(repr, map(tuple, J.last_changes(df.repartition(4), ["k"], ["n"]).collect())))
    assert got == sorted(map(repr, [(1, "c", 2), (None, "d", 1), (2, None, 5)]))
    base = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (9, "w")], "k bigint, v string")
    got = sorted(map(repr, map(tuple, J.upsert(base, df, ["k"], ["n"]).collect())))
    assert got == sorted(map(repr, [(1, "c"), (None, "d"), (2, None), (9, "w")]))


def walked(roots, edges, limit):
    out = []
    for root in roots:
        todo = [(root, 0, (root,), "OK")]
        while todo:
            node, depth, path, status = todo.pop()
            out.append((root, node, depth, path, status))
            if status == "OK":
                for a, b in edges:
                    if a == node:
                        bad = "MALFORMED_INPUT" if b in path else "RESOURCE_LIMIT" if depth + 1 > limit else "OK"
                        todo.append((b, depth + 1, (*path, b), bad))
    return sorted(out)


@pytest.mark.parametrize("limit", [0, 1, 2, 12])
def test_walks_with_roots_that_are_resources_too(spark, limit):
    rng = random.Random(limit)
    for _ in range(3):
        nodes = list(range(9))
        edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(12)})
        # Roots on cycles, a root that uses itself, and roots that only use.
        edges += [(20, 1), (20, 2), (21, 1), (22, 22)]
        roots = [0, 1, 2, 20, 21, 22, 30]
        got = A.walk_resources(spark.createDataFrame([(r,) for r in roots], "root bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"), limit)
        assert sorted((r.root, r.node, r.depth, tuple(r.path), r.status) for r in got.collect()) == walked(roots, edges, limit)


def test_targets_at_the_edge_of_reach(spark):
    atoms = [(1, 1, 1, 0.0, 0.0, 2.0, 1.0), (1, 1, 2, 4.0, 0.0, 2.0, 1.0), (1, 2, 1, 0.0, -20.0, 2.0, 1.0)]
    groups = [(1, 1, 0, 1, 2), (1, 1, 1, 2, 3)]
    points = [(1, 1, 1.0, 5.0), (1, 2, 1.0, 5.01), (1, 3, 3.0, -4.0), (1, 4, 4.5, 0.5), (1, 5, 9.0, -22.0), (2, 6, 0.0, 0.0)]
    got = X.point_targets(
        spark.createDataFrame(points, "d int, point_id bigint, px double, py double"),
        spark.createDataFrame(atoms, "d int, line_no int, tok_no int, x double, y double, w double, h double"),
        spark.createDataFrame(groups, "d int, line_no int, group_no int, start int, end int"),
        ["d"],
    )
    seen = {r.point_id: (r.line_no, r.tok_no, r.distance, r.group_no) for r in got.collect()}
    assert seen == {
        1: (1, 1, 0.0, 0),
        2: (None, None, None, None),
        3: (1, 1, 2.0, 0),  # as near to the second: the lower one
        4: (1, 2, 0.0, 1),
        5: (2, 1, 8.0, None),  # no group owns it
        6: (None, None, None, None),
    }

"""Line assignment by sweep bands against the plain greedy walk."""

import random
import statistics

import pytest

from glyphfold.operators import sequences as S

DDL = "doc_id int, page int, atom_id int, bx double, by double, h double, dx double, dy double, extra string"


def greedy(atoms):
    lines, out = [], {}
    for a in sorted(atoms, key=lambda a: (-a[4], a[3], a[2])):
        _, _, i, bx, by, h, dx, dy, _ = a
        for n, (ox, oy, lx, ly, hs) in enumerate(lines):
            if abs((by - oy) * lx - (bx - ox) * ly) <= max(1.0, 0.35 * statistics.median(hs)) and lx * dx + ly * dy >= S.PARALLEL:
                hs.append(h)
                out[i] = n
                break
        else:
            out[i] = len(lines)
            lines.append((bx, by, dx, dy, [h]))
    return out


def pages(kind):
    rng = random.Random(kind)
    rows = []
    for page in range(12):
        for i in range(rng.choice([1, 5, 60])):
            turned = {"turned": rng.random() < 0.3, "nearly": rng.random() < 0.2}.get(kind, False)
            angle = (0.0, 1.0) if kind == "turned" else (0.99995, 0.0099998)
            step = 8.0 if kind == "apart" else rng.choice([0.4, 1.0, 2.0])
            by = -step * rng.randint(0, 12) + (rng.choice([0.0, 0.3]) if kind == "apart" else rng.random())
            rows.append((page % 3, page, i, float(rng.randint(0, 50)), by, rng.choice([1.0, 2.0, 9.0]), *(angle if turned else (1.0, 0.0)), f"e{i}"))
    return rows


@pytest.mark.parametrize("kind", ["apart", "close", "turned", "nearly"])
def test_bands_give_the_greedy_lines(spark, kind):
    rows = pages(kind)
    got = {(r.page, r.atom_id): (r.line_id, r.extra) for r in S.assign_lines(spark.createDataFrame(rows, DDL)).collect()}
    assert len(got) == len(rows)
    for page in range(12):
        mine = [r for r in rows if r[1] == page]
        for i, line in greedy(mine).items():
            assert got[page, i] == (line, f"e{i}")


def test_separable_pages_need_no_python(spark):
    # Shallow lines, far apart.
    rows = [(1, 0, i, float(i % 7), -8.0 * (i // 7) + 0.2 * (i % 3), 2.0, 1.0, 0.0, "") for i in range(200)]
    apart = S.assign_lines(spark.createDataFrame(rows, DDL).coalesce(1))
    assert "InArrow" not in apart._jdf.queryExecution().toString() and apart.count() == 200
    close = S.assign_lines(spark.createDataFrame(pages("close"), DDL))
    assert "InArrow" in close._jdf.queryExecution().toString()


def test_bands_of_one_line_are_decided_beside_unclear_ones(spark):
    rows = [(1, 0, i, float(i), 100.0 - 50.0 * (i // 10), 1.0, 1.0, 0.0, "") for i in range(20)]
    rows += [(1, 0, 20 + i, float(i), 0.0 - 0.9 * i, 1.0, 1.0, 0.0, "") for i in range(5)]
    banded = S.line_bands(spark.createDataFrame(rows, DDL))
    plain = {r.atom_id: r["_plain"] for r in banded.collect()}
    assert all(plain[i] for i in range(20)) and not any(plain[i] for i in range(20, 25))

"""Font requirements (JON5): against all pairs, and without their product."""

import random

from glyphfold.operators import joins as J

FONT_DDL = (
    "font_id bigint, name_key string, family_key string, weight int, italic boolean, code_points array<int>, source string, "
    "hash string, metrics string, subfamily string"
)
REQ_DDL = (
    "req_id bigint, name_key string, family_key string, weight int, italic boolean, code_points array<int>, hash string, "
    "metrics string, subfamily string"
)
SOURCES = ["embedded", "local", "upload", "bundled", None]


def best(req, fonts):
    _, name, family, weight, italic, need, digest, metrics, sub = req
    found = []
    for font_id, fname, ffamily, fweight, fitalic, cover, source, fdigest, fmetrics, fsub in fonts:
        if need is None or not set(need) <= set(cover):
            continue
        style = None not in (weight, italic) and (weight, italic) == (fweight, fitalic) and (sub is None or sub == fsub)
        named = style and (name is not None and name == fname or family is not None and family == ffamily)
        if digest is not None and digest == fdigest:
            cls = 0
        elif named:
            cls = 0 if metrics is not None and metrics == fmetrics else 1
        else:
            cls = 2
        found.append((cls, not style, SOURCES.index(source), font_id))
    return min(found, default=None)


def test_requirements_against_all_pairs(spark):
    rng = random.Random(8)

    def one(i):
        own = [rng.choice("ab"), rng.choice("xy"), rng.choice([400, 700]), rng.random() < 0.5]
        return own, [rng.choice(["h1", "h2", "h3", None]), rng.choice(["m1", "m2", None]), rng.choice(["s", "t", None])]

    fonts = []
    for i in range(60):
        own, rest = one(i)
        fonts.append((i, *own, rng.choice([[97], [97, 98], [98, 99], [97, 98, 99]]), rng.choice(SOURCES), *rest))
    reqs = []
    for i in range(300):
        own, rest = one(i)
        own = [None if rng.random() < 0.1 else v for v in own]
        reqs.append((i, *own, rng.choice([[], [97], [98, 98], [99, 97], [100], None]), *rest))
    kinds = ["exact", "compatible-version", "substitute"]
    got = J.resolve_requirements(spark.createDataFrame(reqs, REQ_DDL), spark.createDataFrame(fonts, FONT_DDL)).collect()
    assert len(got) == len(reqs)
    for r in got:
        want = best(reqs[r.req_id], fonts)
        assert (r.kind, r.font_id) == ((kinds[want[0]], want[3]) if want else ("unavailable", None)), reqs[r.req_id]


def joined_rows(plan):
    """Rows that each join of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]


def test_requirements_of_a_key_do_not_multiply_its_fonts(spark):
    fonts = [(i, "n", "f", 400, False, [97], "local", "h", f"m{i}", None) for i in range(80)]
    reqs = [(i, "n", "f", 400, False, [97], "h" if i % 2 else None, f"m{i}", None) for i in range(80)]
    out = J.resolve_requirements(spark.createDataFrame(reqs, REQ_DDL), spark.createDataFrame(fonts, FONT_DDL))
    assert {r.req_id: (r.kind, r.font_id) for r in out.collect()} == {
        i: ("exact", 0 if i % 2 else i) for i in range(80)
    }
    made = joined_rows(out._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 2 * len(reqs)

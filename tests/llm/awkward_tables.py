"""Small tables with awkward rows for the operators of the training-data subpackage."""

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use for columns of their own.
CLASHING = ["_id", "_h1", "_pos", "_drop", "kept", "rate", "host", "length", "token", "node", "component", "piece", "_text", "_rep"]


def vocabulary(seed, size=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(size)]


def prose(rng, words, n):
    out = []
    for i in range(n):
        out.append(rng.choice(words))
        if i % 17 == 16:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def awkward_rows(seed=3):
    """Near and exact copies, shared lines, leaks, junk, nulls, empty and very long texts, repeated rows."""
    rng, words = random.Random(seed), vocabulary(seed)
    rows, doc = [], 0

    def add(text, lang="en", source="src0"):
        nonlocal doc
        rows.append((doc, text, lang, source, None if text is None else len(text)))
        doc += 1

    shared = "This very line of more than forty characters stands in many documents."
    for i in range(40):
        text = prose(rng, words, rng.randint(30, 200))
        add(text + (f"\n  {shared.upper() if i % 2 else shared}\t" if i % 3 == 0 else ""), source=f"src{i % 4}")
    base = prose(rng, words, 120).split(" ")
    for edits in (0, 0, 1, 2, 3, 4, 6, 9, 15):
        copy = list(base)
        for at in rng.sample(range(len(copy)), edits):
            copy[at] = rng.choice(words)
        add(" ".join(copy))
    add(prose(rng, words, 4000))
    add("x" * 50_000)
    add("word " * 500)
    for text in (None, "", " \n\t\n ", "one", "two words", "é è ñ ß", "a b c d", "a b c d", "%%% ### *** $$$ " * 30, "\n" * 40):
        add(text, lang=None, source=None)
    rows.append(rows[0])
    rows.append(rows[41])
    rows.append((None, prose(rng, words, 60), "en", None, 5))
    rows.append((None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows, and the frame with extra columns whose names clash."""
    rows = awkward_rows()
    frame = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'{name}' AS {name}")
    return rows, frame.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)

"""Language identification by a sparse linear model over character n-grams.

* Letters are lower-cased, every run of other characters is one space, and
  n-grams of one to four characters are hashed into ``buckets``.
* Document frequencies of the buckets are counted over all training documents,
  as one Spark job, and weigh the term frequencies (TF-IDF).
* A multinomial logistic regression is fitted on a sample of at most about
  ``sample_per_lang`` training documents of each language, by
  follow-the-regularised-leader with an L1 and an L2 penalty, which leaves most
  weights at zero.  Its features are made in tasks; the driver gets the sparse
  vectors of the sample, whose size these two parameters bound.
* A temperature, fitted on a fifth of the sample that the weights have not
  seen, scales the scores into calibrated probabilities.

Prediction is a sum of table rows over the n-grams of a text, inside Arrow
batches; nothing is shuffled.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text when there is nothing to learn from; rows with a null language or
id are no training rows for the former and ordinary ones for the latter
(``held_out`` false); repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SAMPLE_PER_LANG = 500
UNKNOWN = "und"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (a space if no letter), and whether it is a letter."""
    lower = np.full(0x110000, 32, np.uint32)
    letter = np.zeros(0x110000, bool)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            letter[point] = True
            small = char.lower()
            lower[point] = ord(small) if len(small) == 1 else point
    return lower, letter


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every n-gram of a text; empty without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, letter = _letters()
    if not len(points) or not letter[points].any():
        return np.empty(0, np.int64)
    small = lower[points]
    small = np.concatenate([[32], small[(small != 32) | np.append(True, small[:-1] != 32)], [32]]).astype(np.uint32)
    found = []
    grown = np.zeros(len(small), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(small) < order:
            break
        here = len(small) - order + 1
        grown = grown[:here] * np.uint32(0x01000193) + small[order - 1 :]
        if order in ORDERS:
            mixed = (grown ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            found.append((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - int(math.log2(buckets))))
    return np.concatenate(found).astype(np.int64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(train: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> tuple[np.ndarray, dict[str, int]]:
    """Documents that hold each bucket, and documents of each language, over all of ``train``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        flags = np.zeros(buckets, bool)
        langs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                flags[ngrams(text.as_py(), buckets)] = True
                seen += flags
                flags[:] = False
                langs[lang.as_py()] = langs.get(lang.as_py(), 0) + 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(used) + list(langs), pa.string()),
                pa.array(used.tolist() + [-1] * len(langs), pa.int64()),
                pa.array(seen[used].tolist() + list(langs.values()), pa.int64()),
            ],
            names=["lang", "bucket", "n"],
        )

    counted = train.select(text_col, lang_col).mapInArrow(count, "lang string, bucket long, n long")
    # At most one row for each bucket and language.
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(buckets, np.int64)
    plain = rows[rows["bucket"] >= 0]
    seen[plain["bucket"].to_numpy()] = plain["n"].to_numpy()
    langs = rows[rows["bucket"] < 0]
    return seen, dict(sorted(zip(langs["lang"], langs["n"].astype(int), strict=True)))


def sampled_vectors(
    train: DataFrame, id_col: str, text_col: str, lang_col: str, langs: dict[str, int], per_lang: int, buckets: int = BUCKETS
) -> pd.DataFrame:
    """(lang, fold, buckets, counts) of a sample: rows by the hash of their id, as many as make up the wanted share."""
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003))
    share = F.create_map(*[x for lang, n in langs.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n) * 1_000_003))])
    chosen = train.select(
        F.col(lang_col).alias("lang"), (place % 5).cast("long").alias("fold"), F.col(text_col).alias("text"), place.alias("at")
    ).filter(F.col("at") < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.unique(ngrams(text.as_py(), buckets), return_counts=True) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                    pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                ],
                names=["lang", "fold", "buckets", "counts"],
            )

    out = "lang string, fold long, buckets array<int>, counts array<int>"
    # A limit in case the hash deals unevenly; with even hashes it is never reached.
    return chosen.drop("at").mapInArrow(vectors, out).limit(3 * per_lang * max(1, len(langs))).toPandas()


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    dims: int,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-4,
    seed: int = 7,
) -> np.ndarray:
    """Weights (dims, classes): each step moves to the regularised leader of all gradients so far.

    ``examples`` are (dimensions, values, class).  A weight stays exactly zero
    until its summed gradient exceeds the L1 penalty.
    """
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def leader(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * l1 - zs
        return np.where(np.abs(zs) <= l1, 0.0, shrunk / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            dims_i, values, label = examples[i]
            zs, ns = z[dims_i], n[dims_i]
            weights = leader(zs, ns)
            scores = values @ weights
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            chance[label] -= 1.0
            gradient = values[:, None] * chance[None, :]
            step = (np.sqrt(ns + gradient**2) - np.sqrt(ns)) / alpha
            z[dims_i] += gradient - step * weights
            n[dims_i] += gradient**2
    return leader(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The factor on the scores that makes the labels most likely, by golden-section search."""

    def loss(log_factor: float) -> float:
        scaled = scores * math.exp(log_factor)
        top = scaled.max(axis=1)
        return float((np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[np.arange(len(labels)), labels]).mean())

    low, high, ratio = math.log(1e-2), math.log(1e2), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass(frozen=True)
class Model:
    """Languages and, for each bucket, what one n-gram adds to their scores."""

    langs: list[str]
    table: np.ndarray
    factor: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text, len(self.table) or BUCKETS)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        # In slices, so that a long text needs no more memory than a short one.
        total = sum(self.table[found[i : i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, len(found), 65536))
        scores = total / len(found) * self.factor
        chance = np.exp(scores - scores.max())
        best = int(chance.argmax())
        return self.langs[best], float(chance[best] / chance.sum())


#: Brings mean TF-IDF values near one; the learning rate is per coordinate, so this only sets the scale of the penalties.
SCALE = 100.0


def train_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_lang: int = SAMPLE_PER_LANG,
    buckets: int = BUCKETS,
) -> Model:
    train = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen, langs = document_frequencies(train, text_col, lang_col, buckets)
    if not langs:
        return Model([], np.zeros((buckets, 1), np.float32), 1.0)
    names = list(langs)
    weight = SCALE * np.log((1 + sum(langs.values())) / (1 + seen))
    sample = sampled_vectors(train, id_col, text_col, lang_col, langs, sample_per_lang, buckets)
    examples, later = [], []
    for lang, fold, dims, counts in sample.itertuples(index=False):
        if len(dims):
            values = np.asarray(counts) / np.sum(counts) * weight[np.asarray(dims)]
            (later if fold == 0 else examples).append((np.asarray(dims), values, names.index(lang)))
    weights = fit_ftrl(examples or later, len(names), buckets)
    later = later or examples
    factor = 1.0
    if later:
        scores = np.stack([values @ weights[dims] for dims, values, _ in later])
        factor = fit_temperature(scores, np.array([label for *_, label in later]))
    return Model(names, (weight[:, None] * weights).astype(np.float32), factor)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # A few megabytes at most: buckets times languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    found = predict(docs, train_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

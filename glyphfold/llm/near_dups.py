"""Near-duplicate documents: circulant MinHash, banding, exact verification.

1. Each text becomes the set of its 5-word shingles.  One permutation scatters
   the set over a circle of ``CIRCLE`` places; coordinate k of the signature is
   the smallest value that a second permutation, shifted by k places, has on
   the set.  Two permutations thus give all coordinates, and a document's
   coordinates are the column minima of runs of one array.
2. Equal sets are one class from here on, whatever the number of copies.
   Classes are numbered in the order of their smallest ids, so a number is one
   class's own even where rows share an id, and the smallest number of a group
   has its smallest id.
3. Signatures are cut into bands.  Classes that agree in a band meet its
   smallest member; the connected groups of these stars are candidate clusters.
   A pair of similarity 0.85 agrees in no band with probability 3e-7 (32 bands
   of 6 coordinates), higher similarities much less.
4. Inside a cluster all pairs are verified on the full sets.  A cluster is cut
   into blocks by members and by shingles; each pair of blocks is one bounded
   group.  Not the pairs, only edges that keep their connections leave a task.
5. Components of the verified links, carried back to all copies.

Shingles are compared by 64-bit hashes, classes by 128 bits.  Narrow tables are
written to the checkpoint folder between the steps.  Texts of candidates are
read again and move only where there are too many candidates to broadcast.

Verification is complete within clusters, so a cluster of m distinct texts
costs m^2 comparisons, spread over its block pairs.

Defined cases: null, empty and wordless texts are linked with nothing; rows
without an id are linked with nothing and kept, their component is null; rows
that share an id but not a text are documents of their own, linked only by
their texts (repeated rows get the same result); ids may be of any type that
can be ordered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.llm.bytescan import mix, shingle_set
from glyphfold.llm.components import components
from glyphfold.session import broadcast_if_small, cut_lineage, spread

PERCENT = 85
BANDS = 32
ROWS = 6
#: Places on the circle of the two permutations.
CIRCLE = 1 << 18
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 500_000
FEW_ROWS = 100_000
_U = np.uint64


@functools.cache
def _permutations(size: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and runs of the second one starting at each place."""
    draw = np.random.default_rng(20_240_611)
    first = draw.permutation(size).astype(np.int32)
    second = draw.permutation(size).astype(np.int32)
    circle = np.concatenate([second, second[:extra]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, extra)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a non-empty set of hashes."""
    first, runs = _permutations(CIRCLE, coordinates)
    places = first[(shingles & _U(CIRCLE - 1)).astype(np.int64)]
    lowest = np.full(coordinates, CIRCLE, np.int32)
    for at in range(0, len(places), 2048):
        np.minimum(lowest, runs[places[at : at + 2048]].min(axis=0), out=lowest)
    return lowest


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different for equal values in different bands."""
    parts = values.reshape(bands, rows).astype(_U)
    keys = np.arange(1, bands + 1, dtype=_U) * _U(0xA0761D6478BD642F)
    for k in range(rows):
        keys = mix(keys ^ (parts[:, k] + _U(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a = mix(shingles ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)
    b = mix(shingles * _U(0x9FB21C651E98DF25) + _U(len(shingles))).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prints(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_id, _th, n_shingles, _f1, _f2, _bands): one row for each row; the last three null for an empty set.  _th: hash of the text."""
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_col].dataType),
            T.StructField("_th", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("_f1", T.LongType()),
            T.StructField("_f2", T.LongType()),
            T.StructField("_bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                marks.append(fingerprint(found) if len(found) else (None, None))
                keys.append(band_keys(signature(found, bands * rows), bands, rows) if len(found) else None)
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()),
                pa.array([m[1] for m in marks], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, schema)


def candidate_stars(classes: DataFrame) -> DataFrame:
    """Distinct (a, b): each class and the smallest class of a band it shares with others."""
    banded = classes.select("_node", F.explode("_bands").alias("_key"))
    leads = cut_lineage(
        banded.groupBy("_key")
        .agg(F.min("_node").alias("_lead"), F.max("_node").alias("_last"))
        .filter(F.col("_lead") < F.col("_last"))
        .select("_key", "_lead")
    )
    met = banded.join(leads, "_key").filter(F.col("_node") > F.col("_lead"))
    return met.select(F.col("_node").alias("a"), F.col("_lead").alias("b")).distinct()


def _links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links of left x right (or of left alone) connect."""
    members = left + right
    owner = np.repeat(np.arange(len(members)), [len(s) for _, s in members])
    order = np.argsort(values := np.concatenate([s for _, s in members]), kind="stable")
    values, owner = values[order], owner[order]
    same = np.append(values[1:] == values[:-1], False)
    shared = same | np.append(False, same[:-1])
    columns = np.cumsum(np.append(True, values[1:] != values[:-1])[shared]) - 1
    owner = owner[shared]
    common = np.zeros((len(members), len(members)), np.float32)
    cuts = np.searchsorted(columns, np.arange(0, (columns[-1] if len(columns) else -1) + 4097, 4096))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        held = np.zeros((len(members), 4096), np.float32)
        held[owner[a:b], columns[a:b] % 4096] = 1
        common += held @ held.T
    size = np.array([len(s) for _, s in members], np.int64)
    both = common.astype(np.int64)
    linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    if right:
        linked[: len(left), : len(left)] = False
        linked[len(left) :, :] = False
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for x, y in np.argwhere(linked).tolist():
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            edges.append((members[x][0], members[y][0]))
    return edges


def verified_edges(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(a, b): edges with the components of all links inside the clusters of ``members`` (_node, _rep, _th, _f1, _f2, _n, _cluster)."""
    sizes = members.groupBy("_cluster").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_total"))
    blocks = F.greatest(F.ceil(F.col("_m") / BLOCK_MEMBERS), F.ceil(F.col("_total") / BLOCK_SHINGLES)).cast("int")
    placed = cut_lineage(
        members.join(sizes.select("_cluster", blocks.alias("_blocks")), "_cluster").select(
            "_node", "_rep", "_th", "_f1", "_f2", "_cluster", "_blocks"
        )
    )
    # A class's set is read from the row, or the equal rows, of its smallest id and text.
    texts = docs.select(F.col(id_col).alias("_rep"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    chosen = texts.join(broadcast_if_small(placed, FEW_ROWS), ["_rep", "_th"]).select("_node", "_f1", "_f2", "_cluster", "_blocks", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (f1, f2, text) in enumerate(zip(batch.column(1), batch.column(2), batch.column(5), strict=True)):
                own = shingle_set(text.as_py())
                # Texts of one hash under one id may still be of two classes.
                if len(own) and fingerprint(own) == (f1.as_py(), f2.as_py()):
                    rows.append(i)
                    found.append(own.tobytes())
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(3).take(taken), batch.column(4).take(taken), pa.array(found, pa.binary())],
                names=["_node", "_cluster", "_blocks", "_set"],
            )

    made = chosen.mapInArrow(sets, "_node long, _cluster long, _blocks int, _set binary")
    own = F.pmod(F.xxhash64("_node"), F.col("_blocks").cast("long")).cast("int")
    dealt = (
        made.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("_cluster", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_node", "_set")
    )
    group = ["_cluster", "_i", "_j"]
    ordered = spread(dealt, *group).sortWithinPartitions(*group)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        held: tuple[dict, dict] = ({}, {})

        def finish() -> list[tuple[int, int]]:
            left, right = (list(side.items()) for side in held)
            if current is not None and (current[1] == current[2] or (left and right)) and len(left) + len(right) > 1:
                return _links(left, right, percent)
            return []

        for batch in batches:
            edges = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for at, (cluster, i, j, mine, node) in enumerate(zip(*columns, strict=True)):
                if (cluster, i, j) != current:
                    edges += finish()
                    current, held = (cluster, i, j), ({}, {})
                held[0 if mine == i else 1][node] = np.frombuffer(batch.column(5)[at].as_py(), _U)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
        edges = finish()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return ordered.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    marked = cut_lineage(prints(docs, id_col, text_col))
    # n_shingles, bands and set are the same for all rows of a class.
    sets = (
        marked.filter(F.col("_f1").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_f1", "_f2")
        .agg(F.min(F.struct("_id", "_th")).alias("_first"), F.any_value("n_shingles").alias("_n"), F.any_value("_bands").alias("_bands"))
    )
    numbered = sets.orderBy("_first", "_f1", "_f2").withColumn("_node", F.monotonically_increasing_id())
    classes = cut_lineage(
        numbered.select("_node", F.col("_first._id").alias("_rep"), F.col("_first._th").alias("_th"), "_f1", "_f2", "_n", "_bands")
    )
    clusters = components(candidate_stars(classes))
    members = classes.drop("_bands").join(
        clusters.select(F.col("node").alias("_node"), F.col("component").alias("_cluster")), "_node"
    )
    found = components(verified_edges(docs, cut_lineage(members), id_col, text_col, percent))
    heads = classes.select(F.col("_node").alias("component"), F.col("_rep").alias("_label"))
    named = found.join(heads, "component").select(F.col("node").alias("_node"), "_label")
    labels = classes.select("_f1", "_f2", "_node", "_rep").join(named, "_node", "left")
    labels = labels.select("_f1", "_f2", F.coalesce("_label", "_rep").alias("_label"))
    joined = marked.select("_id", "n_shingles", "_f1", "_f2").join(cut_lineage(labels), ["_f1", "_f2"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_label", "_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)

"""Product codes of vectors: exact whole-number Lloyd rounds over cover trees.

1. Components become whole numbers, vectors are cut into equal parts, and each
   part position has a codebook of its own.
2. Every task builds cover trees of its own vectors, one for each part position
   and at most ``CHUNK`` vectors: a node's children are a net of its points, at
   half the distance of the level before.  A node knows its centre, a radius that
   holds all points below it, their number and the sum of their components.
   Trees are written once and read in every round.
3. In a round a node whose centre is nearer to one entry than to all others by
   more than twice its radius gives its whole subtree to that entry, by
   the triangle inequality: its number and sum are added, no point is looked at.
   Other nodes descend; points of ambiguous leaves are compared exactly.
4. Sums and numbers for each entry, some hundred whole numbers, make the next
   codebooks.

Distances between points and entries are whole numbers of 64 bits.  Only the
test of a node uses roots of them in floating point; a margin far above their
error keeps its answer safe, and what it leaves open is compared exactly.

Defined cases: vectors that are null, or hold a null or non-finite component,
are dropped; among the others those of another length than the one with the
smallest id, or of a length that is no multiple of the parts, keep a row with
null code and error.  Ids that repeat are ordered by their vectors, null ids come last.
With fewer vectors than entries the codebooks are that short.  Components beyond
``LIMIT`` after scaling, whose squared distances 64 bits could not add, count as
``LIMIT``; a sum over a label that exceeds 64 bits is null.  An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.session import broadcast_if_small, cut_lineage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 1 << 27
#: Vectors of a tree, and points of a leaf.
CHUNK = 4096
LEAF = 24
_MARGIN = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` to rows of ``b``, in whole numbers."""
    gap = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


class Tree:
    """A cover tree as arrays; node 0 is the root, a node's children and points are runs.

    ``points`` are in the order of the leaves, so that a node's points are the
    run from ``begin`` to ``end``, and ``order`` has their rows.
    """

    FIELDS = ("order", "centre", "radius", "begin", "end", "total", "child", "children")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        order: list[np.ndarray] = []
        centre, radius, begin, end, total, child, children = ([] for _ in range(7))
        placed = 0

        def add(rows: np.ndarray, at: int) -> float:
            gap = points[rows] - points[at]
            reach = np.sqrt(float(np.einsum("ij,ij->i", gap, gap).max())) * (1 + _MARGIN)
            centre.append(points[at])
            radius.append(reach)
            total.append(points[rows].sum(axis=0))
            begin.append(-1)
            end.append(-1)
            child.append(0)
            children.append(0)
            return reach

        # Nodes wait with their points, the row of their centre and the distance of their level.
        waiting = [(0, np.arange(len(points)), 0, add(np.arange(len(points)), 0))]
        held: dict[int, np.ndarray] = {}
        while waiting:
            node, rows, at, level = waiting.pop()
            if len(rows) <= LEAF or radius[node] == 0:
                held[node] = rows
                continue
            level = min(level, radius[node])
            nets: list[tuple[int, np.ndarray]] = []
            while len(nets) < 2:
                # A net of points that are more than half the level apart; each takes what is left within that distance.
                level /= 2
                nets, left, pick = [], rows, at
                while len(left):
                    gap = points[left] - points[pick]
                    near = np.einsum("ij,ij->i", gap, gap) <= level * level
                    nets.append((pick, left[near]))
                    left = left[~near]
                    pick = int(left[0]) if len(left) else pick
            child[node], children[node] = len(centre), len(nets)
            for pick, mine in nets:
                number = len(centre)
                add(mine, pick)
                waiting.append((number, mine, pick, level))
        # Points of a node are neighbours: leaves in the order of a walk.
        walk = [(0, False)]
        while walk:
            node, closed = walk.pop()
            if closed:
                end[node] = placed
                continue
            begin[node] = placed
            walk.append((node, True))
            if node in held:
                order.append(held[node])
                placed += len(held[node])
            walk += [(c, False) for c in range(child[node], child[node] + children[node])]
        return cls(
            order=np.concatenate(order),
            centre=np.array(centre),
            radius=np.array(radius),
            begin=np.array(begin),
            end=np.array(end),
            total=np.array(total),
            child=np.array(child),
            children=np.array(children),
        )

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sums, numbers, nodes, their entries): what each entry gets; the nodes, or leaf points as -1 - place, and who gets them.

        ``points`` are in the tree's order.
        """
        sums = np.zeros_like(entries)
        numbers = np.zeros(len(entries), np.int64)
        who: list[np.ndarray] = []
        chosen: list[np.ndarray] = []
        front = np.zeros(1, np.int64)
        while len(front):
            far = np.sqrt(_squares(self.centre[front], entries).astype(np.float64))
            best = far.argmin(axis=1)
            nearest = far[np.arange(len(front)), best]
            far[np.arange(len(front)), best] = np.inf
            second = far.min(axis=1)
            margin = np.where(np.isinf(second), 0, _MARGIN * (nearest + np.minimum(second, 1e300))) + 1e-6
            sure = second - nearest > 2 * self.radius[front] + margin
            who.append(front[sure])
            chosen.append(best[sure])
            np.add.at(sums, best[sure], self.total[front[sure]])
            np.add.at(numbers, best[sure], self.end[front[sure]] - self.begin[front[sure]])
            rest = front[~sure]
            leaves = rest[self.children[rest] == 0]
            if len(leaves):
                size = self.end[leaves] - self.begin[leaves]
                places = np.repeat(self.begin[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())
                # argmin takes the lower index of equal distances.
                best = _squares(points[places], entries).argmin(axis=1)
                np.add.at(sums, best, points[places])
                numbers += np.bincount(best, minlength=len(entries))
                who.append(-1 - places)
                chosen.append(best)
            inner = rest[self.children[rest] > 0]
            size = self.children[inner]
            front = np.repeat(self.child[inner] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return sums, numbers, np.concatenate(who), np.concatenate(chosen)

    def codes(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The entry of each point, in the tree's order."""
        _, _, who, chosen = self.assign(points, entries)
        out = np.empty(len(points), np.int64)
        leaf = who < 0
        out[-1 - who[leaf]] = chosen[leaf]
        nodes, given = who[~leaf], chosen[~leaf]
        size = self.end[nodes] - self.begin[nodes]
        out[np.repeat(self.begin[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(given, size)
        return out

    def pack(self) -> bytes:
        sink = pa.BufferOutputStream()
        for name in self.FIELDS:
            pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(getattr(self, name))), sink)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        source = pa.BufferReader(data)
        return cls(**{name: pa.ipc.read_tensor(source).to_numpy() for name in cls.FIELDS})


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite components, within ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def kept(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(_id, _vector, more): rows whose vector is whole and finite."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    vector = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    clean = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("_id"), vector.alias("_vector"), *more)
    return clean.filter(~F.exists("_vector", bad))


def first_entries(clean: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook for each part position, of the vectors with the smallest ids; a bounded top-k."""
    order = [F.col("_id").asc_nulls_last(), F.col("_vector")]
    lead = clean.orderBy(*order).limit(1).collect()
    if not lead or not lead[0]["_vector"] or len(lead[0]["_vector"]) % parts:
        return []
    size = len(lead[0]["_vector"])
    rows = clean.filter(F.size("_vector") == size).orderBy(*order).limit(entries).collect()
    values = whole(np.array([r["_vector"] for r in rows]), scale)
    return [part.copy() for part in np.split(values, parts, axis=1)]


def trees(clean: DataFrame, size: int, parts: int = PARTS, scale: int = SCALE, more: tuple[str, ...] = ()) -> DataFrame:
    """(rows, points, trees): chunks of vectors of ``size`` components; ids and ``more`` as rows, a tree for each part."""
    row_type = T.StructType([clean.schema["_id"], *(clean.schema[name] for name in more)])
    names = [f.name for f in row_type.fields]
    schema = T.StructType(
        [
            T.StructField("rows", T.ArrayType(row_type)),
            T.StructField("points", T.BinaryType()),
            T.StructField("trees", T.ArrayType(T.BinaryType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                some = batch.slice(low, CHUNK)
                values = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                points = whole(values, scale)
                made = [Tree.build(np.ascontiguousarray(part)).pack() for part in np.split(points, parts, axis=1)]
                rows = pa.StructArray.from_arrays([some.column(0), *(some.column(2 + i) for i in range(len(more)))], names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                        pa.array([points.astype("<i4").tobytes()], pa.binary()),
                        pa.array([made], pa.list_(pa.binary())),
                    ],
                    names=["rows", "points", "trees"],
                )

    return clean.filter(F.size("_vector") == size).select("_id", "_vector", *more).mapInArrow(run, schema)


def _opened(points: bytes, made: pa.Scalar, size: int) -> tuple[list[np.ndarray], list[Tree]]:
    values = np.frombuffer(points, "<i4").astype(np.int64).reshape(-1, size)
    opened = [Tree.unpack(t.as_py()) for t in made.values]
    return [np.ascontiguousarray(p) for p in np.split(values, len(opened), axis=1)], opened


def lloyd_round(forest: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks; entries that nobody chose stay."""
    size = sum(book.shape[1] for book in codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book) for book in codebooks]
        numbers = [np.zeros(len(book), np.int64) for book in codebooks]
        for batch in batches:
            for data, made in zip(batch.column(0), batch.column(1), strict=True):
                for k, (points, tree) in enumerate(zip(*_opened(data.as_py(), made, size), strict=True)):
                    added, counted, _, _ = tree.assign(points[tree.order], codebooks[k])
                    sums[k] += added
                    numbers[k] += counted
        keys = [(k, e) for k, book in enumerate(codebooks) for e in range(len(book)) if numbers[k][e]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in keys], pa.int32()),
                pa.array([e for _, e in keys], pa.int32()),
                pa.array([int(numbers[k][e]) for k, e in keys], pa.int64()),
                pa.array([sums[k][e].tolist() for k, e in keys], pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = forest.select("points", "trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    width = codebooks[0].shape[1]
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    )
    following = [book.copy() for book in codebooks]
    for row in total.collect():  # at most parts x entries rows
        following[row["part"]][row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    return following


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    text = ",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def encode(forest: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(row, code, error): the entries of each vector in hexadecimal, and its squared distance to them."""
    size = sum(book.shape[1] for book in codebooks)
    schema = T.StructType(
        [
            T.StructField("row", forest.schema["rows"].dataType.elementType),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, made in zip(*(batch.column(i) for i in range(3)), strict=True):
                parts, opened = _opened(data.as_py(), made, size)
                codes = np.empty((len(parts[0]), len(parts)), np.uint8)
                error = np.zeros(len(parts[0]), np.int64)
                for k, (points, tree) in enumerate(zip(parts, opened, strict=True)):
                    codes[tree.order, k] = tree.codes(points[tree.order], codebooks[k])
                    gap = points - codebooks[k][codes[:, k]]
                    error += np.einsum("ij,ij->i", gap, gap)
                text = codes.tobytes().hex()
                step = 2 * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.values,
                        pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                        pa.array(error, pa.int64()),
                    ],
                    names=["row", "code", "error"],
                )

    return forest.mapInArrow(run, schema)


def train(forest: DataFrame, codebooks: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    for _ in range(rounds):
        codebooks = lloyd_round(forest, codebooks)
    return codebooks


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    more: tuple[str, ...] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, more, code, error), codebooks): the encoded table, written, and what decodes it."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits has 1 to 256 entries")
    named = [F.col(name).alias(f"_more{i}") for i, name in enumerate(more)]
    clean = kept(vectors.select("*", *named), id_col, vector_col, *[f"_more{i}" for i in range(len(more))])
    carried = tuple(f"_more{i}" for i in range(len(more)))
    books = first_entries(clean, parts, entries, scale)
    size = sum(book.shape[1] for book in books)
    columns = [F.col("_id").alias(id_col), *[F.col(f"_more{i}").alias(name) for i, name in enumerate(more)]]
    other = clean.filter(F.size("_vector") != size if books else F.lit(True)).select(
        *columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    if not books:
        return other, books
    forest = cut_lineage(trees(clean, size, parts, scale, carried))
    books = train(forest, books, rounds)
    coded = encode(forest, books).select("row.*", "code", "error").select(*columns, "code", "error")
    return cut_lineage(coded.unionByName(other)), books


def decode(codes: DataFrame, codebooks: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """``codes`` with ``decoded``: the whole-number components of the entries that a code names."""
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in codebooks]

    def entry(k: int) -> Column:
        return F.conv(F.substring(code_col, 2 * k + 1, 2), 16, 10).cast("int")

    return codes.withColumn("decoded", F.concat(*[table[entry(k)] for k, table in enumerate(tables)]))


def digest(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors, more=("label",))
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    sums = total.select(F.col("label").alias("_label"), F.expr("try_cast(_sum AS bigint)").alias("label_error"))
    joined = coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))

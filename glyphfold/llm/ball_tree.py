"""Ranked lexical search: exact inner products over sparse ball trees.

1. The terms of all items are the coordinates.  One pass over the texts turns each
   document into a sparse vector over them (how often it holds each term) and its
   number of terms; texts are not read again.
2. The numbers of documents and terms, and of documents for each item term, are counted
   over the whole table.  They give the weight of each term, a query's
   vector, and with a document's length the value of each of its coordinates.
3. Tasks build ball trees of their own documents: a node is split by two of its
   documents that lie far apart.  A node has a centre (a whole-number mean), a
   radius, and in each coordinate the largest deviation from the centre, a
   one-dimensional radius.
4. An item descends best first.  No document of a node has an inner product over
   the smaller of two bounds: the query's product with the centre plus the
   radius times the query's length over coordinates that the node's documents have; and
   the product with the centre plus the deviations.  The first is computed
   from exact whole numbers and rounded up by more than floating point can
   err, the second is a whole number.  A node is left out if its bound is less
   than the score of the tenth document found so far.
5. Leaves are scored exactly in 64-bit whole numbers.  Each task gives at most
   ``top`` documents for an item, the best of all tasks are ranked.

Items are handled in blocks of about ``BLOCK_TERMS`` (item, term) pairs, counted first,
which is what a task gets of them; a larger benchmark takes a pass for each block.

Defined cases: null or empty texts have no terms; they, and other documents that
hold no item term, are counted as the contract says and rank nowhere; items without terms, or
whose terms no document holds, have no row; rows that repeat an item id are one item
with the terms of all, items without an id are one; each row of a document id is
a document of its own; documents without an id come after others of the same
score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.llm.bytescan import PLAIN, word_bounds
from glyphfold.llm.common import ascii_lower
from glyphfold.session import cut_lineage

TOP = 10
#: (item, term) pairs of a block of items.
BLOCK_TERMS = 200_000
#: Bytes of text handled at once; documents and coordinates of a tree, documents of a leaf.
CHUNK_BYTES = 4 << 20
TREE_DOCS, TREE_VALUES = 16_384, 2_000_000
LEAF = 32
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_NOT_TERM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits and everything beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_TERM), lambda w: w != "")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_item, _term): the distinct terms of each item."""
    return items.select(F.col(id_col).alias("_item"), F.explode(terms(F.col(text_col))).alias("_term")).distinct()


def term_counts(texts: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, then text, vocabulary number and count of each pair that occurs, by text)."""
    data = (b"\n".join(texts) + b"\n").lower()
    starts, ends = word_bounds(data, PLAIN)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(firsts, starts, "right") - 1
    raw = np.frombuffer(data, np.uint8)
    letters = raw[PLAIN[raw].astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    at = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    known = at >= 0
    pairs, counts = np.unique(owner[known] * np.int64(len(vocabulary)) + at[known], return_counts=True)
    return np.bincount(owner, minlength=len(texts)), pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), counts


def vectors(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(_doc, _n, _terms, _counts): for each row its number of terms, and the counts of vocabulary terms by their numbers."""
    known = [v.encode() for v in vocabulary]
    schema = T.StructType(
        [
            T.StructField("_doc", docs.schema[id_col].dataType),
            T.StructField("_n", T.LongType()),
            T.StructField("_terms", T.ArrayType(T.IntegerType())),
            T.StructField("_counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known, pa.large_binary())
        for batch in batches:
            low, size = 0, 0
            texts: list[bytes] = []
            for row, value in enumerate(batch.column(1)):
                texts.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size < CHUNK_BYTES and row + 1 < batch.num_rows:
                    continue
                n, owner, at, counts = term_counts(texts, values)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(texts)),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                    ],
                    names=schema.names,
                )
                low, size, texts = row + 1, 0, []

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class BallTree:
    """A ball tree of sparse rows of positive whole numbers: ``values`` at ``columns``, row i from ``starts[i]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width
        self.leaf = leaf
        self.members: list[np.ndarray | None] = []
        self.children: list[tuple[int, int]] = []
        self.radius: list[int] = []
        entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = [(np.arange(len(starts) - 1), self._node(np.arange(len(starts) - 1), entries))]
        while waiting:
            rows, node = waiting.pop()
            if len(rows) <= leaf or not self.radius[node]:
                self.members[node] = rows
                continue
            for half in self._halves(rows):
                number = self._node(half, entries)
                self.children[node] += (number,)
                waiting.append((half, number))
        # Centres and deviations by coordinate, so that a query reads those of its own terms only.
        node = np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries])
        column = np.concatenate([e[0] for e in entries])
        order = np.argsort(column, kind="stable")
        self.node = node[order]
        self.centre = np.concatenate([e[1] for e in entries])[order]
        self.deviation = np.concatenate([e[2] for e in entries])[order]
        self.run = np.searchsorted(column[order], np.arange(width + 1))

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of ``rows``, where each row begins among them)."""
        size = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(size) - size
        return np.repeat(self.starts[rows] - begins, size) + np.arange(size.sum()), begins

    def _dots(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products with ``dense``; every row has an entry."""
        at, begins = self._flat(rows)
        return np.add.reduceat(self.values[at] * dense[self.columns[at]], begins)

    def _node(self, rows: np.ndarray, entries: list) -> int:
        at, _ = self._flat(rows)
        columns, place = np.unique(self.columns[at], return_inverse=True)
        total = np.zeros(len(columns), np.int64)
        high = np.zeros(len(columns), np.int64)
        np.add.at(total, place, self.values[at])
        np.maximum.at(high, place, self.values[at])
        centre = total // len(rows)
        dense = np.zeros(self.width, np.int64)
        dense[columns] = centre
        norm = int((centre * centre).sum())
        own = np.add.reduceat(self.values[at] ** 2, self._flat(rows)[1])
        far = own - 2 * self._dots(rows, dense)
        # All whole numbers: squared distance = |x|^2 - 2 x.c + |c|^2.
        self.radius.append(int(far.max()) + norm)
        entries.append((columns, centre, high - centre))
        self.members.append(None)
        self.children.append(())
        return len(self.radius) - 1

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def distances(to: int) -> np.ndarray:
            dense = np.zeros(self.width, np.int64)
            mine = slice(self.starts[to], self.starts[to + 1])
            dense[self.columns[mine]] = self.values[mine]
            return own - 2 * self._dots(rows, dense) + int((self.values[mine] ** 2).sum())

        at, begins = self._flat(rows)
        own = np.add.reduceat(self.values[at] ** 2, begins)
        left = distances(int(rows[distances(int(rows[0])).argmax()]))
        right = distances(int(rows[left.argmax()]))
        near = left <= right
        if near.all() or not near.any():
            near = np.arange(len(rows)) < len(rows) // 2
        return rows[near], rows[~near]

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No row of a node has a larger product with the query: whole numbers, never too small."""
        size = self.run[columns + 1] - self.run[columns]
        at = np.repeat(self.run[columns] - np.cumsum(size) + size, size) + np.arange(size.sum())
        by = np.repeat(weights, size)
        nodes = len(self.radius)
        centre, apart, length = (np.zeros(nodes, np.int64) for _ in range(3))
        np.add.at(centre, self.node[at], by * self.centre[at])
        np.add.at(apart, self.node[at], by * self.deviation[at])
        np.add.at(length, self.node[at], by * by)
        ball = np.sqrt(np.array(self.radius, np.float64)) * np.sqrt(length.astype(np.float64))
        return centre + np.minimum(apart, np.ceil(ball * (1 + 1e-9)).astype(np.int64) + 1)

    def search(self, columns: np.ndarray, weights: np.ndarray, found: list[tuple], top: int, rank_of: list) -> list[tuple]:
        """``found``, a heap of (score, rank, row) of at most ``top`` best, with the rows of this tree.

        ``rank_of`` has a number for each row, larger for rows that come first among equal scores.
        """
        bound = self.bounds(columns, weights)
        dense = np.zeros(self.width, np.int64)
        dense[columns] = weights
        ahead = [(-int(bound[0]), 0)]
        while ahead:
            high, node = heapq.heappop(ahead)
            if -high <= 0 or (len(found) == top and -high < found[0][0]):
                break
            rows = self.members[node]
            if rows is None:
                for child in self.children[node]:
                    # A child's rows are in its parent too, so the smaller bound holds.
                    heapq.heappush(ahead, (max(high, -int(bound[child])), child))
                continue
            scores = self._dots(rows, dense)
            least = found[0][0] if len(found) == top else 1
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), *rank_of[int(rows[i])])
                if len(found) < top:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return found


def document_values(n: np.ndarray, counts: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The value of each coordinate, of documents of ``n`` terms where the term occurs ``counts`` times."""
    norm = 10 + (90 * n * documents) // max(1, total)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norm)


def best_of_tasks(
    rows: DataFrame, queries: list[tuple[int | None, np.ndarray, np.ndarray]], width: int, documents: int, total: int, top: int
) -> DataFrame:
    """(_item, _doc, score): the best of each task's rows of ``vectors`` for each query of an item, its terms and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []
        seen = 0

        def plant() -> None:
            nonlocal seen
            table = pa.Table.from_batches(held).combine_chunks()
            terms_, counts_ = (table.column(i).combine_chunks() for i in (2, 3))
            starts = terms_.offsets.to_numpy().astype(np.int64)
            columns = terms_.values.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(starts)
            columns, starts = columns[starts[0] : starts[-1]], starts - starts[0]
            counts = counts_.values.to_numpy(zero_copy_only=False)[int(counts_.offsets[0].as_py()) :][: len(columns)]
            n = np.repeat(table.column(1).to_numpy(), size)
            tree = BallTree(starts, columns, document_values(n, counts, documents, total), width)
            # Smaller ids come first, no id last; the number of the row tells repeated ids apart.
            rank_of = [(d is not None, -d if d is not None else 0, -(seen + i)) for i, d in enumerate(table.column(0).to_pylist())]
            for (_, at, weights), best in zip(queries, found, strict=True):
                tree.search(at, weights, best, top, rank_of)
            seen += len(rank_of)
            held.clear()

        docs = entries = 0
        for batch in batches:
            low = 0
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy().astype(np.int64)))
            while low < batch.num_rows:
                # As many rows as fit into the tree, at least one.
                room = int(np.searchsorted(ends - (ends[low - 1] if low else 0), TREE_VALUES - entries, "right"))
                take = max(1, min(room, low + TREE_DOCS - docs) - low)
                held.append(batch.slice(low, take))
                docs += take
                entries += int(ends[low + take - 1] - (ends[low - 1] if low else 0))
                low += take
                if docs >= TREE_DOCS or entries >= TREE_VALUES or low < batch.num_rows:
                    plant()
                    docs = entries = 0
        if held:
            plant()
        out = [(q[0], -back if known else None, score) for q, best in zip(queries, found, strict=True) for score, known, back, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["_item", "_doc", "score"])

    return rows.filter(F.size("_terms") > 0).mapInArrow(run, "_item long, _doc long, score long")


def _search_block(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """(_item, rank, doc_id, score) for the items of one block of (item, term) pairs."""
    # One block: a bounded number of pairs.
    block = pairs.collect()
    vocabulary = sorted({r["_term"] for r in block})
    number = {term: i for i, term in enumerate(vocabulary)}
    items: dict[int | None, list[int]] = {}
    for r in block:
        items.setdefault(r["_item"], []).append(number[r["_term"]])
    rows = cut_lineage(vectors(docs, vocabulary, id_col, text_col))
    documents, total = rows.agg(F.count_if(F.col("_n") > 0), F.sum("_n")).first()
    # A number for each term of the block.
    holding = {r["t"]: r["count"] for r in rows.select(F.explode("_terms").alias("t")).groupBy("t").count().collect()}
    weights = np.array([weight(documents, holding.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    queries = []
    for item, mine in items.items():
        at = np.array(sorted(t for t in mine if holding.get(t)), np.int64)
        queries.append((item, at, weights[at]))
    found = best_of_tasks(rows, queries, len(vocabulary), documents, total or 0, top)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("_item", "rank", F.col("_doc").alias("doc_id"), "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    pairs = cut_lineage(item_terms(items, item_col, item_text_col))
    blocks = -(-pairs.count() // block_terms)
    out = None
    for block in range(max(1, blocks)):
        part = pairs if blocks <= 1 else pairs.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block)
        found = _search_block(docs, part, id_col, text_col, top)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_item").alias("item_id"), "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)

"""Packing documents into sequences of a fixed number of tokens.

1. Texts become token ids and pieces inside Arrow batches; only piece lengths
   and digests leave the task.
2. Pieces are dealt to partitions of about ``group_size`` and packed by
   best-fit decreasing.
3. Lower bounds from dual-feasible functions certify a partition whose bin
   count they reach: no packing of its pieces has fewer bins.
4. Partitions with a gap give the bins that are not full to an exchange,
   certified ones their emptiest.  They are dealt anew, whole bin by whole bin,
   and packed again; the new packing is taken where it has fewer bins.  This
   goes on until a round saves no bin, or until one partition is left.

Every group is bounded by ``group_size`` whatever the ids are: pieces are dealt
by their place in the written piece table, not by a key.

Ids are those of the tokenizers library for ``byte_bpe_50k.json`` with
``add_special_tokens=False``: none is put around a text, but the string of an
added token in a text is that token.  They are computed by tiktoken from the
same vocabulary, which takes a quarter of the time; a test holds them against
the tokenizers library in its default setting.

Defined cases: null or empty text is the single end token; repeated rows are
packed each; rows without an id are packed like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.session import cut_lineage

CAPACITY = 2048
END_ID = 0
GROUP_SIZE = 8192
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added tokens of ``byte_bpe_50k.json``, which a rank file does not hold.
ADDED = {"<|endoftext|>": 50256}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, added: dict[str, int] | None = None) -> Callable[[str], np.ndarray]:
    """Text to unsigned 32-bit ids, from a rank file; the strings of ``added`` tokens become their ids."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    built = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    return lambda text: built.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full ones, the first may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): one row for each piece of a document."""
    id_type = docs.schema[id_col].dataType
    fields = [
        T.StructField(id_col, id_type),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path(), ADDED)
        for batch in batches:
            owners, numbers, starts, lengths, sums, lists = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                start = 0
                for number, length in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    owners.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        lists.append(part)
                    start += length
            columns = [
                batch.column(0).take(pa.array(owners, pa.int64())),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([part.tolist() for part in lists], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(bin of each length, number of bins).

    Bins wait by their free space; a bit mask of the spaces in use finds the
    smallest that is large enough.
    """
    bins = np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = mask >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = waiting[space].pop()
            if not waiting[space]:
                mask ^= 1 << space
        else:
            space, chosen = capacity, count
            count += 1
        bins[item] = chosen
        left = space - length
        if left:
            waiting[left].append(chosen)
            mask |= 1 << left
    return bins, count


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins by two families of dual-feasible functions, in whole numbers.

    ``f``: for a limit l, lengths over capacity - l count a whole bin, lengths
    under l nothing.  ``u``: for k, a length x counts as itself where
    (k + 1) x is a multiple of the capacity, else floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    below = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    limits = np.arange(1, capacity // 2 + 1)
    whole = below[-1] - below[capacity - limits + 1]
    middle = sums[capacity - limits + 1] - sums[limits]
    best = int((whole + -(-middle // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 41):
        grown = (k + 1) * x
        scaled = np.where(grown % capacity == 0, k * x, (grown // capacity) * capacity)  # times k * capacity
        best = max(best, int(-(-(counts * scaled).sum() // (k * capacity))))
    return best


def _repack(capacity: int, round_no: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def repack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        number = int(group["_group"].iloc[0])
        bins, count = best_fit_decreasing(lengths, capacity)
        before = group["sequence_id"].to_numpy()
        if round_no and count >= len(np.unique(before)):
            count, ids = len(np.unique(before)), before
            _, bins = np.unique(before, return_inverse=True)
        else:
            # Unique for each round, group and bin; rounds from 128 on count in bits that bins of a group leave free.
            ids = ((((round_no % 128) << 24) + number) << 32) + ((round_no // 128) << 24) + bins
        filled = np.bincount(bins, weights=lengths)
        # A certified partition offers its emptiest bin only: remainders of several partitions may share bins.
        offered = filled < capacity if count > lower_bound(lengths, capacity) else filled == min(filled.min(), capacity - 1)
        group["sequence_id"] = ids
        group["_open"] = offered[bins]
        return group

    return repack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, rounds: int | None = None) -> DataFrame:
    """``pieces`` (with a ``length``) with ``sequence_id`` and ``offset``: its sequence and the place in it.

    Rounds go on until one saves no bin; each other one lowers their number.  ``rounds`` ends them earlier.
    ``pieces`` is read several times: hand in a written table.
    """
    keep = pieces.columns
    total = pieces.count()
    row = F.monotonically_increasing_id()
    state = pieces.withColumn("_row", row).withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("_open", F.lit(True))
    done, open_rows, open_bins = [], total, 0
    for round_no in itertools.count():
        groups = max(1, -(-open_rows // group_size))
        if round_no == 0:
            # Rows of one input partition go round robin; a multiplier keeps partitions from starting alike.
            dealt = F.pmod(F.col("_row") + F.shiftright("_row", 33) * 7919, F.lit(groups))
        else:
            dealt = F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(groups))
        grouped = state.withColumn("_group", dealt.cast("long"))
        packed = cut_lineage(grouped.groupBy("_group").applyInPandas(_repack(capacity, round_no), grouped.schema))
        done.append(packed.filter(~F.col("_open")))
        state = packed.filter("_open").drop("_group")
        saved = round_no == 0 or packed.agg(F.count_distinct("sequence_id")).first()[0] < open_bins
        open_rows, open_bins = state.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not open_rows or groups == 1 or not saved or round_no + 1 == rounds:
            break
    done.append(state.withColumn("_group", F.lit(0).cast("long")))
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    in_sequence = F.expr(
        "sum(length) OVER (PARTITION BY sequence_id ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length"
    )
    return placed.withColumn("offset", in_sequence).select(*keep, "sequence_id", "offset")


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences of pieces that carry their ids; at most ``capacity`` ids each."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    return pack(cut_lineage(token_pieces(docs)))

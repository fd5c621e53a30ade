"""Substring de-duplication: windows of words that an earlier document has, by super-k-mers.

1. A window is ``window`` consecutive words.  Its minimiser is the pair of
   neighbouring words in it with the smallest hash.  Consecutive windows that
   share it travel as one string, a super-k-mer: about 18 words for 6 windows,
   where each window on its own would take 13 words.
2. The minimiser decides the bucket.  Equal windows have equal minimisers, so
   all places of a window meet in one bucket.  A task packs its super-k-mers of
   a bucket into compressed blobs.
3. In a bucket windows are sorted by a hash of their words; neighbours with
   equal hashes are compared word by word, and told apart if they differ.  The
   smallest document of each run of equal windows keeps it, others lose it.
4. A first pass counts the words of each bucket.  Large buckets (a frequent pair
   of words, a passage in a third of all documents) are dealt to several groups
   by document.  A group that still exceeds ``group_words`` is cut while it is
   read.  Windows settled inside a part of a bucket are final; of each distinct
   window only the places of its smallest document in the part are compared
   with the other parts, by the window's words, as one narrow row each.
5. Marks of removed words, at most one for each super-k-mer, go back to their
   document by its id and a hash of its text.

No group is larger than ``group_words`` words and one blob, whatever the keys
are, and no window is dropped or sampled.

Defined cases: words are runs without ASCII white space; null, empty and
shorter texts have no window and lose nothing; rows that repeat an id have the
same rank, so they never lose a window to each other; rows without an id come
after all others; long texts are handled whole; an empty table gives an empty
result; other columns are ignored.  Ids are whole numbers; the largest long
stands for no id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphfold.llm.bytescan import SPACED, mix, word_bounds, word_hashes
from glyphfold.session import cut_lineage

WINDOW = 13
#: Words of a minimiser.
PAIR = 2
#: Windows of a super-k-mer at most; one bit each in a mark.
RUN = 48
#: Words that a group of a bucket holds at most.
GROUP_WORDS = 1_500_000
#: Bytes of text handled at once, and bytes of packed text kept before blobs are written.
CHUNK_BYTES = 4 << 20
FLUSH_BYTES = 24 << 20
#: Large buckets named to the tasks so that they can be dealt out; others are cut where they are read.
DEALT = 100_000
#: Packed bytes for a byte of text and bytes of a word, for the number of buckets only.
_SPREAD, _WORD_BYTES = 3, 6
_LAST = (1 << 63) - 1
_U = np.uint64
_META = np.dtype([("id", "<i8"), ("hash", "<i8"), ("start", "<i8"), ("words", "<i4")])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text of words with one separator each, starts, ends, document of each word)."""
    data = b"\n".join(texts) + b"\n"
    starts, ends = word_bounds(data, SPACED)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(firsts, starts, "right") - 1
    raw = np.frombuffer(data, np.uint8)
    keep = SPACED[raw].astype(bool)
    keep[ends] = True
    packed = raw[keep]
    packed[SPACED[packed] == 0] = 0x20
    sizes = ends - starts
    ends = np.cumsum(sizes + 1) - 1
    return packed.tobytes(), ends - sizes, ends, owner


class Chunk:
    """The super-k-mers of a few documents."""

    def __init__(self, texts: list[bytes], buckets: int, window: int):
        self.data, self.starts, self.ends, self.owner = _joined(texts)
        n = len(self.starts) - window + 1
        none = np.empty(0, np.int64)
        self.first = self.count = self.bucket = none
        if n <= 0:
            return
        hashes = word_hashes(self.data, self.starts, self.ends)
        pair = min(PAIR, window)
        pairs = hashes
        if pair == 2:
            pairs = mix(hashes[:-1] * _U(0x9FB21C651E98DF25) + hashes[1:])
        lowest = _smallest(pairs, window - pair + 1)
        inside = np.flatnonzero(self.owner[:n] == self.owner[window - 1 :])
        if not len(inside):
            return
        key = lowest[inside]
        new = np.append(True, (np.diff(inside) != 1) | (key[1:] != key[:-1]))
        begins = np.flatnonzero(new)
        place = np.arange(len(inside)) - np.repeat(begins, np.diff(np.append(begins, len(inside))))
        begins = np.flatnonzero(place % RUN == 0)
        self.first = inside[begins]
        self.count = np.diff(np.append(begins, len(inside)))
        # The smallest of many hashes is a small number, so it is mixed again.
        self.bucket = (mix(key[begins] ^ _U(0x2545F4914F6CDD1D)) % _U(buckets)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, window: int, text_at: int) -> Iterator[tuple[Chunk, list[int], pa.RecordBatch]]:
    for batch in batches:
        texts: list[bytes] = []
        rows: list[int] = []
        size = 0
        for row, value in enumerate(batch.column(text_at).cast(pa.large_binary())):
            if not value.is_valid:
                continue
            texts.append(value.as_py())
            rows.append(row)
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield Chunk(texts, buckets, window), rows, batch
                texts, rows, size = [], [], 0
        if texts:
            yield Chunk(texts, buckets, window), rows, batch


def bucket_words(docs: DataFrame, text_col: str, buckets: int, window: int = WINDOW) -> DataFrame:
    """(bucket, words): words of the super-k-mers of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _ in _chunks(batches, buckets, window, 0):
            found, at = np.unique(chunk.bucket, return_inverse=True)
            words = np.bincount(at, weights=chunk.count + window - 1, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(words)], names=["bucket", "words"])

    return docs.select(text_col).mapInArrow(run, "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words"))


def super_kmers(keyed: DataFrame, buckets: int, parts: dict[int, int], window: int = WINDOW) -> DataFrame:
    """(bucket, part, meta, blob) of ``keyed`` (_id, _hash, _text): a task's super-k-mers of a part of a bucket, packed."""
    split = np.array(sorted(parts), np.int64)
    shares = np.array([parts[b] for b in split.tolist()], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        strings: list[bytes] = []
        metas: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not strings:
                return
            group, meta = np.concatenate(groups), np.concatenate(metas)
            order = np.lexsort((group[:, 1], group[:, 0]))
            group, meta = group[order], meta[order]
            ordered = [strings[i] for i in order.tolist()]
            edges = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
            upto = np.append(edges[1:], len(group))
            blobs, infos = [], []
            for a, b in zip(edges.tolist(), upto.tolist(), strict=True):
                text = b" ".join(ordered[a:b]) + b" "
                blobs.append(len(text).to_bytes(8, "little") + codec.compress(text, asbytes=True))
                fields = b"".join(meta[name][a:b].tobytes() for name in meta.dtype.names)
                infos.append((b - a).to_bytes(8, "little") + codec.compress(fields, asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[edges, 0]), pa.array(group[edges, 1]), pa.array(infos, pa.binary()), pa.array(blobs, pa.binary())],
                names=["bucket", "part", "meta", "blob"],
            )
            strings.clear()
            metas.clear()
            groups.clear()

        for chunk, rows, batch in _chunks(batches, buckets, window, 2):
            if not len(chunk.first):
                continue
            last = chunk.first + chunk.count + window - 2
            data = chunk.data
            made = [data[a:b] for a, b in zip(chunk.starts[chunk.first].tolist(), chunk.ends[last].tolist(), strict=True)]
            owner = chunk.owner[chunk.first]
            taken = np.array(rows)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[taken][owner]
            hashes = batch.column(1).to_numpy(zero_copy_only=False)[taken][owner]
            meta = np.empty(len(made), _META)
            meta["id"], meta["hash"] = ids, hashes
            # A document's first word is where its number first occurs.
            meta["start"] = chunk.first - np.searchsorted(chunk.owner, owner)
            meta["words"] = chunk.count + window - 1
            part = np.zeros(len(made), np.int64)
            if len(split):
                at = np.minimum(np.searchsorted(split, chunk.bucket), len(split) - 1)
                large = split[at] == chunk.bucket
                spread = mix(hashes.astype(np.int64).view(_U) ^ mix(ids.astype(np.int64).view(_U)))
                part[large] = (spread[large] % shares[at[large]]).astype(np.int64)
            strings += made
            metas.append(meta)
            groups.append(np.stack([chunk.bucket, part], 1))
            size += sum(map(len, made))
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return keyed.mapInArrow(run, "bucket long, part long, meta binary, blob binary")


def _unpack(meta: bytes, blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    codec = pa.Codec("zstd", 1)
    n = int.from_bytes(meta[:8], "little")
    fields = codec.decompress(meta[8:], n * _META.itemsize, asbytes=True)
    out, at = {}, 0
    for name in _META.names:
        kind = _META[name]
        out[name] = np.frombuffer(fields, kind, n, at)
        at += n * kind.itemsize
    return out, codec.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` word numbers."""
    base = 0x9E3779B97F4A7C15
    whole, span = mix(words.astype(_U) + _U(0x632BE59BD9B4E019)), 1
    power = {1: whole}
    while span * 2 <= window:
        power[span * 2] = power[span][:-span] * _U(pow(base, span, 1 << 64)) + power[span][span:]
        span *= 2
    out, at = None, 0
    size = len(words) - window + 1
    for span in sorted(power, reverse=True):
        if at + span <= window:
            part = power[span][at : at + size]
            out = part if out is None else out * _U(pow(base, span, 1 << 64)) + part
            at += span
    return mix(out)


def ranks(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): places sorted so that equal windows are neighbours, and where another window begins.

    Sorted by hash; neighbours are compared on the words themselves, and
    hashes that more than one window has are sorted by their words.
    """
    keys = _window_hashes(words, window)[at]
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    sorted_at = at[order]
    pairs = np.flatnonzero(same)
    spans = np.arange(window)
    clash: list[np.ndarray] = []
    for low in range(0, len(pairs), 100_000):
        some = pairs[low : low + 100_000]
        differ = (words[sorted_at[some][:, None] + spans] != words[sorted_at[some + 1][:, None] + spans]).any(axis=1)
        clash.append(keys[some[differ]])
    new = np.append(True, ~same)
    for key in np.unique(np.concatenate(clash)) if clash else ():
        a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        rows = words[sorted_at[a:b][:, None] + spans]
        inner = np.lexsort(rows.T[::-1])
        order[a:b] = order[a:b][inner]
        rows = rows[inner]
        new[a + 1 : b] = (rows[1:] != rows[:-1]).any(axis=1)
    return order, new


def settle(meta: dict[str, np.ndarray], text: bytes, window: int, whole: bool) -> dict[str, np.ndarray | list]:
    """Marks of the windows that a smaller document of the group has; of a part of a bucket also the first holders."""
    starts, ends = word_bounds(text, SPACED)
    raw = np.frombuffer(text, np.uint8)
    letters = raw[SPACED[raw].astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    named = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    ).dictionary_encode()
    words = named.indices.to_numpy(zero_copy_only=False)
    counts = meta["words"].astype(np.int64) - window + 1
    first = np.cumsum(meta["words"].astype(np.int64)) - meta["words"]
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[owner] + inner
    order, new = ranks(words, at, window)
    run = np.cumsum(new) - 1
    ids = meta["id"][owner][order]
    low = np.minimum.reduceat(ids, np.flatnonzero(new))[run]
    gone = order[ids > low]
    masks = np.zeros(len(counts), np.int64)
    np.bitwise_or.at(masks, owner[gone], np.int64(1) << inner[gone])
    hit = np.flatnonzero(masks)
    out = {
        "id": meta["id"][hit],
        "hash": meta["hash"][hit],
        "start": meta["start"][hit],
        "mask": masks[hit],
        "window": [None] * len(hit),
    }
    if not whole:
        left = order[ids == low]
        begin, end = starts[at[left]], ends[at[left] + window - 1]
        out["id"] = np.append(out["id"], meta["id"][owner[left]])
        out["hash"] = np.append(out["hash"], meta["hash"][owner[left]])
        out["start"] = np.append(out["start"], meta["start"][owner[left]] + inner[left])
        out["mask"] = np.append(out["mask"], np.ones(len(left), np.int64))
        out["window"] += [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return out


def group_marks(packed: DataFrame, split: set[int], tasks: int, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """(_id, _hash, _start, _mask, _window): settled marks (without a window), and places to compare with other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        metas: list[dict[str, np.ndarray]] = []
        texts: list[bytes] = []
        size, cut = 0, False

        def finish(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if metas:
                meta = {name: np.concatenate([m[name] for m in metas]) for name in _META.names}
                found = settle(meta, b"".join(texts), window, whole)
                for low in range(0, len(found["id"]), 50_000):
                    columns = [pa.array(found[name][low : low + 50_000], pa.int64()) for name in ("id", "hash", "start", "mask")]
                    columns.append(pa.array(found["window"][low : low + 50_000], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["_id", "_hash", "_start", "_mask", "_window"])
            metas.clear()
            texts.clear()
            size = 0

        for batch in batches:
            for bucket, part, info, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = (bucket.as_py(), part.as_py())
                if key != current:
                    if current is not None:
                        yield from finish(not cut and current[0] not in split)
                    current, cut = key, False
                meta, text = _unpack(info.as_py(), blob.as_py())
                words = int(meta["words"].sum())
                if size and size + words > 2 * group_words:
                    cut = True
                    yield from finish(False)
                metas.append(meta)
                texts.append(text)
                size += words
        if current is not None:
            yield from finish(not cut and current[0] not in split)

    dealt = packed.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(run, "_id long, _hash long, _start long, _mask long, _window binary")


def passage_marks(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, group_words: int = GROUP_WORDS, dealt: int = DEALT
) -> DataFrame:
    """(_id, _hash, _marks): for each text that loses words the (start, mask) of windows that a smaller id has.

    ``_id`` is the largest long for rows without an id, ``_hash`` is of the text.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = 1 + size * _SPREAD // _WORD_BYTES // group_words
    counts = bucket_words(docs, text_col, buckets, window)
    large = counts.filter(F.col("words") > 2 * group_words).orderBy(F.desc("words"), "bucket").limit(dealt).collect()
    parts = {row.bucket: -(-row.words // group_words) for row in large}
    groups = buckets - len(parts) + sum(parts.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, 10_000))
    packed = super_kmers(_keyed(docs, id_col, text_col), buckets, parts, window)
    found = cut_lineage(group_marks(packed, set(parts), tasks, window, group_words))
    open_rows = found.filter(F.col("_window").isNotNull())
    first = open_rows.groupBy("_window").agg(F.min("_id").alias("_low"))
    later = open_rows.join(first, "_window").filter(F.col("_id") > F.col("_low"))
    settled = found.filter(F.col("_window").isNull())
    columns = ["_id", "_hash", "_start", "_mask"]
    return (
        settled.select(columns)
        .unionByName(later.select(columns))
        .groupBy("_id", "_hash")
        .agg(F.collect_set(F.struct("_start", "_mask")).alias("_marks"))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _text)."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_hash"),
        F.col(text_col).alias("_text"),
    )


def kept_words(text: str | None, marks: list[dict] | None, window: int = WINDOW) -> tuple[str, int, int]:
    """(kept words joined by one space, words, removed words)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not marks:
        return b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    for mark in marks:
        mask, at = mark["_mask"], mark["_start"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            edge[at + low] += 1
            edge[at + low + window] -= 1
            mask &= mask - 1
    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in left]).decode("utf-8", "surrogatepass"), len(words), len(words) - len(left)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes: int) -> DataFrame:
    """(id, text, n_words, n_removed): each row's text without the words that windows of smaller ids cover."""
    marks = passage_marks(docs, id_col, text_col, window, **sizes)
    joined = _keyed(docs, id_col, text_col).join(marks, ["_id", "_hash"], "left").select("_id", "_text", "_marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t.as_py(), m.as_py(), window) for t, m in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["_id", "_text", "n_words", "n_removed"],
            )

    cleaned = joined.mapInArrow(run, "_id long, _text string, n_words long, n_removed long")
    return cleaned.select(F.nullif("_id", F.lit(_LAST)).alias(id_col), F.col("_text").alias(text_col), "n_words", "n_removed")


def digest(docs: DataFrame) -> DataFrame:
    cleaned = remove_repeats(docs)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

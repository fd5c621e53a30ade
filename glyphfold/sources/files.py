"""Binary file inventory against a manifest (SRC2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, length and content of every file; content is pruned when unused."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def inventory_files(files: DataFrame, content: str = "content", signature_bytes: int = 5) -> DataFrame:
    """Signature, length and SHA-256 in place of the content."""
    raw = F.col(content).cast("binary")
    return files.select(
        "path",
        F.decode(F.substring(raw, 1, signature_bytes), "ISO-8859-1").alias("signature"),
        F.octet_length(raw).cast("bigint").alias("length"),
        F.sha2(raw, 256).alias("sha256"),
    )


#: Bytes that travel as a row, or a line if that is longer.
PIECE_BYTES = 16 << 10
#: Readers of text skip this at the beginning of a file.
_MARK = b"\xef\xbb\xbf"
#: Readers of text unpack such files.
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, each with its line feed, put together to rows of :data:`PIECE_BYTES`, numbered within a task."""
    names = ["file", "size", "block", "no", "bytes"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    number = 0
    for batch in batches:
        # Parts of files come one after another, so a batch whose ends agree holds one.
        marks = [batch.column(c) for c in names[:3]]
        ends = [[c[i].as_py() for c in marks] for i in (0, batch.num_rows - 1)] if batch.num_rows else []
        if not ends:
            continue
        if ends[0] == ends[1]:
            spans = [(ends[0], 0, batch.num_rows)]
        else:
            owners = list(zip(*[c.to_pylist() for c in marks]))
            cuts = [0, *[i for i in range(1, len(owners)) if owners[i] != owners[i - 1]], len(owners)]
            spans = [(owners[i], i, j) for i, j in zip(cuts, cuts[1:])]
        for owner, first, last in spans:
            lines = batch.column("line").slice(first, last - first).to_pylist()
            rows, begun, weight = [], 0, 0
            for at, line in enumerate(lines, 1):
                weight += len(line) + 1
                if weight >= PIECE_BYTES or at == len(lines):
                    rows.append(b"\n".join(lines[begun:at]) + b"\n")
                    begun, weight = at, 0
            values = [*[[v] * len(rows) for v in owner], list(range(number, number + len(rows))), rows]
            number += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


def _digests(head_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, size, plain, marked, seen, head = None, 0, None, None, 0, b""

        def row() -> pa.RecordBatch:
            # The last line feed was held back: the size tells whether there is one, and whether a mark was skipped.
            kind = {0: (plain, b"", True), 1: (plain, b"", False), -3: (marked, _MARK, True), -2: (marked, _MARK, False)}
            if seen - size not in kind:
                raise ValueError(f"{owner}: {seen} bytes read of {size}")
            digest, mark, ends = kind[seen - size]
            if ends:
                digest.update(b"\n")
            first = (mark + head)[: min(head_bytes, size)]
            values = [(owner, pa.string()), (first, pa.binary()), (digest.hexdigest(), pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["_file", "_head", "_sha256"])

        for batch in batches:
            for file, length, piece in zip(*[batch.column(c).to_pylist() for c in ("file", "size", "bytes")]):
                if file != owner:
                    if owner is not None:
                        yield row()
                    owner, size, plain, marked, seen, head = file, length, hashlib.sha256(), hashlib.sha256(_MARK), 0, b""
                else:
                    piece = b"\n" + piece
                    seen -= 1
                plain.update(memoryview(piece)[:-1])
                marked.update(memoryview(piece)[:-1])
                seen += len(piece)
                if len(head) < head_bytes:
                    head += piece[: head_bytes - len(head)]
        if owner is not None:
            yield row()

    return run


def inventory_folder(spark: SparkSession, path: str, glob: str = "*", signature_bytes: int = 5) -> DataFrame:
    """:func:`inventory_files` of files of any size: no row holds a file.

    Files are read as lines, raw bytes up to each line feed, in parts by many
    tasks; pieces of lines go to one task a file, in their order, since SHA-256 is
    a chain over the bytes.  Files that Spark would unpack are read whole.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = listed.select(F.col("_metadata.file_path").alias("_file"), "path", "length")
    packed = F.col("_file").rlike(_PACKED)
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    pieces = lines.filter(~packed).withColumnRenamed("_file", "file").mapInArrow(_pieces, "file string, size bigint, block bigint, no bigint, bytes binary")
    chained = pieces.repartition("file").sortWithinPartitions("file", "block", "no").select("file", "size", "bytes")
    hashed = chained.mapInArrow(_digests(signature_bytes), "_file string, _head binary, _sha256 string")
    # A file of one mark has no line.
    own = files.filter(~packed).join(hashed, "_file", "left").select(
        "path",
        F.decode(F.coalesce("_head", F.substring(F.lit(_MARK), 1, signature_bytes)), "ISO-8859-1").alias("signature"),
        F.col("length").cast("bigint").alias("length"),
        F.coalesce("_sha256", F.lit(hashlib.sha256(_MARK).hexdigest())).alias("sha256"),
    )
    if files.filter(packed).isEmpty():
        return own
    return own.unionByName(inventory_files(listed.filter(F.col("path").rlike(_PACKED)), signature_bytes=signature_bytes))


def verify_files(inventory: DataFrame, manifest: DataFrame, signature: Column | str) -> DataFrame:
    """SRC2: first mismatch per file: signature, length, size policy, hash.

    manifest: path, want_length, min_bytes, max_bytes, want_sha256.
    """
    want = signature if isinstance(signature, Column) else F.lit(signature)
    joined = inventory.join(manifest, "path", "full_outer")
    reason = (
        F.when(F.col("want_length").isNull(), "not-in-manifest")
        .when(F.col("length").isNull(), "file-missing")
        .when(F.col("signature") != want, "signature")
        .when(F.col("length") != F.col("want_length"), "byte-length")
        .when((F.col("length") < F.col("min_bytes")) | (F.col("length") > F.col("max_bytes")), "size-policy")
        .when(F.col("sha256") != F.col("want_sha256"), "sha256")
    )
    return joined.select("path", F.when(reason.isNull(), "verified").otherwise("rejected").alias("status"), reason.alias("reason"))

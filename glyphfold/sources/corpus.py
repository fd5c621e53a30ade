"""Corpus tables (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from glyphfold.schemas import TABLES
from glyphfold.session import cut_lineage
from glyphfold.sources.sinks import fingerprint_dataset

OUTCOMES = "name string, outcome string, expected string, observed string, rows bigint"


def read_corpus(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """SRC1: scan with a declared schema; pruning and pushdown are left to Spark."""
    return spark.read.schema(schema).format(format).load(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/{name}.parquet", TABLES[name])


def _fields(schema: T.StructType) -> str:
    return ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))


def load_verified(
    spark: SparkSession, name: str, path: str, schema: str, rows: int, sha256: str, format: str = "parquet"
) -> tuple[DataFrame, Row]:
    """SRC1: write, audit, publish: (the table, its outcome).

    What is read is written aside, and the copy is counted and fingerprinted
    (SNK2): what was audited is what is handed on, even if the source changes
    meanwhile.  It is handed on only if schema, number of rows and fingerprint
    are those of the manifest; else the table is empty and the outcome says why:
    name, outcome (LOADED, SCHEMA_MISMATCH, ROWS_MISMATCH or DIGEST_MISMATCH),
    expected, observed, rows (read).  Formats that carry a schema are compared by
    the names and types of their columns.
    """
    declared = T.StructType.fromDDL(schema)

    def refused(outcome: str, expected: str, observed: str, read: int) -> tuple[DataFrame, Row]:
        return spark.createDataFrame([], declared), Row(name=name, outcome=outcome, expected=expected, observed=observed, rows=read)

    if format in ("parquet", "orc"):
        # Only footers are read for this.
        found = _fields(spark.read.format(format).load(path).schema)
        if found != _fields(declared):
            return refused("SCHEMA_MISMATCH", _fields(declared), found, 0)
    staged = cut_lineage(read_corpus(spark, path, schema, format))
    mark = fingerprint_dataset(staged).first()
    if mark["rows"] != rows:
        return refused("ROWS_MISMATCH", str(rows), str(mark["rows"]), mark["rows"])
    if mark["sha256"] != sha256:
        return refused("DIGEST_MISMATCH", sha256, mark["sha256"], mark["rows"])
    return staged, Row(name=name, outcome="LOADED", expected=sha256, observed=mark["sha256"], rows=mark["rows"])

"""Session settings, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Text of a task where texts become a row for each word: about a hundred times as much in memory.
TASK_TEXT_BYTES = 2 << 20


#: Whether joins must meet on all their keys, and what this was before texts were dealt.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
KEYS_BEFORE = "spark.glyphfold.allKeysBefore"


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A session for tests and local benchmarks.  Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glyphfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and tasks share: ``spark.checkpoint.dir``, else a part of the warehouse.

    Everything that is written between jobs goes there: checkpoints, tables
    between stages, state and output of streams, reports.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: text and bytes by length, nested values by their JSON, 8 for the rest."""
    total = F.lit(8)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(field.name)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            part = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            part = F.lit(8)
        total = total + F.coalesce(part, F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when a bounded count of rows and bytes proves the side is small.

    Otherwise the side is returned unhinted and Spark plans a shuffle join.
    """
    some = df.limit(max_rows + 1).select(_row_bytes(df).cast("long").alias("b"))
    rows, size = some.agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def text_parts(texts: DataFrame, text: str = "text") -> int:
    """A number of partitions that grows with the text: one for each :data:`TASK_TEXT_BYTES`, at least one a core."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT_BYTES))


def deal(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` hashed by ``key`` into a fixed number of partitions, for texts that are taken apart behind it.

    Adaptive execution merges partitions by their bytes, and texts are small until
    they are taken apart: rows of words would then be sorted on disk.  Joins
    planned from here on may meet on a part of their keys, so what is dealt by
    document meets on (document, line, ...) as it lies; results do not change.
    Unions do not count as dealt: Spark 4.1 plans on it, but may still put their
    partitions one behind the other ("Can't zip RDDs with unequal numbers").
    """
    conf = df.sparkSession.conf
    own = conf.get(ALL_KEYS, None)
    if own != "false":
        conf.set(KEYS_BEFORE, own or "")
    conf.set(ALL_KEYS, "false")
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.repartition(parts, key)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning with a fixed count, for stages that run Python.

    Adaptive execution merges small partitions by bytes, which starves work
    that costs far more per byte than a JVM operator.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

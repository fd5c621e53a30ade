"""Strict JSON manifests (SRC3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _listed(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _keys_fail(json_text: Column, schema: T.StructType, required: list[str] | None, unknown: bool) -> Column:
    """Whether an object, or an object in it at any depth, has unknown keys (or lacks some)."""
    names = schema.fieldNames()
    have = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    wanted = names if required is None else required
    fails = F.size(F.array_except(have, _listed(names)) if unknown else F.array_except(_listed(wanted), have)) > 0
    for field in schema.fields:
        inner = F.get_json_object(json_text, f"$.{field.name}")
        if isinstance(field.dataType, T.StructType):
            nested = F.json_object_keys(inner).isNotNull() & _keys_fail(inner, field.dataType, None, unknown)
            fails = fails | F.coalesce(nested, F.lit(False))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            nested = F.exists(F.from_json(inner, "array<string>"), _member_fails(field.dataType.elementType, unknown))
            fails = fails | F.coalesce(nested, F.lit(False))
    return fails


def _member_fails(schema: T.StructType, unknown: bool) -> Callable[[Column], Column]:
    return lambda member: F.json_object_keys(member).isNotNull() & _keys_fail(member, schema, None, unknown)


def parse_manifest(
    df: DataFrame, json_col: str, schema: T.StructType | str, required: list[str] | None = None, ranges: dict[str, tuple] | None = None
) -> DataFrame:
    """Adds ``doc`` (the typed struct) and ``problem`` (null for a good record).

    Problems, in this order: not-an-object, unknown-key, missing-key,
    wrong-type, out-of-range.  Keys are exact at every depth of the schema.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()
    required = names if required is None else required
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn(
        "_m", F.from_json(json_col, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    keys = F.json_object_keys(json_col)
    out_of_range = F.lit(False)
    for field, (low, high) in (ranges or {}).items():
        out_of_range = out_of_range | ~F.col(f"_m.{field}").between(low, high)
    problem = (
        F.when(keys.isNull(), "not-an-object")
        .when(_keys_fail(F.col(json_col), schema, required, unknown=True), "unknown-key")
        .when(_keys_fail(F.col(json_col), schema, required, unknown=False), "missing-key")
        .when(F.col("_m._corrupt").isNotNull(), "wrong-type")
        .when(out_of_range, "out-of-range")
    )
    good = F.when(F.col("problem").isNull(), F.struct(*[F.col(f"_m.{n}").alias(n) for n in names]))
    return parsed.withColumn("problem", problem).withColumn("doc", good).drop("_m")


def read_manifest(
    df: DataFrame, json_col: str, schema: T.StructType | str, required: list[str] | None = None, ranges: dict[str, tuple] | None = None
) -> tuple[DataFrame, DataFrame]:
    """SRC3: (good, quarantine); bad records are named, none is dropped."""
    parsed = parse_manifest(df, json_col, schema, required, ranges)
    return parsed.filter("problem is null").drop("problem"), parsed.filter("problem is not null").drop("doc")


def child_table(good: DataFrame, keys: list[str], member: str) -> DataFrame:
    """SRC3: a nested array as rows with an ordinal."""
    rows = good.select(*keys, F.posexplode(f"doc.{member}").alias("ordinal", "_c"))
    inner = dict(rows.dtypes)["_c"]
    return rows.select(*keys, "ordinal", "_c.*") if inner.startswith("struct") else rows.withColumnRenamed("_c", member)

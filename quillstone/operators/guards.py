"""Type guards for nested JSON: absent, null, wrong type and right type told apart, natively through VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a stated type is called in the schema of a variant.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "whole": ("BIGINT", "TINYINT", "SMALLINT", "INT"), "number": ("BIGINT", "TINYINT", "SMALLINT", "INT", "DECIMAL", "DOUBLE", "FLOAT")}


def parsed(text: Column) -> Column:
    """JSON text as a variant: null where it is no JSON, or states a key twice."""
    return F.try_parse_json(text)


def state(value: Column, path: str, kind: str) -> Column:
    """`no document`, `absent`, `null`, `wrong type` or `ok` for the part of a variant at a path."""
    part = F.try_variant_get(value, path, "variant")
    shape = F.schema_of_variant(part)
    right = reduce(lambda a, b: a | b, (shape.startswith(name) for name in KINDS[kind]))
    return F.when(value.isNull(), "no document").when(part.isNull(), "absent").when(F.is_variant_null(part), "null").when(right, "ok").otherwise("wrong type")


def guarded(rows: DataFrame, column: str, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """rows with, for each name of parts (path, kind, type), its `<name>_state` and the value as that type where the state is ok.

    A value of the right kind that the type cannot hold is null with the state `out of range`."""
    made = rows.withColumn("_v", parsed(F.col(column)))
    for name, (path, kind, of) in parts.items():
        value = F.try_variant_get("_v", path, of)
        found = state(F.col("_v"), path, kind)
        made = made.withColumn(f"{name}_state", F.when((found == "ok") & value.isNull(), "out of range").otherwise(found)).withColumn(name, F.when(F.col(f"{name}_state") == "ok", value))
    return made.drop("_v")


def violations(rows: DataFrame, column: str, key: str, required: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, path, state) of every required part (path, kind) that is not what it should be."""
    checks = F.array(*(F.struct(F.lit(path).alias("path"), state(F.col("_v"), path, kind).alias("state")) for path, kind in required.values()))
    return rows.withColumn("_v", parsed(F.col(column))).select(F.col(key).cast("string").alias("key"), F.explode(checks).alias("c")).select("key", "c.*").where("state <> 'ok'")

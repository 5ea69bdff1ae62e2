"""JSON payloads of any shape, held as VARIANT values.

A payload is parsed once; its fields need no schema beforehand and nothing is cut to one. Text that is not JSON is
counted and not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MALFORMED, NOT_AN_OBJECT = "malformed", "no object"


def parsed(rows: DataFrame, text: str, out: str = "payload") -> DataFrame:
    """``rows`` with the payload as a VARIANT; NULL if the text is NULL or not JSON."""
    return rows.withColumn(out, F.try_parse_json(text))


def value_type(value: Column) -> Column:
    """The JSON type of a VARIANT value: object, array, string, number, boolean or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number"))


def payload_shapes(rows: DataFrame, group: str, text: str) -> DataFrame:
    """``group``, ``field``, ``type`` and the number of payloads (``n``) that have a field of this type.

    Payloads that are NULL, not JSON or no object have a row without a field.
    """
    held = parsed(rows.select(group, text), text, "_payload")
    is_object = F.schema_of_variant("_payload").startswith("OBJECT")
    objects = held.where(is_object).select(group, "_payload")
    fields = objects.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_payload").outer()))
    shapes = fields.groupBy(group, F.col("key").alias("field"), value_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"))
    reason = F.when(F.col(text).isNull(), "null").when(F.col("_payload").isNull(), MALFORMED).otherwise(NOT_AN_OBJECT)
    others = held.where(~F.coalesce(is_object, F.lit(False))).groupBy(group, reason.alias("type")).agg(F.count("*").alias("n"))
    return shapes.unionByName(others.select(group, F.lit(None).cast("string").alias("field"), "type", "n"))


def payload_schemas(rows: DataFrame, group: str, text: str) -> DataFrame:
    """One schema per group that all of its payloads fit, and how many are not JSON."""
    held = parsed(rows.select(group, text), text, "_payload")
    broken = F.sum((F.col("_payload").isNull() & F.col(text).isNotNull()).cast("long"))
    return held.groupBy(group).agg(F.schema_of_variant_agg("_payload").alias("payload_schema"), broken.alias("malformed"))


def payload_values(rows: DataFrame, text: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with fields of the payload: name to path and type. A missing field, or one of another type, is NULL."""
    held = parsed(rows, text, "_payload")
    return held.withColumns({
        name: F.try_variant_get("_payload", path, type_) for name, (path, type_) in paths.items()}).drop("_payload")

"""Values and results as JSON on the wire: {type: as_is | as_bin, value}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<type:string,value:string>"


def encode(value: Column, binary: bool = False) -> Column:
    """A value as JSON text; bytes travel as base64."""
    body = F.base64(value.cast("binary")) if binary else value.cast("string")
    return F.to_json(F.struct(F.lit("as_bin" if binary else "as_is").alias("type"), body.alias("value")))


def decode(text: Column) -> Column:
    """struct<type, value>; of as_bin the value is the decoded text."""
    s = F.from_json(text, SCHEMA)
    return F.struct(s["type"].alias("type"), F.when(s["type"] == "as_bin", F.unbase64(s["value"]).cast("string")).otherwise(s["value"]).alias("value"))


def log_entry(op: Column, key: Column, version: Column, status: Column, value: Column) -> Column:
    """An entry of a transaction log as opaque text, as clients carry it between calls."""
    return F.base64(F.to_json(F.struct(op.alias("op"), key.alias("key"), version.alias("version"), status.alias("status"), value.alias("value"))).cast("binary"))

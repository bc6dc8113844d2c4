"""Map-reduce jobs as chains of DataFrame phases.

A phase maps (k, v) rows to (k, v) rows, or reduces the values of each key. Declarative phases stay in
the JVM; a Python function runs over Arrow batches. Values that are lists are joined, not nested.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("map", "reduce", "map_python", "reduce_python")


@dataclass(frozen=True)
class Phase:
    """map: expression for array<struct<k, v>>; reduce: aggregate over v; *_python: function and schema."""

    kind: str
    do: Column | Callable
    schema: str | None = None


def problem(phases: list[Phase], options: dict) -> str | None:
    """What is wrong with a job, or None."""
    if not phases or any(p.kind not in KINDS for p in phases):
        return "bad_phase"
    if any(p.kind.endswith("_python") != (callable(p.do) and not isinstance(p.do, Column)) for p in phases) or any(p.kind.endswith("_python") and not p.schema for p in phases):
        return "badfun"
    return "bad_tag" if set(options) - {"tag"} or not isinstance(options.get("tag", ""), str) else None


def collected(df: DataFrame) -> DataFrame:
    """k and its list of values; lists are concatenated."""
    values = F.collect_list("v")
    return df.groupBy("k").agg((F.flatten(values) if isinstance(df.schema["v"].dataType, T.ArrayType) else values).alias("v"))


def run(df: DataFrame, phases: list[Phase], **options) -> DataFrame:
    """The job's rows (k, v); a wrong job gives one row with the error and no value."""
    if error := problem(phases, options):
        return df.sparkSession.createDataFrame([(error, None)], "k string, v string")
    if "tag" in df.columns:
        df = df.filter(F.col("tag") == options["tag"]) if "tag" in options else df.filter(F.col("tag").isNull())
    df = df.select("k", "v")
    for p in phases:
        if p.kind == "map":
            df = df.select(F.inline(p.do))
            df = df.toDF("k", "v")
        elif p.kind == "reduce":
            df = df.groupBy("k").agg(p.do.alias("v"))
        elif p.kind == "map_python":
            df = df.mapInPandas(p.do, p.schema)
        else:  # all keys of a partition to one call, as a node reduces what it holds
            df = collected(df).mapInPandas(p.do, p.schema)
    return df


#: The separators of the word count.
SEPARATORS = " \n,.;:?!()\"'_-"


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), f"[{SEPARATORS}]"), lambda w: w != "")

"""Exact deduplication by distributed most-significant-digit radix partitioning.

A text's radix key is its length followed by its bytes. A round splits every group by the next digit,
a run of bytes whose width grows eightfold, and keeps splitting only groups of several rows until
they end; the length comes first, so a group's texts end together, and most texts are alone after the
first round. Rows are equal when their group has ended: no digest takes part.

A group is counted with partial aggregation (a row a task and digit, however hot the group), and its
rows learn of it by a join of two written tables, which Spark splits where a group is large. Rounds
go through the shared folder. A digit is as many bytes as a group's rows have in common so far,
so there are as many rounds as the logarithm of the longest repeated text.

Defined results: null text equals empty text; the row with the largest id stays, a null id counting
as least, and of rows that repeat id and text one stays; rows in, rows out; an empty table gives none.
Input columns that clash with the result's names are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import discard, materialize, text_of

FIRST, GROW = 32, 8
RESULT = ("keep_id", "group_size", "kept")


def digit(at: int, width: int):
    return F.substring("bytes", at + 1, width)


def split(rows: DataFrame, keys: list) -> DataFrame:
    """The rows of groups that hold several, each with its group: the least of its rows."""
    keyed = rows.withColumn("digit", keys[-1])
    by = [*keys[:-1], "digit"]
    groups = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("next")).filter("n > 1").drop("n")
    # a merge at every size: with the rows' side dealt by key, Spark can split a large group
    both = keyed.join(materialize(groups, "groups").hint("merge"), by)
    return materialize(both.select("row", "id", "bytes", "size", F.col("next").alias("grp")), "split")


def equal_rows(keyed: DataFrame) -> DataFrame:
    """From row, id, bytes, size: row, id, grp of every row whose bytes another row has too."""
    active, at, width, ended, done = split(keyed, ["size", digit(0, FIRST)]), FIRST, FIRST * GROW, [], []
    while True:
        ended.append(active.filter(F.col("size") <= at).select("row", "id", "grp"))
        rest = active.filter(F.col("size") > at)
        if rest.isEmpty():
            break
        before, active = active, split(rest, ["grp", digit(at, width)])
        done.append(before)
        at, width = at + width, width * GROW
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    members = materialize(out, "members")
    for x in [*done, active]:
        discard(x)
    return members


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or its `columns`) with keep_id, group_size long, kept boolean."""
    columns = [c for c in (columns or docs.columns) if c not in RESULT]
    own = [f"c{i}" for i in range(len(columns))]  # whatever they are called outside, names don't clash here
    stored = [F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)]
    at = columns.index(text_col) if text_col in columns else None  # the text is stored once
    stored += [F.col(f"`{id_col}`").alias("id"), *([] if at is not None else [F.col(f"`{text_col}`").alias("c_text")])]
    table = materialize(docs.select(*stored).withColumn("row", F.monotonically_increasing_id()), "keyed")
    table = table.withColumn("bytes", text_of(own[at] if at is not None else "c_text").cast("binary")).withColumn("size", F.length("bytes").cast("long"))
    members = equal_rows(table.select("row", "id", "bytes", "size"))
    last = F.max(F.struct("id", "row"))
    groups = materialize(members.groupBy("grp").agg(last.alias("last"), F.count(F.lit(1)).alias("n")), "equal")
    found = members.join(groups.hint("merge"), "grp").select("row", F.col("last.id").alias("keep"), "n", (F.col("row") == F.col("last.row")).alias("stays"))
    out = table.select("row", "id", *own).join(materialize(found, "found").hint("merge"), "row", "left")
    return out.select(
        *(F.col(o).alias(c) for c, o in zip(columns, own, strict=True)),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("stays", F.lit(True)).alias("kept"),
    )

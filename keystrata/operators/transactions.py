"""Outcome of transaction logs over a store: validation, commits, ordered effects of operations on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sane(log: DataFrame, tx: str, key: str, status: str) -> DataFrame:
    """tx, ok, failed keys (sorted): a failed entry aborts its transaction."""
    bad = F.col(status) == "fail"
    return log.groupBy(tx).agg(F.bool_and(~bad).alias("ok"), F.array_sort(F.collect_set(F.when(bad, F.col(key)))).alias("failed"))


def read_valid(read_version: Column, stored_version: Column, write_locked: Column) -> Column:
    """A read stands if what it saw is not older than the store's version, and nobody writes."""
    return (read_version >= stored_version) & ~write_locked


def write_valid(log_version: Column, stored_version: Column, read_locks: Column, write_locked: Column) -> Column:
    """A write stands on the version it saw if no reader holds it, or on a newer one; never against another writer."""
    return (((log_version == stored_version) & (read_locks == 0)) | (log_version > stored_version)) & ~write_locked


def commit(store: DataFrame, writes: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The store after writes that carry the version they saw: version and value move on, outdated writes are ignored."""
    w = writes.groupBy(key).agg(F.max_by(value, version).alias("_x"), F.max(version).alias("_v"))
    both = store.select(key, version, value).join(w, key, "left")
    take = F.col("_v").isNotNull() & (F.col("_v") >= F.col(version))
    return both.select(key, F.when(take, F.col("_v") + 1).otherwise(F.col(version)).alias(version), F.when(take, F.col("_x")).otherwise(F.col(value)).alias(value))


def replay(ops: DataFrame, key: str, seq: str) -> DataFrame:
    """Final value and outcomes of each key's operations in order of seq.

    ops has op, arg, expected: write sets, add_on_nr adds (a missing number is 0), test_and_set sets
    if the value is as expected. Where a key has no test_and_set, its value is its last write and the
    sum of what was added since, both partial aggregates, so such a key may hold any share of the rows. Only
    operations that depend on the value before them have to be folded one after the other, as an ordered list.
    """
    write, add = F.col("op") == "write", F.col("op") == "add_on_nr"
    marks = ops.groupBy(key).agg(F.bool_or(F.col("op") == "test_and_set").alias("_tests"), F.max(F.when(write, F.struct(seq, F.col("arg").alias("_arg")))).alias("_w"), F.count(F.lit(1)).cast("int").alias("n"))
    plain = marks.filter("NOT _tests")
    since = ops.filter(add).join(plain, key).filter(F.col("_w").isNull() | (F.col(seq) > F.col("_w")[seq])).groupBy(key).agg(F.sum("arg").alias("_add"))
    value = F.when(F.col("_add").isNull(), F.col("_w._arg")).otherwise(F.coalesce("_w._arg", F.lit(0.0)) + F.col("_add"))
    done = plain.join(since, key, "left").select(key, value.alias("value"), F.lit(0).alias("failed"), "n")

    start = F.struct(F.lit(None).cast("double").alias("value"), F.lit(0).alias("failed"), F.lit(0).alias("n"))

    def step(acc: Column, o: Column) -> Column:
        fits = (o["op"] != "test_and_set") | acc["value"].eqNullSafe(o["expected"])
        value = F.when(o["op"] == "add_on_nr", F.coalesce(acc["value"], F.lit(0.0)) + o["arg"]).when(fits & o["op"].isin("write", "test_and_set"), o["arg"]).otherwise(acc["value"])
        return F.struct(value.alias("value"), (acc["failed"] + F.when(fits, 0).otherwise(1)).alias("failed"), (acc["n"] + 1).alias("n"))

    tested = ops.join(marks.filter("_tests").select(key), key, "left_semi")
    lists = tested.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seq, "op", "arg", "expected"))).alias("ops"))
    return done.unionByName(lists.select(key, F.aggregate("ops", start, step).alias("r")).select(key, "r.value", "r.failed", "r.n"))


def results(ops: DataFrame, tx: str, seq: str, op: str) -> DataFrame:
    """ops with ok (its list was taken) and result: of a list that commits before its end, or twice, every request is answered as aborted."""
    lists = checked(ops, tx, seq, op)
    aborted = F.when(F.col(op) == "commit", "fail abort").when(F.col(op) == "read", "fail not_found").otherwise("ok")
    return ops.join(lists, tx).withColumn("result", F.when(F.col("ok"), "ok").otherwise(aborted))


def checked(ops: DataFrame, tx: str, seq: str, op: str) -> DataFrame:
    """tx, ok: a request list may commit once, and only as its last request."""
    last = ops.groupBy(tx).agg(F.max(seq).alias("_last"), F.max(F.when(F.col(op) == "commit", F.col(seq))).alias("_commit"), F.count_if(F.col(op) == "commit").alias("_n"))
    return last.select(tx, ((F.col("_n") == 0) | ((F.col("_n") == 1) & (F.col("_commit") == F.col("_last")))).alias("ok"))


def transfer(accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """Balances after moves (src, dst, amount): what one loses another gets."""
    out = moves.select(F.col("src").alias("key"), (-F.col("amount")).alias("d")).unionByName(moves.select(F.col("dst").alias("key"), F.col("amount").alias("d")))
    return accounts.join(out.groupBy("key").agg(F.sum("d").alias("d")), "key", "left").select("key", (F.col("balance") + F.coalesce("d", F.lit(0))).alias("balance"))

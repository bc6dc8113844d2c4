"""The store's client interface over DataFrames: single operations, request lists, and the JSON call names.

A Store is an immutable table (key, value, version). Every write gives a new Store whose table is a plan
over the old one; commit() writes it down. Results are DataFrames or plain values with a status, as
failures are results here, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import lists as ls
from keystrata.operators import mapreduce
from keystrata.operators import store as st
from keystrata.sources.scratch import materialize

OK = {"status": "ok"}


def fail(reason: str) -> dict:
    return {"status": "fail", "reason": reason}


@dataclass(frozen=True)
class Store:
    rows: DataFrame  # key, value, version
    depth: int = 0  # writes that the plan holds
    #: After so many writes the state is written down: a plan must not grow with the number of writes.
    HELD = 16

    @staticmethod
    def of(spark: SparkSession, pairs: list[tuple], kind: str = "string") -> Store:
        return Store(spark.createDataFrame([(k, v, 0) for k, v in pairs], f"key string, value {kind}, version long"))

    def commit(self) -> Store:
        """Write the state down, so that later plans start from it."""
        return Store(materialize(self.rows, "store"))

    # reads
    def read(self, key: str) -> dict:
        got = st.point(self.rows, "key", key).select("value").first()
        return OK | {"value": got.value} if got else fail("not_found")

    def read_range(self, lo: str, hi: str) -> DataFrame:
        return self.rows.filter(st.in_range("key", lo, hi))

    def read_chunk(self, start: str, lo: str, hi: str, n: int) -> DataFrame:
        return st.chunk(self.rows, "key", start, lo, hi, n)

    def read_sublist(self, key: str, start: int, length: int) -> dict:
        """Part of a list and the whole list's length."""
        if start == 0:
            return fail("bad_start")
        got = st.point(self.rows, "key", key)
        if not self._is("array"):
            return fail("not_a_list") if got.first() else fail("not_found")
        r = got.select(ls.sublist(F.col("value"), F.lit(start), F.lit(length)).alias("v"), F.size("value").alias("n")).first()
        return OK | {"value": (r.v, r.n)} if r else fail("not_found")

    def read_random(self, key: str, seed: int = 0) -> dict:
        if not self._is("array"):
            return fail("not_a_list")
        r = st.point(self.rows, "key", key).select(F.size("value").alias("n"), F.get("value", F.pmod(F.xxhash64("key", F.lit(seed)), F.greatest(F.size("value"), F.lit(1))).cast("int")).alias("v")).first()
        return fail("not_found") if r is None else fail("empty_list") if r.n == 0 else OK | {"value": (r.v, r.n)}

    def snapshot(self) -> DataFrame:
        """Every key once, with its newest value."""
        return st.latest(self.rows, ["key"], "version", ["value"])

    def count(self) -> int:
        return self.rows.count()

    def _is(self, kind: str) -> bool:
        return self.rows.schema["value"].dataType.simpleString().startswith(kind)

    # writes
    def _set(self, key: str, value: Callable[[Column], Column]) -> Store:
        """The key's value replaced by value(old), which is null for a new key."""
        kind, own = self.rows.schema["value"].dataType, F.col("key") == key
        if st.point(self.rows, "key", key).isEmpty():
            new = self.rows.sparkSession.range(1).select(F.lit(key).alias("key"), value(F.lit(None).cast(kind)).cast(kind).alias("value"), F.lit(0).cast("long").alias("version"))
            out = Store(self.rows.select("key", "value", "version").unionByName(new), self.depth + 1)
        else:
            change = {"value": F.when(own, value(F.col("value")).cast(kind)).otherwise(F.col("value")), "version": F.when(own, F.col("version") + 1).otherwise(F.col("version"))}
            out = Store(self.rows.select("key", "value", "version").withColumns(change), self.depth + 1)
        return out.commit() if out.depth >= self.HELD else out

    def write(self, key: str, value) -> Store:
        return self._set(key, lambda _: F.lit(value))

    def write_all(self, changes: DataFrame) -> Store:
        """Many writes in one plan: changes has key, value, version."""
        return Store(st.upsert(self.rows, changes, "key", "version", ["value"]).select("key", "value", "version"))

    def add_on_number(self, key: str, x) -> tuple[Store, dict]:
        if self._is("string") or self._is("array"):
            return self, fail("not_a_number")
        return (self, OK) if x == 0 else (self._set(key, lambda v: F.coalesce(v, F.lit(0)) + x), OK)

    def add_del_on_list(self, key: str, add: list, remove: list) -> tuple[Store, dict]:
        if not self._is("array"):
            return self, fail("not_a_list")
        if not add and not remove:
            return self, OK
        kind = self.rows.schema["value"].dataType
        arr = lambda x: F.array(*(F.lit(i) for i in x)).cast(kind)
        return self._set(key, lambda v: ls.add_then_remove(v, arr(add), arr(remove))), OK

    def test_and_set(self, key: str, expected, value) -> tuple[Store, dict]:
        """Sets the value if it is as expected; else tells the real one."""
        got = self.read(key)
        if got["status"] != "ok":
            return self, got
        return (self.write(key, value), OK) if got["value"] == expected else (self, fail("key_changed") | {"value": got["value"]})

    def delete(self, keys: list[str]) -> tuple[Store, dict]:
        """Without the keys; ok counts those that were there, undef the others."""
        there = {r.key for r in st.points(self.rows, "key", keys).select("key").collect()}
        return Store(self.rows.filter(~F.col("key").isin(keys))), {"ok": len(there), "undef": len(set(keys) - there)}

    def request_list(self, requests: list[tuple]) -> tuple[Store, list[dict]]:
        """Requests in order, reads seeing earlier writes; a commit may only be the last. Without it, or if one fails, nothing stays."""
        if any(r[0] == "commit" for r in requests[:-1]):
            return self, [fail("abort")] * len(requests)
        now, out = self, []
        for op, *args in requests:
            if op == "commit":
                bad = any(r["status"] == "fail" and r.get("reason") != "not_found" for r in out)
                return (self, [*out, fail("abort")]) if bad else (now, [*out, OK])
            got = getattr(now, {"add_on_nr": "add_on_number"}.get(op, op))(*args)
            if isinstance(got, Store):
                now, got = got, OK
            elif isinstance(got, tuple):
                now, got = got
            out.append(got)
        return self, out

    def request_each(self, requests: list[tuple]) -> tuple[Store, list[dict]]:
        """Requests that each commit on their own: one that fails takes no other along."""
        now, out = self, []
        for r in requests:
            now, got = now.request_list([r, ("commit",)])
            out.append(got[0])
        return now, out

    def continued(self, log: list[tuple], requests: list[tuple] | None = None) -> tuple[Store, list[tuple], list[dict]]:
        """A request list that carries the log of earlier, uncommitted ones: the new store, the new log (empty after a commit) and the new requests' results."""
        log, requests = ([], log) if requests is None else (log, requests)
        now, got = self.request_list([*log, *requests])
        done = bool(requests) and requests[-1][0] == "commit"
        return now, [] if done else [*log, *requests], got[len(log) :]

    # the store as a service
    def nop(self, _=None) -> dict:
        return OK

    def node_info(self) -> dict:
        return OK | {"value": {"version": "1", "language": "Spark " + self.rows.sparkSession.version, "load": self.count()}}

    def node_performance(self) -> dict:
        """Entries and the versions that they have reached: what a node has stored and been asked to write."""
        r = self.rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("version"), F.lit(0)).alias("writes")).first()
        return OK | {"value": {"entries": r.n, "writes": r.writes}}

    def service_info(self) -> dict:
        return OK | {"value": {"total_load": self.count(), "nodes": self.ring_size()["value"]}}

    def service_performance(self) -> dict:
        return self.node_performance()

    def replication_factor(self) -> dict:
        """One copy: keeping others is the shared storage's."""
        return OK | {"value": 1}

    def ring_size(self, _timeout: int | None = None) -> dict:
        """The parts that hold the table."""
        return OK | {"value": max(1, len(self.rows.inputFiles()))}

    def wait_for_ring_size(self, size: int, _timeout: int | None = None) -> dict:
        return OK if self.ring_size()["value"] == size else fail("timeout")

    def benchmark(self, write: bool, rounds: int = 8) -> dict:
        """Seconds and operations a second of increments, or of reads, on one key."""
        import time

        now, began = self, time.perf_counter()
        for i in range(rounds):
            if write:
                now = now.write("benchmark", None).commit()
            else:
                now.read("benchmark")
        took = time.perf_counter() - began
        return OK | {"value": {"rounds": rounds, "seconds": took, "per_second": rounds / took}}

    def benchmark_incr(self) -> dict:
        return self.benchmark(True)

    def benchmark_read(self) -> dict:
        return self.benchmark(False)

    def map_reduce(self, phases: list[mapreduce.Phase], **options) -> DataFrame:
        cols = ["tag"] if "tag" in self.rows.columns else []
        return mapreduce.run(self.rows.select(*cols, F.col("key").alias("k"), F.col("value").alias("v")), phases, **options)


def monitor(nodes: DataFrame, value: str) -> DataFrame:
    """Load figures over a node table."""
    x = F.col(value)
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.coalesce(F.avg(x), F.lit(0.0)).alias("average"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("deviation"))


#: Names of JSON calls and what they do.
CALLS = {
    "read": "read", "range_read": "read_range", "write": "write", "add_on_nr": "add_on_number", "add_del_on_list": "add_del_on_list",
    "test_and_set": "test_and_set", "delete": "delete", "req_list": "continued", "req_list_commit_each": "request_each", "nop": "nop",
    "get_node_info": "node_info", "get_node_performance": "node_performance", "get_service_info": "service_info", "get_service_performance": "service_performance",
    "get_replication_factor": "replication_factor", "rbr_read": "read", "rbr_write": "write", "get_ring_size": "ring_size", "wait_for_ring_size": "wait_for_ring_size",
    "run_benchmark_incr": "benchmark_incr", "run_benchmark_read": "benchmark_read",
}


def handle(store: Store, call: str, params: list):
    """A JSON call on a store; an unknown one is a result too."""
    return getattr(store, CALLS[call])(*params) if call in CALLS else fail("unknown_call")

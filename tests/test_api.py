"""The client interface: single operations, request lists, calls by name."""

from keystrata.api import CALLS, Store, handle, monitor


def test_numbers(spark):
    s = Store.of(spark, [("a", 1000), ("b", 0)], "long")
    assert s.read("a")["value"] == 1000 and s.read("x")["reason"] == "not_found"
    s, r = s.add_on_number("a", -5)
    s, _ = s.add_on_number("new", 7)
    assert r["status"] == "ok" and s.read("a")["value"] == 995 and s.read("new")["value"] == 7
    same, r = s.test_and_set("a", 1, 2)
    assert r["reason"] == "key_changed" and r["value"] == 995 and same is s
    s, r = s.test_and_set("a", 995, 1)
    assert r["status"] == "ok" and s.commit().read("a")["value"] == 1
    s, r = s.delete(["a", "nope"])
    assert r == {"ok": 1, "undef": 1} and s.count() == 2
    assert s.add_del_on_list("b", [1], [])[1]["reason"] == "not_a_list"
    assert {x.key for x in s.read_range("b", "m").collect()} == {"b"}
    assert [x.key for x in s.read_chunk("c", "a", "z", 1).collect()] == ["new"]


def test_lists(spark):
    s = Store.of(spark, [("l", [1, 2, 1, 3]), ("e", [])], "array<int>")
    s, _ = s.add_del_on_list("l", [9], [1, 3, 7])
    assert s.read("l")["value"] == [9, 2, 1]
    assert s.read_sublist("l", -2, 5)["value"] == ([2, 1], 3) and s.read_sublist("x", 1, 1)["reason"] == "not_found" and s.read_sublist("l", 0, 1)["status"] == "fail"
    assert s.read_random("l")["value"][0] in (9, 2, 1) and s.read_random("e")["reason"] == "empty_list"
    assert s.add_on_number("l", 1)[1]["reason"] == "not_a_number"


def test_request_lists(spark):
    s = Store.of(spark, [("a", "x")])
    done, r = s.request_list([("write", "a", "y"), ("read", "a"), ("write", "b", "z"), ("commit",)])
    assert r[1]["value"] == "y" and done.read("b")["value"] == "z"
    same, r = s.request_list([("write", "a", "y"), ("test_and_set", "a", "wrong", "q"), ("commit",)])
    assert same.read("a")["value"] == "x" and r[-1]["reason"] == "abort"
    assert s.request_list([("commit",), ("read", "a")])[1][0]["reason"] == "abort"
    assert s.request_list([("write", "a", "y")])[0].read("a")["value"] == "x"


def test_calls(spark):
    s = Store.of(spark, [("a", "x"), ("b", "y")])
    assert handle(s, "read", ["a"])["value"] == "x" and handle(s, "nope", [])["reason"] == "unknown_call"
    assert all(hasattr(Store, m) for m in CALLS.values())
    assert monitor(spark.createDataFrame([(1.0,), (3.0,)], "load double"), "load").first().average == 2.0
    assert {r.key: r.value for r in s.write_all(spark.createDataFrame([("a", "n", 4)], "key string, value string, version long")).snapshot().collect()} == {"a": "n", "b": "y"}


def test_service_calls(spark):
    s = Store.of(spark, [("a", "x"), ("b", "y")])
    assert handle(s, "nop", [1])["status"] == "ok" and handle(s, "get_replication_factor", [])["value"] == 1
    assert handle(s, "get_node_info", [])["value"]["load"] == 2 and handle(s, "get_service_info", [])["value"]["total_load"] == 2
    assert handle(s, "get_node_performance", [])["value"]["entries"] == 2 and handle(s, "get_ring_size", [100])["value"] >= 1
    assert handle(s, "wait_for_ring_size", [10**9, 1])["reason"] == "timeout"
    assert handle(handle(s, "rbr_write", ["a", "z"]), "rbr_read", ["a"])["value"] == "z"
    assert handle(s, "run_benchmark_read", [])["value"]["rounds"] == 8


def test_each_request_commits(spark):
    s, got = handle(Store.of(spark, [("a", "x")]), "req_list_commit_each", [[("write", "a", "y"), ("test_and_set", "a", "no", "q"), ("write", "b", "z"), ("read", "b")]])
    assert [r["status"] for r in got] == ["ok", "fail", "ok", "ok"] and s.read("a")["value"] == "y" and got[3]["value"] == "z"


def test_a_list_carries_its_log(spark):
    s = Store.of(spark, [("a", "x")])
    same, log, got = handle(s, "req_list", [[("write", "a", "y")]])
    assert same.read("a")["value"] == "x" and len(log) == 1 and got == [{"status": "ok"}]
    done, log, got = handle(s, "req_list", [log, [("read", "a"), ("commit",)]])
    assert got[0]["value"] == "y" and done.read("a")["value"] == "y" and log == []


def test_many_writes_keep_the_plan_short(spark):
    s = Store.of(spark, [("k", "0")])
    for i in range(40):
        s = s.write("k", str(i))
        assert s.depth < Store.HELD
    assert s.read("k")["value"] == "39" and s.count() == 1

"""The state of a changelog against a plain dictionary, and the operators on hand-made logs."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import index, log, ranges, state
from recordlake.plans import query

KIND = "seq long, op string, table_name string, key string, data string, indexed_fields map<string,string>"


def make(spark, rows):
    return spark.createDataFrame(rows, KIND)


def plain(rows):
    live, first = {}, {}
    for seq, op, t, k, data, fields in sorted(rows):
        if op == "S":
            live[t, k] = (seq, data, fields)
            first.setdefault((t, k), seq)
        elif op == "D":
            live.pop((t, k), None)
            first.pop((t, k), None)
        else:
            for x in [x for x in live if x[0] == t]:
                live.pop(x)
                first.pop(x)
    return live, first


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs(spark, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(300):
        op = r.choices("SDXT", [70, 20, 1, 1])[0]
        t = f"t{r.randrange(3)}"
        key = None if op in "XT" else f"k{r.randrange(12)}"
        rows.append((seq, op, t, key, f"v{seq}" if op == "S" else None, {"f": str(r.randrange(3))} if op == "S" else None))
    r.shuffle(rows)
    df = make(spark, rows)
    scoped = state.with_marks(df, state.effective_marks(df))
    live, first = plain(rows)
    assert {((x.table_name, x.key), (x.seq, x.data)) for x in state.live(scoped).collect()} == {(k, v[:2]) for k, v in live.items()}
    assert {((x.table_name, x.key), x.first_seq) for x in state.live_paged(scoped).collect()} == set(first.items())
    want = {k for k, v in live.items() if v[2]["f"] == "1"}
    assert {(x.table_name, x.key) for x in index.lookup_latest(scoped, "f", "1").collect()} == want


def test_mark_of_an_empty_table_does_nothing(spark):
    rows = [(1, "X", "t", None, None, None), (2, "S", "t", "a", "1", None), (3, "D", "t", "a", None, None), (4, "T", "t", None, None, None), (5, "S", "t", "a", "2", None)]
    df = make(spark, rows)
    assert state.effective_marks(df).collect() == []
    assert [x.data for x in state.live(df).collect()] == ["2"]


def test_lookup_accumulated_keeps_old_values(spark):
    rows = [(1, "S", "t", "a", "1", {"s": "active"}), (2, "S", "t", "a", "2", {"s": "inactive"}), (3, "S", "t", "b", "3", {"s": "active"}), (4, "D", "t", "b", None, None), (5, "S", "t", "b", "5", {"s": "inactive"})]
    df = make(spark, rows)
    assert [(x.key, x.data) for x in index.lookup_accumulated(df, "s", "active").collect()] == [("a", "2")]
    assert index.lookup_latest(df, "s", "active").collect() == []


def test_no_backfill(spark):
    df = make(spark, [(1, "S", "t", "a", "1", {"s": "x"}), (3, "S", "t", "b", "2", {"s": "x", "other": "x"})])
    indexes = spark.createDataFrame([("t", "s", 2)], "table_name string, field string, created_seq long")
    assert [(x.key, x.field) for x in index.postings(df, indexes).collect()] == [("b", "s")]


@pytest.mark.parametrize(("probe", "at"), [("apple", 0), ("banana", 4096), ("blueberry", 4096), ("cherry", 8192), ("aardvark", 0)])
def test_sparse_floor(spark, probe, at):
    entries = spark.createDataFrame([("t", "apple", 0), ("t", "banana", 4096), ("t", "cherry", 8192)], "table_name string, key string, at long")
    probes = spark.createDataFrame([("t", probe)], "table_name string, key string")
    assert index.sparse_floor(probes, entries).first().floor == at


@pytest.mark.parametrize("n", range(12))
def test_runs_left(spark, n):
    runs = 0
    for _ in range(n):
        runs += 1
        if runs == 4:
            runs = 1
    got = index.runs_left(spark.createDataFrame([("t", "f", n)], "table_name string, field string, n long"), 4)
    assert got.first().runs == runs


def test_running_sums_cross_ranges(spark):
    df = spark.createDataFrame([(i * 7, i) for i in range(50)], "seq long, v long")
    got = {x.seq: x.s for x in log.running_before(df, "seq", {"s": F.col("v")}, width=40).collect()}
    assert got == {i * 7: sum(range(i)) for i in range(50)}


@pytest.mark.parametrize("values", [[], [5], [1, 3, 3, 7, 9, 12]])
def test_upper_bound(spark, values):
    df = spark.range(15).select("id", ranges.upper_bound(F.lit(values).cast("array<long>") if values else F.array().cast("array<long>"), F.col("id")).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: bisect.bisect_right(values, i) for i in range(15)}


def test_ranks_and_carried_values_equal_one_window(spark):
    r = random.Random(5)
    keys = sorted({f"common prefix {r.choice('abä漢')}{r.randrange(10**r.randrange(1, 9))}" for _ in range(400)})
    rows = [(r.choice("tu"), k, r.randrange(100) if r.random() < 0.3 else None) for k in keys]
    df = spark.createDataFrame(rows, "table_name string, key string, at long").repartition(5)
    span = ranges.key_range(df, "key", 25)
    spread = {x.key: x.n for x in df.select("key", span.alias("n")).collect()}
    in_order = sorted(keys, key=str.encode)
    assert [spread[k] for k in in_order] == sorted(spread.values()) and len(set(spread.values())) > 8
    got = {(x.table_name, x.key): x.place for x in ranges.ranked(df, ["table_name"], ["key"], span, "place").collect()}
    last = {(x.table_name, x.key): x.v for x in ranges.carried(df, ["table_name"], ["key"], span, "at", "v").collect()}
    for t in "tu":
        seen = None
        for n, (_, k, at) in enumerate(sorted((x for x in rows if x[0] == t), key=lambda x: x[1].encode())):
            seen = at if at is not None else seen
            assert got[t, k] == n and last[t, k] == seen


def test_deletes_across_ranges(spark):
    r = random.Random(8)
    rows = [(seq, r.choice("SSD"), "t", f"k{r.randrange(3)}", "x", None) for seq in range(200)]
    live, want = set(), set()
    for seq, op, _, k, *_ in rows:
        if op == "D" and k in live:
            want.add(seq)
        (live.add if op == "S" else live.discard)(k)
    for width in (7, 64, 1000):
        assert {x.seq for x in state.effective_deletes(make(spark, rows), width).collect()} == want


def test_valid_prefix_and_torn_commit(spark):
    df = spark.createDataFrame([(i, i == 5) for i in range(9)], "seq long, bad boolean")
    assert log.valid_prefix(df, F.col("bad")).count() == 5
    planned = spark.createDataFrame([(1, 0, 0), (1, 3, 4), (2, 9, 9)], "commit_id long, planned_offset long, data_offset long").withColumn("data", F.lit("x")).withColumn("table_name", F.lit("t"))
    assert {x.commit_id: x.accepted for x in log.check_plans(planned).collect()} == {1: False, 2: True}


def test_compaction(spark):
    rows = [(1, "S", "t", "a", "1", None), (2, "S", "t", "a", "2", None), (3, "S", "t", "b", "3", None), (4, "D", "t", "b", None, None), (5, "S", "u", "c", "5", None), (6, "S", "u", "c", "6", None), (7, "D", "t", "zz", None, None)]
    df = make(spark, rows)
    assert state.removed_count(df).first().removed == 1
    assert sorted(x.seq for x in state.compacted(df).collect()) == [2, 6]
    assert sorted(x.seq for x in state.compacted(df, ["t"]).collect()) == [2, 5, 6]


def test_batch_needs_an_order(spark):
    with pytest.raises(ValueError):
        state.last_in_batch(spark.range(1).toDF("a"), ["a"], [])


def test_router(spark):
    rows = [(i, "S", "t", f"k{i}", f"text {'Alice' if i % 2 else 'bob'} {i}", {"c": "x" if i < 3 else "y"}) for i in range(6)]
    df = make(spark, rows)
    keys = lambda **a: [x.key for x in query.filter_records(df, "t", **a).collect()]
    assert keys() == [f"k{i}" for i in range(6)]
    assert keys(skip=1, take=2) == ["k1", "k2"]
    assert keys(value="ALICE") == ["k1", "k3", "k5"]
    assert keys(value="ALICE", ignore_case=False) == []
    assert keys(value="alice", skip=1, take=1) == ["k3"]
    assert keys(field="c", value="x", indexed=True) == ["k0", "k1", "k2"]
    assert keys(field="c", value="X", indexed=True) == []
    assert keys(field="c", value="alice", indexed=False) == ["k1", "k3", "k5"]
    assert keys(field="c", take=0) == []
    with pytest.raises(ValueError):
        keys(field="c")
    for bad in ({"skip": -1}, {"take": -1}):
        with pytest.raises(ValueError):
            keys(**bad)


def test_multi_get_keeps_order_and_repeats(spark):
    df = make(spark, [(i, "S", "t", k, k, None) for i, k in enumerate("abc")])
    assert [x.key for x in query.multi_get(df, "t", ["c", "z", "a", "c"]).collect()] == ["c", "a", "c"]
    assert [x.key for x in query.multi_get(df, "t", ["c", "z", "a", "c"], 1, 1).collect()] == ["a"]

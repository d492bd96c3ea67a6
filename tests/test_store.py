"""The persistent store end to end."""

from __future__ import annotations

import json
import shutil
import time
import uuid

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from recordlake.functions.checks import EMPTY_KEY
from recordlake.operators import runs
from recordlake.plans import query
from recordlake.sources.changelog import CHANGELOG
from recordlake.sources.store import ClosedError, Options, RecordStore

K = [str(uuid.UUID(int=i + 1)) for i in range(12)]


@pytest.fixture
def store(spark, tmp_path):
    with RecordStore(spark, str(tmp_path / "db")) as s:
        yield s


def test_save_get_update_delete(store):
    users = store.open_table("Users")
    users.save(K[0], json.dumps({"name": "Alice", "age": 28}))
    users.save(K[0], {"name": "Alice", "age": 29}, data_selector=json.dumps)
    row = users.get(K[0])
    assert json.loads(bytes(row.data))["age"] == 29 and row.version == 2 and not row.is_deleted and row.expires_at is None
    users.delete(K[1])
    users.delete(K[0])
    assert users.get(K[0]) is None and not store.table_exists("Users")


def test_batches(store):
    t = store.open_table("B")
    assert t.save_batch([(K[0], "A"), (K[1], "x"), (K[0], "B")], lambda i: i[0], lambda i: i[1]) == 3
    assert bytes(t.get(K[0]).data) == b"B" and t.count() == 2
    with pytest.raises(ValueError):
        t.save_batch([(K[2], "ok"), (EMPTY_KEY, "no")], lambda i: i[0], lambda i: i[1])
    with pytest.raises(ValueError):
        t.save_batch([], lambda i: i, lambda i: i)
    with pytest.raises(ValueError, match="empty"):
        t.save(K[3], "")
    assert t.count() == 2
    t.delete_batch([K[0], K[0], EMPTY_KEY, K[9]])
    assert [r.key for r in t.stream()] == [K[1]]
    assert [r.key for r in t.get_many([K[1], K[0], K[1]]).collect()] == [K[1], K[1]]


def test_frame_batch(store, spark):
    t = store.open_table("F")
    df = spark.range(20).select("id", (F.col("id") % 10).alias("k"))
    key = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("k") + 1).cast("string"), 12, "0"))
    assert t.save_frame(df, key, F.encode(F.col("id").cast("string"), "UTF-8"), "id") == 20
    assert t.count() == 10 and {int(bytes(r.data)) for r in t.stream()} == set(range(10, 20))
    with pytest.raises(ValueError):
        t.save_frame(df.withColumn("same", F.lit(1)), key, F.lit("x"), "same")


def test_drop_truncate_and_indexes(store):
    t = store.open_table("P")
    t.ensure_index("category")
    assert t.truncate() == 0 and t.has_index("category")  # nothing there: nothing happens
    t.save(K[0], '{"name":"Laptop"}', {"category": "Electronics"})
    t.save(K[1], '{"name":"Chair"}', {"category": "Furniture"})
    assert [r.key for r in t.filter("category", "Electronics").collect()] == [K[0]]
    assert t.filter("category", "electronics").collect() == []
    assert [r.key for r in t.filter("other", "chair").collect()] == [K[1]]
    assert t.info()["record_count"] == 2 and [f for f, _ in t.info()["indexes"]] == ["category"]
    assert t.truncate() == 2 and t.count() == 0 and not t.has_index("category")
    t.save(K[2], "new")
    assert store.list_tables() == ["P"] and store.drop_table("P") == 1 and store.list_tables() == []


def test_compaction_and_reopening(spark, tmp_path):
    path = str(tmp_path / "db")
    with RecordStore(spark, path) as s:
        t = s.open_table("C")
        t.save(K[0], "1")
        t.save(K[0], "2")
        assert s.compact() == 0
        t.save(K[1], "3")
        t.delete(K[1])
        with pytest.raises(RuntimeError):
            RecordStore(spark, path)
        s.checkpoint()
    with RecordStore(spark, path) as s:
        t = s.open_table("C")
        assert bytes(t.get(K[0]).data) == b"2" and t.get(K[1]) is None
        assert s.compact() == 1 and s.compact() == 0
        assert s.changelog().count() == 1
        t.save(K[2], "4")
        assert t.count() == 2
    with pytest.raises(ClosedError):
        t.count()
    with RecordStore(spark, path, Options(reset_on_open=True)) as s:
        assert s.list_tables() == []


def test_files_that_no_pointer_names_do_not_count(spark, tmp_path):
    path = str(tmp_path / "db")
    with RecordStore(spark, path) as s:
        s.open_table("T").save(K[0], "1")
        torn = s.changelog().withColumn("key", F.lit(K[1]))
        torn.write.parquet(f"{path}/log/commit-000000000002-torn")
    with RecordStore(spark, path) as s:
        assert s.open_table("T").count() == 1


def test_marks_are_read_without_a_job(store, spark):
    """A point read is one scan of its table's rows, after a drop too."""
    for name in ("A", "B"):
        t = store.open_table(name)
        t.save(K[0], name)
        t.save(K[1], name)
    assert store.drop_table("B") == 2
    store.open_table("B").save(K[2], "new")
    store.checkpoint()
    t = store.open_table("B")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = query.get(t._log(), "B", K[2])._jdf.queryExecution().toString()
    assert "EqualTo(table_name,B)" in plan and f"EqualTo(key,{K[2]})" in plan and "GreaterThan(seq,5)" in plan and "Join" not in plan
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("point read", "")
    try:
        assert bytes(t.get(K[2]).data) == b"new" and t.get(K[0]) is None
        # one job for what is found, at most two with the adaptive re-planning of an aggregate
        assert len(tracker.getJobIdsForGroup("point read")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_old_versions_do_not_come_back(spark, tmp_path):
    path = str(tmp_path / "db")
    with RecordStore(spark, path) as s:
        t = s.open_table("C")
        for data in "12":
            t.save(K[0], data)
            t.save(K[1], data)
        t.delete(K[0])
        u = s.open_table("U")
        u.save(K[3], "u")
        assert s.drop_table("U") == 1
        assert s.compact(["C"]) == 1 and t.get(K[0]) is None and bytes(t.get(K[1]).data) == b"2"
        assert s.compact() == 1 and s.compact() == 0
    with RecordStore(spark, path) as s:
        assert s.list_tables() == ["C"] and s.open_table("C").get(K[0]) is None and s.open_table("U").count() == 0


def damage(spark, path, name):
    """A committed row whose data no longer has its checksum."""
    rows = spark.read.schema(CHANGELOG).parquet(f"{path}/{name}").collect()
    spark.createDataFrame([(*r[:6], bytearray(b"other"), *r[7:]) if r.op == "S" else r for r in rows], CHANGELOG).write.mode("overwrite").parquet(f"{path}/{name}")


@pytest.mark.parametrize("how", ["checksum", "missing", "short"])
def test_the_log_ends_before_a_damaged_commit(spark, tmp_path, how):
    path = str(tmp_path / "db")
    with RecordStore(spark, path) as s:
        t = s.open_table("T")
        t.save(K[0], "base")
        s.checkpoint()
        t.save(K[1], "1")
        t.save_batch([(K[2], "2"), (K[3], "3")], lambda i: i[0], lambda i: i[1])
        t.save(K[4], "4")
        s.drop_table("T")
        bad = s._current.commits[1]["name"]
    if how == "checksum":
        damage(spark, path, bad)
    elif how == "missing":
        shutil.rmtree(f"{path}/{bad}")
    else:
        first = spark.createDataFrame(spark.read.schema(CHANGELOG).parquet(f"{path}/{bad}").take(1), CHANGELOG)
        first.write.mode("overwrite").parquet(f"{path}/{bad}")
    with RecordStore(spark, path) as s:
        t = s.open_table("T")
        # the whole batch is gone, and all after it, the drop too
        assert sorted(r.key for r in t.stream()) == [K[0], K[1]]
        t.save(K[5], "5")
        assert t.count() == 3
    with RecordStore(spark, path) as s:
        assert s.open_table("T").count() == 3


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "db")
    with RecordStore(spark, path, Options(index_flush=3, index_merge=3)) as s:
        t = s.open_table("I")
        t.save(K[0], "before", {"c": "x"})
        t.ensure_index("c")
        for i in range(1, 9):
            t.save(K[i], str(i), {"c": "x" if i % 2 else "y", "undeclared": "z"})
        # flushed at 3 and 6 mappings; two are in the log alone
        assert [r["rows"] for r in s._current.runs] == [3, 3] and s._current.unflushed == 2
        hits = lambda v, t=t: sorted(r.key for r in t.filter("c", v).collect())
        assert hits("x") == K[1:9:2] and hits("y") == K[2:9:2] and hits("X") == [] and s.index_runs().filter("field = 'undeclared'").isEmpty()
        t.save(K[1], "moved", {"c": "y"})  # third run: merged to one
        assert [r["rows"] for r in s._current.runs] == [9] and s.index_runs().count() == 9
        assert hits("x") == K[3:9:2] and hits("y") == sorted([K[1], *K[2:9:2]])
        t.delete(K[2])
        assert K[2] not in hits("y")
        plan = s.index_runs().filter("table_name = 'I' AND field = 'c' AND value = 'x'")._jdf.queryExecution().toString()
        assert "EqualTo(value,x)" in plan
        assert s.compact() == 1 and hits("x") == K[3:9:2]
    with RecordStore(spark, path) as s:
        t = s.open_table("I")
        assert hits("x", t) == K[3:9:2]
        t.drop_index("c")
        t.ensure_index("c")  # no backfill
        assert hits("x", t) == []


def test_runs_are_sorted_and_have_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [("t", "f", f"v{i % 300:04d}", f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, runs.RUN).repartition(5)
    runs.write_run(df.union(df), str(tmp_path / "run"), 3000)
    files = sorted((tmp_path / "run").glob("*.parquet"))
    back = [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()]
    assert back == sorted(rows, key=lambda r: r[:4])
    assert runs.lookup(runs.read_run(spark, str(tmp_path / "run")), "t", "f", "v0007").count() == 10
    assert runs.lookup(runs.read_run(spark, str(tmp_path / "run")), "t", "f", "absent").count() == 0
    assert runs.read_run(spark).count() == 0


def test_bloom_filters_of_a_run_exclude_absent_values(spark, tmp_path):
    """Where values are too many for a dictionary page, which would tell exactly which there are."""
    path = str(tmp_path / "run")
    value = F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("-present"))
    runs.write_run(spark.range(60_000).select(F.lit("t").alias("table_name"), F.lit("f").alias("field"), value.alias("value"), F.col("id").cast("string").alias("key"), F.col("id").alias("seq")), path, 60_000)
    jvm = spark._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(next((tmp_path / "run").glob("*.parquet")))), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        block = reader.getFooter().getBlocks().get(0)
        bloom = reader.getBloomFilterDataReader(block).readBloomFilter(block.getColumns().get(2))
        held = lambda t: bloom.findHash(bloom.hash(jvm.org.apache.parquet.io.api.Binary.fromString(t)))
        known = [r.value for r in runs.read_run(spark, path).limit(500).collect()]
        assert all(held(v) for v in known)
        assert sum(held(v.replace("present", "absent")) for v in known) <= 25  # one in twenty at most
    finally:
        reader.close()


def test_a_cancelled_batch_is_no_commit(store, spark):
    t = store.open_table("X")
    key = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("id") + 1).cast("string"), 12, "0"))
    failed = []

    def save():
        try:
            with store.cancellable("slow save"):
                t.save_frame(spark.range(4).withColumn("slow", F.expr("java_method('java.lang.Thread', 'sleep', 20000L)")), key, F.concat(F.lit("x"), F.coalesce("slow", F.lit(""))), "id")
        except Exception as e:
            failed.append(e)

    thread = InheritableThread(save)
    thread.start()
    time.sleep(3)
    store.cancel("slow save")
    thread.join(30)
    assert failed and not thread.is_alive() and t.count() == 0


def test_options_and_paths(spark):
    for bad in ({"checkpoint_interval": 0}, {"lookup": "other"}, {"index_flush": 0}, {"index_merge": -1}, {"file_bytes": 0}, {"ignore_case": "yes"}):
        with pytest.raises(ValueError):
            Options(**bad)
    for bad in (" ", None, "/", "s3a://", "/data/..", "/data/a\nb", "/data/nul", "/data/COM1.db"):
        with pytest.raises(ValueError):
            RecordStore(spark, bad)

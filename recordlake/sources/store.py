"""A persistent record store: commits as directories, one pointer file that says which count.

Layout under the root: ``log/`` holds one Parquet directory a commit, ``base/`` compacted logs, ``index/`` sorted runs of
postings, ``_CURRENT`` the state (which base, which commits, the marks of drops and truncates, the index catalog and its
runs), ``_LOCK`` the writer. A commit is written to a staging name, renamed, and then named by the pointer, which is replaced
by a rename; a torn write leaves files that no pointer names. All files go through Hadoop's file system API, so the root can
be on any store that Spark writes to. Reads are lazy plans over immutable files and need no lock.

Opening checks the commits since the last base (``verify_on_open``): a missing or short commit, or a row whose checksum is wrong, ends the log
before that commit. Bases are sorted by table, key and seq, so a point read prunes files and row groups by their
statistics. Marks are in the pointer: a read of a table is a filter, with no job to find them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordlake.functions import checks
from recordlake.functions.text import content_match, crc
from recordlake.operators import runs, state
from recordlake.operators.index import postings
from recordlake.operators.state import DELETE, DROP, SAVE, TRUNCATE
from recordlake.plans import query
from recordlake.sources.changelog import CHANGELOG

Fields = Mapping[str, str] | None


@dataclass
class Index:
    table_name: str
    field: str
    created_at_utc: int
    created_seq: int


@dataclass
class Current:
    commit_id: int = 0
    seq: int = 0
    base: str | None = None
    base_seq: int = 0
    #: name, commit_id, rows, seq of each commit since the base
    commits: list[dict] = field(default_factory=list)
    #: table_name, seq, killed (records) of each effective drop or truncate since the table was compacted
    marks: list[dict] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    #: name, rows of the sorted runs of postings; they hold the log up to ``flushed``
    runs: list[dict] = field(default_factory=list)
    flushed: int = 0
    unflushed: int = 0


@dataclass(frozen=True)
class Options:
    ignore_case: bool = True
    checkpoint_interval: int = 1000
    index_flush: int = 4096  # mappings that make a run
    index_merge: int = 4  # runs that are merged to one
    file_bytes: int = 128 << 20  # of a rewritten log
    verify_on_open: bool = True  # read the commits since the last base and end the log before a damaged one
    lookup: str = "latest"
    reset_on_open: bool = False
    delete_on_close: bool = False

    def __post_init__(self) -> None:
        for name in ("checkpoint_interval", "index_flush", "index_merge", "file_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive.")
        if not isinstance(self.ignore_case, bool):
            raise ValueError("ignore_case must be True or False: comparison is by ordinal, with or without case.")
        if self.lookup not in ("latest", "accumulated"):
            raise ValueError("lookup must be 'latest' or 'accumulated'.")


class ClosedError(RuntimeError):
    """The store is closed."""


class RecordStore:
    """Named tables of keyed records. One writer at a time; a ``with`` block closes it."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.spark, self.path, self.options = spark, checks.path(path), options or Options()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        try:
            self._fs.create(self._path(f"{self.path}/_LOCK"), False).close()
        except Exception as e:
            raise RuntimeError(f"{self.path} is open elsewhere; if its owner is gone, remove {self.path}/_LOCK.") from e
        self._open = True
        if self.options.reset_on_open:
            self._wipe()
        self._current = self._load()
        if self.options.verify_on_open:
            self.verify()

    # lifecycle
    def __enter__(self) -> RecordStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if not self._open:
            return
        if self.options.delete_on_close:
            self._wipe()
        self._fs.delete(self._path(f"{self.path}/_LOCK"), False)
        self._open = False

    def _ensure_open(self) -> None:
        if not self._open:
            raise ClosedError("The store is closed.")

    def _wipe(self) -> None:
        for name in ("log", "base", "index", "staged", "_CURRENT"):
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    # the pointer
    def _load(self) -> Current:
        at = self._path(f"{self.path}/_CURRENT")
        if not self._fs.exists(at):
            return Current()
        stream = self._fs.open(at)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return Current(**json.loads(data))

    def _publish(self, current: Current) -> None:
        staged = self._path(f"{self.path}/_CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(asdict(current)).encode()))
        out.close()
        # a rename over an existing file in one step, as Spark's own commit logs do
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(staged), context.makeQualified(self._path(f"{self.path}/_CURRENT")), options)
        self._current = current

    def verify(self) -> None:
        """End the log before the first commit that is not whole; one job over the commits since the base, if there are any."""
        self._ensure_open()
        now = self._current
        there = [c for c in now.commits if self._fs.exists(self._path(f"{self.path}/{c['name']}"))]
        found = {}
        if there:
            rows = self.spark.read.schema(CHANGELOG).option("ignoreCorruptFiles", "true").parquet(*(f"{self.path}/{c['name']}" for c in there))
            wrong = F.col("data").isNotNull() & ~F.col("crc").eqNullSafe(crc(F.col("data")))
            found = {r.commit_id: (r.n, r.wrong) for r in rows.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).toLocalIterator()}
        whole = next((k for k, c in enumerate(now.commits) if found.get(c["commit_id"]) != (c["rows"], 0)), None)
        if whole is None:
            return
        kept = now.commits[:whole]
        seq = kept[-1]["seq"] if kept else now.base_seq
        # runs may hold what is lost: they are made anew
        self._publish(replace(now, commits=kept, seq=seq, marks=[m for m in now.marks if m["seq"] <= seq], runs=[], flushed=0, unflushed=seq))
        for path in [c["name"] for c in now.commits[whole:]] + [r["name"] for r in now.runs]:
            self._fs.delete(self._path(f"{self.path}/{path}"), True)

    # the log
    def _files(self) -> list[str]:
        now = self._current
        return ([now.base] if now.base else []) + [c["name"] for c in now.commits]

    def changelog(self) -> DataFrame:
        """Every committed row, saves, deletes and marks."""
        self._ensure_open()
        paths = [f"{self.path}/{p}" for p in self._files()]
        if not paths:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*paths)

    def _mark(self, table: str) -> int:
        return max((m["seq"] for m in self._current.marks if m["table_name"] == table), default=0)

    def effective_log(self, table: str | None = None) -> DataFrame:
        """The changelog, of one table or of all, after the last effective drop or truncate of each table."""
        log = self.changelog()
        if table is not None:
            return log.filter((F.col("table_name") == table) & (F.col("seq") > self._mark(table)))
        marks = {m["table_name"]: self._mark(m["table_name"]) for m in self._current.marks}
        return state.with_marks(log, self.spark.createDataFrame(list(marks.items()), "table_name string, mark long")) if marks else log

    @contextmanager
    def cancellable(self, tag: str) -> Iterator[None]:
        """Jobs that this thread starts inside can be stopped by ``cancel``; a commit that is stopped is not named by the pointer."""
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Stop the running jobs of ``tag``, from any thread."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _append(self, rows: DataFrame, count: int, span: int | None = None, mappings: int = 0, **changes: Any) -> int:
        """``rows``: ``ord`` (from 0, under ``span``), op, table_name, key, data, indexed_fields; one atomic commit.

        ``mappings``: at most so many postings of declared indexes are among them; ``changes`` of the pointer come with it.
        """
        now = self._current
        commit, base = now.commit_id + 1, now.seq
        full = rows.select(
            F.lit(commit).cast("long").alias("commit_id"), F.col("ord").cast("long").alias("ord"), (F.lit(base) + 1 + F.col("ord")).cast("long").alias("seq"), "op", "table_name", "key",
            F.col("data").cast("binary").alias("data"), F.col("indexed_fields").cast("map<string,string>").alias("indexed_fields"), F.crc32("data").alias("crc"), F.lit(None).cast("long").alias("expires_at"),
        )
        name = f"log/commit-{commit:012d}-{uuid.uuid4().hex[:8]}"
        full.write.parquet(f"{self.path}/{name}.staged")
        if not self._fs.rename(self._path(f"{self.path}/{name}.staged"), self._path(f"{self.path}/{name}")):
            raise OSError(f"could not rename {name}")
        seq = base + (count if span is None else span)
        made = {"name": name, "commit_id": commit, "rows": count, "seq": seq}
        self._publish(replace(now, commit_id=commit, seq=seq, commits=[*now.commits, made], unflushed=now.unflushed + mappings, **changes))
        if self._current.unflushed >= self.options.index_flush:
            self.flush_index()
        if len(self._current.commits) >= self.options.checkpoint_interval:
            self.checkpoint()
        return count

    def _append_local(self, rows: list[tuple], **changes: Any) -> int:
        kind = "ord long, op string, table_name string, key string, data binary, indexed_fields map<string,string>"
        declared = {(i["table_name"], i["field"]) for i in self._current.indexes}
        mappings = sum((r[2], f) in declared for r in rows for f in (r[5] or ()))
        return self._append(self.spark.createDataFrame(rows, kind), len(rows), mappings=mappings, **changes)

    def checkpoint(self) -> None:
        """Many small commits as one base; nothing is dropped."""
        if self._current.commits:
            self._rewrite(self.changelog(), self._current.marks)

    def _rewrite(self, log: DataFrame, marks: list[dict]) -> None:
        old = self._files()
        name = f"base/{uuid.uuid4().hex}"
        size = sum(self._fs.getContentSummary(self._path(f"{self.path}/{p}")).getLength() for p in old)
        # by range, with seq, so that a key with most versions is many files and a table or key is few
        order = ["table_name", "key", "seq"]
        log.repartitionByRange(max(1, -(-size // self.options.file_bytes)), *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{name}")
        self._publish(replace(self._current, base=name, base_seq=self._current.seq, commits=[], marks=marks))
        for p in old:
            self._fs.delete(self._path(f"{self.path}/{p}"), True)

    # stored indexes
    def flush_index(self) -> None:
        """The postings since the last flush as a sorted run; as many runs as ``index_merge`` become one."""
        now = self._current
        if now.unflushed:
            name = f"index/run-{now.seq:020d}-{uuid.uuid4().hex[:8]}"
            runs.write_run(self._unflushed(), f"{self.path}/{name}", now.unflushed)
            now = replace(now, runs=[*now.runs, {"name": name, "rows": now.unflushed}], flushed=now.seq, unflushed=0)
            self._publish(now)
        if len(now.runs) >= self.options.index_merge:
            name, rows = f"index/run-{now.seq:020d}-{uuid.uuid4().hex[:8]}", sum(r["rows"] for r in now.runs)
            runs.write_run(self.index_runs(), f"{self.path}/{name}", rows)
            self._publish(replace(now, runs=[{"name": name, "rows": rows}]))
            for r in now.runs:
                self._fs.delete(self._path(f"{self.path}/{r['name']}"), True)

    def _unflushed(self) -> DataFrame:
        return postings(self.changelog().filter(F.col("seq") > self._current.flushed), self.indexes())

    def index_runs(self) -> DataFrame:
        """The mappings of all runs."""
        return runs.read_run(self.spark, *(f"{self.path}/{r['name']}" for r in self._current.runs))

    def index_lookup(self, table: str, field: str, value: str) -> DataFrame:
        """``key, seq`` of the saves that gave a key the value, from the runs and the log since the last flush.

        Saves before the index was declared are not there, nor those before the table's last mark.
        """
        made = max((i["created_seq"] for i in self._current.indexes if (i["table_name"], i["field"]) == (table, field)), default=None)
        if made is None:
            return runs.lookup(runs.read_run(self.spark), table, field, value)
        found = runs.lookup(self.index_runs(), table, field, value).unionByName(runs.lookup(self._unflushed(), table, field, value))
        return found.filter(F.col("seq") > max(made, self._mark(table)))

    # tables
    def open_table(self, name: str) -> RecordTable:
        self._ensure_open()
        return RecordTable(self, checks.table_name(name))

    def list_tables(self) -> list[str]:
        return sorted(r.table_name for r in query.list_tables(self.effective_log()).toLocalIterator())

    def table_exists(self, name: str) -> bool:
        return not state.live(self.effective_log(name)).limit(1).isEmpty()

    def drop_table(self, name: str) -> int:
        return self._wipe_table(name, DROP)

    def _wipe_table(self, name: str, op: str) -> int:
        self._ensure_open()
        checks.table_name(name)
        gone = self.open_table(name).count()
        if gone:
            now = self._current
            mark = {"table_name": name, "seq": now.seq + 1, "killed": gone}
            left = [i for i in now.indexes if i["table_name"] != name]
            self._append_local([(0, op, name, None, None, None)], indexes=left, marks=[*now.marks, mark])
        return gone

    def compact(self, tables: list[str] | None = None) -> int:
        """Rewrite the log to live rows in scope; returns how many records had been removed since the last time. Nothing removed: no rewrite."""
        self._ensure_open()
        out = lambda m: bool(tables) and m["table_name"] not in tables
        kept = self.effective_log()
        killed = sum(m["killed"] for m in self._current.marks if not out(m))
        removed = state.removed_count(kept, tables).first()[0] + killed
        if removed:
            log = self.changelog()
            out_of_scope = log.filter(~F.col("table_name").isin(*tables)) if tables else log.limit(0)
            self._rewrite(state.compacted(state.in_scope(kept, tables)).unionByName(out_of_scope), [m for m in self._current.marks if out(m)])
        return removed

    # indexes
    def indexes(self) -> DataFrame:
        self._ensure_open()
        return self.spark.createDataFrame([(i["table_name"], i["field"], i["created_at_utc"], i["created_seq"]) for i in self._current.indexes], "table_name string, field string, created_at_utc long, created_seq long")


class RecordTable:
    """A named table of a store; holds no state."""

    def __init__(self, store: RecordStore, name: str) -> None:
        self.store, self.name = store, name

    def _log(self) -> DataFrame:
        return self.store.effective_log(self.name)

    # writes
    def save(self, key: object, data: str | bytes | Any, indexed_fields: Fields = None, data_selector: Callable[[Any], str | bytes] | None = None) -> None:
        """Insert or replace; with ``data_selector``, ``data`` is an object it turns into text or bytes."""
        self.store._ensure_open()
        raw = checks.payload(data_selector(data) if data_selector else data)
        self.store._append_local([(0, SAVE, self.name, checks.key_text(key), raw, dict(indexed_fields) if indexed_fields else None)])

    def save_batch(self, items: Iterable[Any], key_selector: Callable[[Any], object], data_selector: Callable[[Any], str | bytes], indexed_fields_selector: Callable[[Any], Fields] | None = None) -> int:
        """All items in one commit or none; of equal keys the last wins."""
        self.store._ensure_open()
        items = list(items)
        if not items:
            raise ValueError("The batch is empty.")
        rows = []
        for i, item in enumerate(items):
            key = checks.key_text(key_selector(item))
            if key == checks.EMPTY_KEY:
                raise ValueError("Batch keys cannot be empty.")
            fields = indexed_fields_selector(item) if indexed_fields_selector else None
            rows.append((i, SAVE, self.name, key, checks.payload(data_selector(item)), dict(fields) if fields else None))
        return self.store._append_local(rows)

    def save_frame(self, df: DataFrame, key: Column, data: Column, order_by: str, indexed_fields: Column | None = None) -> int:
        """A batch from a DataFrame, whose rows ``order_by`` (unique) puts in order; never through the driver."""
        self.store._ensure_open()
        fields = indexed_fields if indexed_fields is not None else F.lit(None)
        made = df.select(F.col(order_by).cast("long").alias("place"), key.cast("string").alias("key"), data.cast("binary").alias("data"), fields.cast("map<string,string>").alias("indexed_fields"))
        # evaluated once: what is checked is what is committed
        staged = f"{self.store.path}/staged/{uuid.uuid4().hex}"
        try:
            made.write.parquet(staged)
            rows = self.store.spark.read.schema(made.schema).parquet(staged)
            bad = F.col("key").isNull() | (F.col("key") == checks.EMPTY_KEY) | F.col("data").isNull() | (F.octet_length("data") == 0) | F.col("place").isNull()
            lowest, highest, n, wrong = rows.agg(F.min("place"), F.max("place"), F.count(F.lit(1)), F.count_if(bad)).first()
            if not n:
                raise ValueError("The batch is empty.")
            if wrong:
                raise ValueError("Every row needs a key, an order and non-empty data.")
            if not rows.groupBy("place").count().filter("count > 1").isEmpty():
                raise ValueError("order_by has equal values: the last of equal keys would be undefined.")
            declared = sum(i["table_name"] == self.name for i in self.store._current.indexes)
            # gaps in the order are gaps in seq, which only has to rise
            rows = rows.withColumn("ord", F.col("place") - F.lit(lowest)).withColumn("op", F.lit(SAVE)).withColumn("table_name", F.lit(self.name))
            self.store._append(rows, n, highest - lowest + 1, n * declared)
        finally:
            self.store._fs.delete(self.store._path(staged), True)
        return n

    def delete(self, key: object) -> None:
        """A missing key changes nothing."""
        self.store._ensure_open()
        if self.get(key) is not None:
            self.store._append_local([(0, DELETE, self.name, checks.key_text(key), None, None)])

    def delete_batch(self, items: Iterable[Any], key_selector: Callable[[Any], object] | None = None) -> None:
        self.store._ensure_open()
        keys = dict.fromkeys(checks.key_text(key_selector(i) if key_selector else i) for i in items)
        keys.pop(checks.EMPTY_KEY, None)
        if keys:
            self.store._append_local([(i, DELETE, self.name, k, None, None) for i, k in enumerate(keys)])

    def delete_frame(self, df: DataFrame, key: Column) -> int:
        """Delete the different keys of a DataFrame, in one commit, never through the driver; missing keys change nothing."""
        self.store._ensure_open()
        keys = df.select(key.cast("string").alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != checks.EMPTY_KEY)).distinct()
        staged = f"{self.store.path}/staged/{uuid.uuid4().hex}"
        try:
            keys.write.parquet(staged)
            rows = self.store.spark.read.schema("key string").parquet(staged)
            n = rows.count()
            if n:  # the keys differ, so they need no order among them
                rows = rows.withColumn("ord", F.lit(0)).withColumn("op", F.lit(DELETE)).withColumn("table_name", F.lit(self.name)).withColumn("data", F.lit(None)).withColumn("indexed_fields", F.lit(None))
                self.store._append(rows, n, 1)
        finally:
            self.store._fs.delete(self.store._path(staged), True)
        return n

    def truncate(self) -> int:
        return self.store._wipe_table(self.name, TRUNCATE)

    # reads
    def _records(self, df: DataFrame) -> DataFrame:
        return df.select("table_name", "key", "data", F.col("seq").alias("version"), F.lit(False).alias("is_deleted"), F.lit(None).cast("long").alias("expires_at"))

    def get(self, key: object) -> Row | None:
        found = self._records(query.get(self._log(), self.name, checks.key_text(key))).take(1)
        return found[0] if found else None

    def get_many(self, keys: Iterable[object], skip: int = 0, take: int | None = None) -> DataFrame:
        return query.multi_get(self._log(), self.name, [checks.key_text(k) for k in keys], skip, take)

    def filter(self, field: str | None = None, value: str | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
        self.store._ensure_open()
        indexed = bool(field) and self.has_index(field)
        log = self._log()
        if indexed and value:  # the stored index tells which keys can have the value; only their rows are aggregated
            log = log.join(self.store.index_lookup(self.name, field, value).select("key").distinct(), "key", "left_semi")
        found = query.filter_records(log, self.name, field, value, skip, take, indexed, self.store.indexes(), self.store.options.ignore_case, self.store.options.lookup)
        return self._records(found)

    def stream(self, value: str | None = None) -> Iterator[Row]:
        """A pull iterator over a snapshot, one partition ahead of the reader."""
        found = state.live(self._log())
        if value:
            found = found.filter(content_match(F.col("data"), "contains", value, self.store.options.ignore_case))
        return self._records(found).toLocalIterator(prefetchPartitions=True)

    def count(self) -> int:
        return state.live(self._log()).count()

    def info(self) -> dict[str, Any]:
        mine = [i for i in self.store._current.indexes if i["table_name"] == self.name]
        return {"table_name": self.name, "record_count": self.count(), "indexes": [(i["field"], i["created_at_utc"]) for i in mine]}

    # indexes
    def has_index(self, field: str) -> bool:
        return any(i["table_name"] == self.name and i["field"] == field for i in self.store._current.indexes)

    def ensure_index(self, field: str) -> None:
        """Declare an index on a field of later saves; there is no backfill."""
        self.store._ensure_open()
        checks.field_name(field)
        if not self.has_index(field):
            made = asdict(Index(self.name, field, time.time_ns() // 100, self.store._current.seq))
            self.store._publish(replace(self.store._current, indexes=[*self.store._current.indexes, made]))

    def drop_index(self, field: str) -> None:
        self.store._ensure_open()
        checks.field_name(field)
        left = [i for i in self.store._current.indexes if (i["table_name"], i["field"]) != (self.name, field)]
        self.store._publish(replace(self.store._current, indexes=left))



"""The registered queries of the record store's own operators, and the same in plain SQL.

Changelogs: ``events`` (errors delete, users are keys), ``documents``, ``orders`` and ``conversations``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.checks import EMPTY_KEY
from recordlake.functions.text import content_match, crc, text_lenient, try_text
from recordlake.operators import index, log, runs, state
from recordlake.operators.ranges import key_range, ranked
from recordlake.plans import query
from recordlake.sources.changelog import events_log, key_of, records_log
from recordlake.sources.store import Options, RecordStore
from recordlake.streaming.replay import read_changes, replay

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: the events changelog and its state, in SQL
LOG = """log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, concat('users_', CAST(user_id % 4 AS VARCHAR)) AS table_name,
  CASE WHEN event_type = 'error' THEN 'D' ELSE 'S' END AS op, props AS data, event_type AS f FROM events)"""
TAGGED = """tagged AS (SELECT *, coalesce(max(CASE WHEN op = 'D' THEN seq END) OVER (PARTITION BY table_name, key), -1) AS last_d FROM log)"""
STATE = """state AS (SELECT table_name, key, arg_max(op, seq) AS op, arg_max(data, seq) AS data, arg_max(f, seq) AS f, max(seq) AS seq,
  min(CASE WHEN op = 'S' AND seq > last_d THEN seq END) AS first_seq FROM tagged GROUP BY table_name, key)"""
LIVE = f"WITH {LOG}, {TAGGED}, {STATE}, live AS (SELECT * FROM state WHERE op = 'S') "
DOCS_LIVE = "FROM documents WHERE text IS NOT NULL AND "


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(_t(spark, sf_dir, "events"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return records_log(d, F.col("doc_id"), "documents", F.col("doc_id"), F.encode("text", "UTF-8"), {"lang": F.col("lang"), "source": F.col("source")})


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return records_log(o, F.col("o_orderkey"), "orders", F.col("o_orderkey"), F.col("o_orderpriority"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# scans and reads


@register(LIVE + "SELECT table_name, key, data, seq FROM live")
def scan_live(spark, d):
    return state.live(_events(spark, d)).select("table_name", "key", "data", "seq")


@register(LIVE + "SELECT table_name, key, data, first_seq FROM live WHERE table_name = 'users_2' ORDER BY first_seq LIMIT 10 OFFSET 5")
def scan_paged(spark, d):
    return query.filter_records(_events(spark, d), "users_2", skip=5, take=10).select("table_name", "key", "data", "first_seq")


@register(LIVE + "SELECT table_name, key, first_seq FROM live")
def first_seq_order(spark, d):
    return state.live_paged(_events(spark, d)).select("table_name", "key", "first_seq")


@register(LIVE + "SELECT table_name, key, data, seq FROM live WHERE table_name = 'users_1' AND key = '13'")
def point_get_hit(spark, d):
    return query.get(_events(spark, d), "users_1", "13").select("table_name", "key", "data", "seq")


@register(LIVE + "SELECT table_name, key, data, seq FROM live WHERE table_name = 'users_1' AND key = '4'")
def point_get_miss(spark, d):
    return query.get(_events(spark, d), "users_1", "4").select("table_name", "key", "data", "seq")


ASKED = ["42", "no such key", "2", "6", "42", "10", "14", "22", "26", "30"]


@register(LIVE + ", asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(ASKED)) + ") v(pos, key)) SELECT pos::BIGINT AS pos, table_name, key, data, seq FROM live JOIN asked USING (key) WHERE table_name = 'users_2' ORDER BY pos LIMIT 6 OFFSET 1")
def multi_get_ordered(spark, d):
    return query.multi_get(_events(spark, d), "users_2", ASKED, 1, 6)


# content predicates


@register(f"SELECT doc_id::VARCHAR AS key {DOCS_LIVE} contains(lower(text), lower('The'))")
def filter_contains_ci(spark, d):
    return state.live(_documents(spark, d)).filter(content_match(F.col("data"), "contains", "The")).select("key")


@register(f"SELECT doc_id::VARCHAR AS key {DOCS_LIVE} contains(text, 'The')")
def filter_contains_cs(spark, d):
    return state.live(_documents(spark, d)).filter(content_match(F.col("data"), "contains", "The", False)).select("key")


def _conversations(spark, d):
    c = _t(spark, d, "conversations")
    return records_log(c, F.col("conv_id") * 1000 + F.col("turn"), "conversations", F.concat_ws("-", "conv_id", "turn"), F.col("role"), {"role": F.col("role")})


@register("SELECT concat_ws('-', conv_id, turn) AS key, role AS text FROM conversations WHERE lower(role) = 'user'")
def filter_equals_ci(spark, d):
    return state.live(_conversations(spark, d)).filter(content_match(F.col("data"), "equals", "USER")).select("key", text_lenient(F.col("data")).alias("text"))


@register("SELECT concat_ws('-', conv_id, turn) AS key, role AS text FROM conversations WHERE lower(role) < 'user'")
def filter_lt(spark, d):
    return state.live(_conversations(spark, d)).filter(content_match(F.col("data"), "less", "User")).select("key", text_lenient(F.col("data")).alias("text"))


@register("SELECT concat_ws('-', conv_id, turn) AS key, role AS text FROM conversations WHERE role > 'assistant'")
def filter_gt(spark, d):
    return state.live(_conversations(spark, d)).filter(content_match(F.col("data"), "greater", "assistant", False)).select("key", text_lenient(F.col("data")).alias("text"))


@register("SELECT doc_id::VARCHAR AS key, doc_id AS first_seq FROM documents WHERE contains(lower(text), 'token') ORDER BY doc_id LIMIT 20 OFFSET 3")
def filter_contains_paged(spark, d):
    return query.filter_records(_documents(spark, d), "documents", value="Token", skip=3, take=20).select("key", "first_seq")


@register("""SELECT doc_id::VARCHAR AS key, doc_id % 7 <> 0 AS ok FROM documents WHERE doc_id % 7 <> 0 AND contains(lower(text), 'the')""")
def filter_invalid_utf8(spark, d):
    docs = _t(spark, d, "documents")
    data = F.when(F.col("doc_id") % 7 == 0, F.lit(bytearray(b"\xc3\x28"))).otherwise(F.encode("text", "UTF-8"))
    live = state.live(records_log(docs, F.col("doc_id"), "documents", F.col("doc_id"), data))
    return live.filter(content_match(F.col("data"), "contains", "the")).select("key", try_text(F.col("data"))["ok"].alias("ok"))


@register("""SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 7 = 0 THEN chr(65533) || '(' ELSE text END AS lenient, doc_id % 7 <> 0 AS ok,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS strict FROM documents""")
def text_of_payload(spark, d):
    docs = _t(spark, d, "documents")
    data = F.when(F.col("doc_id") % 7 == 0, F.lit(bytearray(b"\xc3\x28"))).otherwise(F.encode("text", "UTF-8"))
    live = state.live(records_log(docs, F.col("doc_id"), "documents", F.col("doc_id"), data))
    got = try_text(F.col("data"))
    return live.select("key", text_lenient(F.col("data")).alias("lenient"), got["ok"].alias("ok"), got["value"].alias("strict"))


@register(LIVE + "SELECT table_name, key, first_seq FROM live WHERE table_name = 'users_3' AND contains(lower(data), lower('\"k\": 6')) ORDER BY first_seq LIMIT 10")
def filter_no_index_fallback(spark, d):
    return query.filter_records(_events(spark, d), "users_3", "no_such_field", '"K": 6', take=10, indexed=False).select("table_name", "key", "first_seq")


@register(LIVE + "SELECT table_name, key, first_seq FROM live WHERE false")
def filter_index_no_hit(spark, d):
    return query.filter_records(_events(spark, d), "users_3", "event_type", "no such value", indexed=True).select("table_name", "key", "first_seq")


# indexes


@register(LIVE + "SELECT table_name, key, data, seq FROM live WHERE f = 'click'")
def index_lookup_latest(spark, d):
    return index.lookup_latest(_events(spark, d), "event_type", "click").select("table_name", "key", "data", "seq")


@register(LIVE + "SELECT l.table_name, l.key, l.data, l.seq FROM live l WHERE EXISTS (SELECT 1 FROM tagged t WHERE t.table_name = l.table_name AND t.key = l.key AND t.op = 'S' AND t.seq > t.last_d AND t.f = 'click')")
def index_lookup_accumulated(spark, d):
    return index.lookup_accumulated(_events(spark, d), "event_type", "click").select("table_name", "key", "data", "seq")


@register(LIVE + "SELECT table_name, key, first_seq FROM live WHERE table_name = 'users_0' AND f = 'view' ORDER BY first_seq LIMIT 5 OFFSET 1")
def index_lookup_paged(spark, d):
    return query.filter_records(_events(spark, d), "users_0", "event_type", "view", 1, 5, indexed=True).select("table_name", "key", "first_seq")


@register(LIVE + ", mid AS (SELECT max(seq) // 2 AS m FROM log) SELECT l.table_name, l.key, l.seq FROM live l WHERE EXISTS (SELECT 1 FROM tagged t, mid WHERE t.table_name = l.table_name AND t.key = l.key AND t.op = 'S' AND t.seq > t.last_d AND t.seq > m AND t.f = 'purchase')")
def index_late_created(spark, d):
    rows = _events(spark, d)
    made = F.floor(F.max("seq") / 2).cast("long").alias("created_seq")
    catalog = rows.agg(made, F.collect_set("table_name").alias("tables")).select(F.explode("tables").alias("table_name"), F.lit("event_type").alias("field"), "created_seq")
    return index.lookup_accumulated(rows, "event_type", "purchase", catalog).select("table_name", "key", "seq")


@register("SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n_keys, min(o_orderkey::VARCHAR) AS first_key FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*), min(o_orderkey::VARCHAR) FROM orders GROUP BY ALL")
def postings_counts(spark, d):
    p = index.postings(_orders(spark, d))
    return p.select("field", "value", "key").distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("first_key"))


@register("SELECT DISTINCT 'brand' AS field, p_brand AS value, p_partkey::VARCHAR AS key FROM part")
def postings_merge(spark, d):
    p = _t(spark, d, "part")
    every = index.postings(records_log(p, F.col("p_partkey"), "part", F.col("p_partkey"), F.col("p_name"), {"brand": F.col("p_brand")})).select("field", "value", "key")
    runs = [every.filter(F.pmod(F.xxhash64("key"), F.lit(3)) == k) for k in range(3)]
    # overlapping runs: the second is there twice
    return index.merge_runs(*runs, runs[1])


@register(f"WITH {LOG} SELECT 'event_type' AS field, count(DISTINCT (f, key)) AS mappings FROM log WHERE op = 'S'")
def total_mappings(spark, d):
    return index.total_mappings(index.postings(_events(spark, d)))


def _base(spark):
    """The shared folder that the session names; a local one only where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="recordlake-")


def _order_runs(spark, d, n):
    """``n`` stored runs of the orders' index, by order date as saves would come."""
    at = f"{_base(spark)}/runs-{uuid.uuid4().hex}"
    postings = index.postings(_orders(spark, d))
    for k in range(n):
        runs.write_run(postings.filter(F.pmod("seq", F.lit(n)) == k), f"{at}/{k}", 10_000)
    return [f"{at}/{k}" for k in range(n)]


@register("SELECT o_orderkey::VARCHAR AS key, o_orderkey AS seq FROM orders WHERE o_orderpriority = '2-HIGH'")
def index_run_lookup(spark, d):
    return runs.lookup(runs.read_run(spark, *_order_runs(spark, d, 3)), "orders", "priority", "2-HIGH")


@register("SELECT o_orderkey::VARCHAR AS key, o_orderkey AS seq FROM orders WHERE false")
def index_run_miss(spark, d):
    return runs.lookup(runs.read_run(spark, *_order_runs(spark, d, 2)), "orders", "priority", "2-HIGHER")


@register("SELECT 'orders' AS table_name, 'status' AS field, o_orderstatus AS value, o_orderkey::VARCHAR AS key, o_orderkey AS seq FROM orders UNION ALL SELECT 'orders', 'priority', o_orderpriority, o_orderkey::VARCHAR, o_orderkey FROM orders")
def index_runs_merged(spark, d):
    paths = _order_runs(spark, d, 4)
    at = f"{_base(spark)}/runs-{uuid.uuid4().hex}"
    # the third run is there twice
    runs.write_run(runs.merged(*(runs.read_run(spark, p) for p in [*paths, paths[2]])), at, 40_000)
    return runs.read_run(spark, at)


@register(f"""WITH {LOG}, m AS (SELECT table_name, f AS value, key, min(seq) AS seq FROM log WHERE op = 'S' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY seq, value, key) AS r FROM m)
SELECT table_name, 'event_type' AS field, (r - 1) // 16 AS chunk, count(*) AS mappings FROM n GROUP BY ALL""")
def mappings_per_chunk(spark, d):
    chunks = index.flush_chunks(index.postings(_events(spark, d)), 16)
    return chunks.groupBy("table_name", "field", "chunk").agg(F.count(F.lit(1)).alias("mappings"))


@register(f"""WITH {LOG}, m AS (SELECT DISTINCT table_name, f AS value, key FROM log WHERE op = 'S'),
n AS (SELECT table_name, (count(*) // 8) AS n FROM m GROUP BY 1)
SELECT table_name, 'event_type' AS field, n::BIGINT AS flushes, (CASE WHEN n < 4 THEN n ELSE 1 + (n - 4) % 3 END)::BIGINT AS runs FROM n""")
def sst_compaction_runs(spark, d):
    p = index.postings(_events(spark, d)).select("table_name", "field", "value", "key").distinct()
    flushes = p.groupBy("table_name", "field").agg(F.floor(F.count(F.lit(1)) / 8).cast("long").alias("n"))
    return index.runs_left(flushes, 4)


@register("""WITH k AS (SELECT c_name AS key, row_number() OVER (ORDER BY c_name) AS n FROM customer),
e AS (SELECT key, (n - 1) * 305 AS at FROM k WHERE (n - 1) % 64 = 0)
SELECT 'customer' AS table_name, s.s_name AS key, coalesce(e.at, 0)::BIGINT AS floor FROM (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS s_name FROM supplier) s ASOF LEFT JOIN e ON s.s_name >= e.key""")
def sparse_floor(spark, d):
    c = _t(spark, d, "customer").select(F.lit("customer").alias("table_name"), F.col("c_name").alias("key"))
    span = key_range(c, "key")  # one look at the keys serves all three steps
    placed = ranked(c, ["table_name"], ["key"], span, "place")
    entries = index.sparse_entries(placed.select("table_name", "key", (F.col("place") * 305).alias("at")), ranges=span)
    probes = _t(spark, d, "supplier").select(F.lit("customer").alias("table_name"), F.expr("replace(s_name, 'Supplier', 'Customer')").alias("key")).distinct()
    return index.sparse_floor(probes, entries, span)


# catalog


@register(LIVE + "SELECT table_name, count(*) AS n_records FROM live GROUP BY 1")
def count_by_table(spark, d):
    return state.count_by_table(_events(spark, d))


@register(LIVE + "SELECT DISTINCT table_name FROM live")
def list_tables(spark, d):
    return query.list_tables(_events(spark, d))


@register(LIVE + "SELECT t AS table_name, EXISTS (SELECT 1 FROM live WHERE table_name = t) AS present FROM (VALUES ('users_0'), ('users_9')) v(t)")
def table_exists(spark, d):
    return query.table_exists(_events(spark, d), ["users_0", "users_9"])


@register(LIVE + "SELECT table_name, count(*) AS n_records, (CASE WHEN table_name = 'users_0' THEN 2 ELSE 0 END)::BIGINT AS n_indexes, CASE WHEN table_name = 'users_0' THEN 'event_type,k' ELSE '' END AS fields FROM live GROUP BY 1")
def table_info(spark, d):
    indexes = spark.createDataFrame([("users_0", "k"), ("users_0", "event_type")], "table_name string, field string")
    return query.table_info(_events(spark, d), indexes)


# writes and maintenance


@register("SELECT conv_id::VARCHAR AS key, arg_max(text, turn) AS data, max(turn) AS seq FROM conversations GROUP BY conv_id")
def upsert_latest(spark, d):
    c = _t(spark, d, "conversations")
    rows = records_log(c, F.col("turn"), "conversations", F.col("conv_id"), F.col("text"))
    return state.live(rows).select("key", "data", "seq")


@register("SELECT l_orderkey, arg_max(l_partkey, row(l_linenumber, l_partkey)) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def batch_last_wins(spark, d):
    return state.last_in_batch(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey", "l_linenumber")


@register(f"WITH {LOG}, p AS (SELECT *, lag(op) OVER (PARTITION BY table_name, key ORDER BY seq) AS before FROM log) SELECT table_name, key, seq FROM p WHERE op = 'D' AND before = 'S'")
def delete_effective(spark, d):
    return state.effective_deletes(_events(spark, d)).select("table_name", "key", "seq")


@register(LIVE + "SELECT table_name, key, seq FROM live WHERE key IN ('2', '6', '10')")
def delete_batch_distinct(spark, d):
    keys = spark.createDataFrame([(k,) for k in ("2", "6", "2", EMPTY_KEY, "10", "no such key")], "key string")
    wanted = keys.filter(F.col("key") != EMPTY_KEY).distinct()
    return state.live(_events(spark, d)).join(wanted, "key", "left_semi").select("table_name", "key", "seq")


MARKS = """marks AS (SELECT 'users_1' AS table_name, (SELECT max(event_id) // 2 FROM events) AS mark),
scoped AS (SELECT l.* FROM log l LEFT JOIN marks m ON l.table_name = m.table_name WHERE m.mark IS NULL OR l.seq > m.mark)"""


def _marked(spark, d, op):
    """The events changelog with a drop or truncate of one table in its middle."""
    rows = _events(spark, d)
    # between two rows: seqs are doubled, the mark is odd
    rows = rows.withColumn("seq", F.col("seq") * 2)
    null = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
    mark = rows.agg((F.floor(F.max("seq") / 2 / 2).cast("long") * 2 + 1).alias("seq")).select("seq", F.lit(op).alias("op"), F.lit("users_1").alias("table_name"), null("key"), null("data"), null("indexed_fields"))
    return rows.unionByName(mark)


@register(f"WITH {LOG}, {MARKS} SELECT table_name, key, arg_max(data, seq) AS data, 2 * max(seq) AS seq FROM scoped GROUP BY 1, 2 HAVING arg_max(op, seq) = 'S'")
def drop_table_state(spark, d):
    rows = _marked(spark, d, "X")
    return state.live(state.with_marks(rows, state.effective_marks(rows))).select("table_name", "key", "data", "seq")


@register(f"WITH {LOG}, {MARKS} SELECT table_name, count(*) AS n_records FROM (SELECT table_name, key FROM scoped GROUP BY 1, 2 HAVING arg_max(op, seq) = 'S') GROUP BY 1")
def truncate_then_write(spark, d):
    rows = _marked(spark, d, "T")
    return state.count_by_table(state.with_marks(rows, state.effective_marks(rows)))


@register(LIVE + "SELECT count(*) AS affected FROM live WHERE table_name = 'users_1'")
def drop_affected(spark, d):
    return state.affected(_events(spark, d), "users_1")


REMOVED = f"WITH {LOG}, p AS (SELECT *, lag(op) OVER (PARTITION BY table_name, key ORDER BY seq) AS before FROM log) SELECT count(*) AS removed FROM p WHERE op = 'D' AND before = 'S'"


@register(REMOVED)
def compact_removed(spark, d):
    return state.removed_count(_events(spark, d))


@register(LIVE + "SELECT table_name, key, op, data, seq FROM live")
def compact_live(spark, d):
    return state.compacted(_events(spark, d)).select("table_name", "key", "op", "data", "seq")


@register(LIVE + "SELECT table_name, op, count(*) AS n FROM (SELECT table_name, op, seq FROM live WHERE table_name IN ('users_0', 'users_2') UNION ALL SELECT table_name, op, seq FROM log WHERE table_name NOT IN ('users_0', 'users_2')) GROUP BY ALL")
def compact_scoped(spark, d):
    return state.compacted(_events(spark, d), ["users_0", "users_2"]).groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("n"))


# the log


@register(f"WITH {LOG} SELECT seq, coalesce(sum(octet_length(encode(data))) OVER w, 0)::BIGINT AS data_offset, (4096 + 305 * (row_number() OVER (ORDER BY seq) - 1))::BIGINT AS index_offset FROM log WHERE op = 'S' WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def wal_offsets_versions(spark, d):
    return log.plan_offsets(_events(spark, d).filter("op = 'S'")).select("seq", "data_offset", "index_offset")


@register(f"WITH {LOG} SELECT sum(octet_length(encode(data)))::BIGINT AS data_end FROM log WHERE op = 'S'")
def data_end(spark, d):
    return log.data_end(_events(spark, d).filter("op = 'S'"))


@register(f"WITH {LOG} SELECT seq, op, key FROM log WHERE seq < coalesce((SELECT min(seq) FROM log WHERE seq % 997 = 996), 9223372036854775807)")
def wal_valid_prefix(spark, d):
    return log.valid_prefix(_events(spark, d), F.col("seq") % 997 == 996).select("seq", "op", "key")


@register(f"""WITH {LOG}, o AS (SELECT seq, seq // 10 AS commit_id, data, coalesce(sum(octet_length(encode(data))) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM log WHERE op = 'S')
SELECT commit_id, count(*) AS rows, bool_and(data_offset + CASE WHEN seq % 101 = 7 THEN 1 ELSE 0 END = data_offset) AS accepted FROM o GROUP BY 1""")
def wal_plan_check(spark, d):
    planned = log.plan_offsets(_events(spark, d).filter("op = 'S'"))
    gap = F.when(F.col("seq") % 101 == 7, 1).otherwise(0)
    return log.check_plans(planned.withColumn("commit_id", F.floor(F.col("seq") / 10)).withColumn("planned_offset", F.col("data_offset") + gap))


@register("SELECT commit_id, ((row_number() OVER (ORDER BY commit_id) - 1) // 50)::BIGINT AS epoch FROM (SELECT DISTINCT event_id // 10 AS commit_id FROM events WHERE event_type <> 'error')")
def checkpoint_epochs(spark, d):
    return log.checkpoint_epochs(_events(spark, d).filter("op = 'S'").withColumn("commit_id", F.floor(F.col("seq") / 10)), 50)


@register(f"WITH {LOG}, s AS (SELECT table_name, key, max(seq) % 5 AS slot FROM log WHERE op = 'S' GROUP BY 1, 2), d AS (SELECT table_name, key, seq FROM log WHERE op = 'D') SELECT d.table_name, d.key, d.seq FROM d JOIN s USING (table_name, key) WHERE slot = d.seq % 5")
def delete_targets(spark, d):
    rows = _events(spark, d)
    slots = rows.filter("op = 'S'").groupBy("table_name", "key").agg((F.max("seq") % 5).alias("index_offset"))
    deletes = rows.filter("op = 'D'").withColumn("index_offset", F.col("seq") % 5)
    return log.delete_targets(deletes, slots).select("table_name", "key", "seq")


@register("""SELECT event_id, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(props))), lambda i: ('0x' || substr(hex(encode(props)), 2 * i + 1, 2))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))
  ), 4294967295::BIGINT) AS crc FROM events""")
def crc32_payload(spark, d):
    return _t(spark, d, "events").select("event_id", crc(F.col("props")).alias("crc"))


@register("SELECT event_id, md5(concat_ws('|', user_id, event_type))::UUID::VARCHAR AS key FROM events")
def key_from_columns(spark, d):
    return _t(spark, d, "events").select("event_id", key_of(F.col("user_id"), F.col("event_type")).alias("key"))


@register(LIVE + "SELECT table_name, key, data, seq FROM live")
def stream_replay(spark, d):
    base = _base(spark)
    run = uuid.uuid4().hex
    rows = _events(spark, d)
    # three files, so three batches, that do not follow the order of the log
    rows.repartition(3, "key").write.parquet(f"{base}/changes-{run}")
    changes = read_changes(spark, f"{base}/changes-{run}", rows.schema)
    return replay(changes, f"{base}/state-{run}", f"{base}/replay-{run}").select("table_name", "key", "data", "seq")


# the persistent store, end to end


def _store(spark, **options):
    """A new store in the shared folder. What these queries return reads its files, so it stays."""
    return RecordStore(spark, f"{_base(spark)}/store-{uuid.uuid4().hex}", Options(**options) if options else None)


def _customers(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", key_of(F.lit("c"), F.col("c_custkey")).alias("key"))


def _save(store, table, df, order="c_custkey", data="c_name", fields=None):
    return store.open_table(table).save_frame(df, F.col("key"), F.col(data), order, fields)


KEYED = "keyed AS (SELECT *, md5(concat_ws('|', 'c', c_custkey))::UUID::VARCHAR AS key FROM customer)"


@register(f"WITH {KEYED} SELECT key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS data FROM keyed WHERE c_custkey % 10 <> 7")
def store_batches(spark, d):
    """Batches that insert, replace and delete; closed, opened again and scanned."""
    c = _customers(spark, d)
    with _store(spark) as s:
        assert _save(s, "customer", c) == c.count()
        _save(s, "customer", c.filter("c_custkey % 3 = 0"), data="c_mktsegment")
        gone = c.filter("c_custkey % 10 = 7").select("key")
        s.open_table("customer").delete_frame(gone, F.col("key"))
        s.checkpoint()
    again = RecordStore(spark, s.path)
    return again.open_table("customer").filter().select("key", text_lenient(F.col("data")).alias("data"))


@register(f"WITH {KEYED} SELECT key, c_name || ' again' AS data, 2::BIGINT AS times FROM keyed WHERE c_custkey IN (1, 2) UNION ALL SELECT key, NULL, 0 FROM keyed WHERE c_custkey IN (3, 4)")
def store_single_saves(spark, d):
    """Every way to save one record, replaced and deleted, read by point lookup."""
    rows = {r.c_custkey: r for r in _customers(spark, d).filter("c_custkey BETWEEN 1 AND 4").collect()}
    with _store(spark) as s:
        t = s.open_table("customer")
        for suffix in ("", " again"):
            t.save(rows[1].key, rows[1].c_name + suffix)
            t.save(rows[2].key, rows[2], data_selector=lambda r, suffix=suffix: (r.c_name + suffix).encode())
        t.save_batch([rows[3], rows[4]], lambda r: r.key, lambda r: r.c_name)
        t.delete(rows[3].key)
        t.delete_batch([rows[4]], lambda r: r.key)
        found = [(r.key, t.get(r.key)) for r in rows.values()]
        log = {r.key: r.n for r in s.changelog().filter("op = 'S'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    return spark.createDataFrame([(k, bytes(r.data).decode() if r else None, log[k] if r else 0) for k, r in found], "key string, data string, times long")


@register(f"WITH {KEYED} SELECT key, c_name AS data FROM keyed WHERE c_mktsegment = 'BUILDING' AND c_custkey % 5 <> 1")
def store_index_filter(spark, d):
    """Records by a stored index: several runs, merged, and rows that have left the value."""
    c = _customers(spark, d)
    s = _store(spark, index_flush=10, index_merge=3)
    s.open_table("customer").ensure_index("segment")
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    for k in range(4):
        _save(s, "customer", c.filter(f"c_custkey % 4 = {k}"), fields=fields)
    _save(s, "customer", c.filter("c_custkey % 5 = 1"), fields=F.create_map(F.lit("segment"), F.lit("moved")))
    return s.open_table("customer").filter("segment", "BUILDING").select("key", text_lenient(F.col("data")).alias("data"))


@register("SELECT 'customer' AS table_name, count(*) AS n_records, 0::BIGINT AS n_indexes FROM customer WHERE c_nationkey < 12 UNION ALL SELECT 'kept', count(*), 1 FROM customer")
def store_catalog(spark, d):
    """Tables dropped and truncated, with their indexes; what is written after."""
    c = _customers(spark, d)
    with _store(spark) as s:
        for name in ("customer", "kept", "dropped"):
            _save(s, name, c)
            s.open_table(name).ensure_index("segment")
            s.open_table(name).ensure_index("name")
        s.open_table("kept").drop_index("name")
        assert s.drop_table("dropped") == s.open_table("customer").truncate() == c.count()
        _save(s, "customer", c.filter("c_nationkey < 12"))
        infos = [s.open_table(t).info() for t in s.list_tables()]
        rows = [(i["table_name"], i["record_count"], len(i["indexes"])) for i in infos]
    return spark.createDataFrame(rows, "table_name string, n_records long, n_indexes long")


@register(f"WITH {KEYED} SELECT key, c_name AS data, (SELECT count(*) FROM keyed WHERE c_custkey % 4 = 1) AS removed, (SELECT count(*) FROM keyed WHERE c_custkey % 4 <> 1) AS log_rows FROM keyed WHERE c_custkey % 4 <> 1")
def store_compacted(spark, d):
    """Compaction: what it returns, what it keeps, and that nothing comes back after opening again."""
    c = _customers(spark, d)
    with _store(spark, file_bytes=20_000) as s:
        _save(s, "customer", c, data="c_mktsegment")
        _save(s, "customer", c)
        s.open_table("customer").delete_frame(c.filter("c_custkey % 4 = 1"), F.col("key"))
        removed = s.compact()
    again = RecordStore(spark, s.path)
    size = again.changelog().count()
    found = again.open_table("customer").filter().select("key", text_lenient(F.col("data")).alias("data"))
    return found.withColumn("removed", F.lit(removed).cast("long")).withColumn("log_rows", F.lit(size).cast("long"))


@register(f"WITH {KEYED} SELECT key, c_name AS data FROM keyed WHERE c_mktsegment = 'MACHINERY'")
def store_stream(spark, d):
    """The pull stream over a snapshot: later writes do not show."""
    c = _customers(spark, d)
    with _store(spark) as s:
        _save(s, "customer", c)
        t = s.open_table("customer")
        rows = t.stream("customer#")
        first = next(rows)
        t.truncate()
        wanted = {r.key for r in c.filter("c_mktsegment = 'MACHINERY'").select("key").collect()}
        found = [(r.key, bytes(r.data).decode()) for r in [first, *rows] if r.key in wanted]
    return spark.createDataFrame(found, "key string, data string")


@register(f"WITH {KEYED} SELECT key, c_name AS data FROM keyed WHERE c_custkey % 3 = 0")
def store_damaged_log(spark, d):
    """A commit whose rows no longer have their checksums ends the log before it."""
    c = _customers(spark, d)
    with _store(spark) as s:
        for k in range(3):
            _save(s, "customer", c.filter(f"c_custkey % 3 = {k}"))
        bad = f"{s.path}/{s._current.commits[1]['name']}"
    rows = spark.read.parquet(bad)
    rows.withColumn("crc", F.col("crc") + 1).write.parquet(f"{bad}.damaged")
    spark.read.schema(rows.schema).parquet(f"{bad}.damaged").write.mode("overwrite").parquet(bad)
    return RecordStore(spark, s.path).open_table("customer").filter().select("key", text_lenient(F.col("data")).alias("data"))


@register(f"""WITH {LOG}, {MARKS}, tagged AS (SELECT *, coalesce(max(CASE WHEN op = 'D' THEN seq END) OVER (PARTITION BY table_name, key), -1) AS last_d FROM scoped), {STATE}
SELECT table_name, key, data, seq, first_seq FROM state WHERE op = 'S' AND contains(lower(data), lower('"K": 6')) ORDER BY first_seq LIMIT 10 OFFSET 2""")
def flagship(spark, d):
    """Latest, live, content filter and page over a log in which one table has been truncated."""
    rows = _events(spark, d)
    mark = rows.agg(F.floor(F.max("seq") / 2).cast("long").alias("mark")).select(F.lit("users_1").alias("table_name"), "mark")
    found = state.live_paged(state.with_marks(rows, mark)).filter(content_match(F.col("data"), "contains", '"K": 6'))
    return query.page(found, "first_seq", 2, 10).select("table_name", "key", "data", "seq", "first_seq")

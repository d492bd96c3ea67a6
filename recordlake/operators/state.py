"""From the changelog to its current state.

A changelog row is ``seq, op, table_name, key, data, indexed_fields`` with op S (save), D (delete),
X (drop) or T (truncate); X and T have no key. The state of a key is its row with the greatest ``seq``
after its table's last effective X or T; it is live if that row is a save. ``max_by`` over a struct has
map-side partial aggregation, so a hot key costs one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.operators.ranges import upper_bound

SAVE, DELETE, DROP, TRUNCATE = "S", "D", "X", "T"
KEY = ["table_name", "key"]


def with_marks(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows after the mark (``table_name, mark``) of their table. One row a table: Spark broadcasts it if it is small."""
    m = marks.select(F.col("table_name").alias("__t"), "mark")
    return log.join(m, log.table_name == F.col("__t"), "left").filter("mark IS NULL OR seq > mark").drop("__t", "mark")


def effective_marks(log: DataFrame) -> DataFrame:
    """``table_name, mark``: the last drop or truncate of each table that had a live key just before.

    The mark of a table without live keys does nothing, whatever marks stand around it. The marks of a table are one
    sorted array, in which a row finds the next one by binary search, so no row is paired with all of them.
    """
    wipes = log.filter(F.col("op").isin(DROP, TRUNCATE)).groupBy("table_name").agg(F.sort_array(F.collect_list("seq")).alias("wipes"))
    rows = log.filter("key IS NOT NULL").select("table_name", "key", "seq", "op").join(wipes, "table_name")
    # the interval of marks that a keyed row falls into, and what the last row of each key in it says
    inside = rows.withColumn("wipe", F.get("wipes", upper_bound(F.col("wipes"), F.col("seq")))).filter("wipe IS NOT NULL")
    last = inside.groupBy("table_name", "wipe", "key").agg(F.max_by("op", "seq").alias("op"))
    # keys live in an interval: those that its marks kill; an ineffective mark kills nothing, and nothing was live before it
    return last.filter(F.col("op") == SAVE).groupBy("table_name").agg(F.max("wipe").alias("mark"))


def last_deletes(log: DataFrame) -> DataFrame:
    """Each row with ``last_d``, the greatest delete of its key, or -1. A join, so that a key with most rows can be split."""
    last = log.filter(F.col("op") == DELETE).groupBy(*KEY).agg(F.max("seq").alias("last_d"))
    return log.join(last, KEY, "left").withColumn("last_d", F.coalesce("last_d", F.lit(-1)))


def latest(log: DataFrame, *extra: str) -> DataFrame:
    """One row for each key: the columns of its last row."""
    columns = [c for c in ("seq", "op", "data", *extra) if c in log.columns]
    found = log.filter("key IS NOT NULL").groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("s"))
    return found.select(*KEY, *(F.col(f"s.{c}").alias(c) for c in columns))


def live(log: DataFrame, *extra: str) -> DataFrame:
    return latest(log, *extra).filter(F.col("op") == SAVE)


def live_paged(log: DataFrame, *extra: str) -> DataFrame:
    """Live rows with ``first_seq``, the first save after the last delete: the paging order.

    Two aggregations on one partitioning instead of a window, which would sort every version of a key.
    """
    columns = [c for c in ("seq", "op", "data", *extra) if c in log.columns]
    rows = log.filter("key IS NOT NULL")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("s"), F.max(F.when(F.col("op") == DELETE, F.col("seq"))).alias("last_d"))
    alive = last.filter(F.col("s.op") == SAVE)
    first = rows.filter(F.col("op") == SAVE).join(alive.select(*KEY, "last_d"), KEY).filter("last_d IS NULL OR seq > last_d")
    first = first.groupBy(*KEY).agg(F.min("seq").alias("first_seq"))
    return alive.join(first, KEY).select(*KEY, *(F.col(f"s.{c}").alias(c) for c in columns), "first_seq")


def effective_deletes(log: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Deletes that met a live key.

    In ranges of ``width`` seqs, so that the versions of one key never meet in one window; the first row of a key in a range
    looks at the last one of the range before.
    """
    rows = log.filter("key IS NOT NULL").withColumn("__range", F.floor(F.col("seq") / width))
    w = Window.partitionBy(*KEY, "__range").orderBy("seq")
    tagged = rows.withColumn("__before", F.lag("op").over(w)).filter(F.col("op") == DELETE)
    last = rows.groupBy(*KEY, "__range").agg(F.max_by("op", "seq").alias("__op"))
    ranges = Window.partitionBy(*KEY).orderBy("__range")
    last = last.withColumn("__op", F.lag("__op").over(ranges)).filter(F.col("__op") == SAVE).drop("__op")
    first = tagged.filter("__before IS NULL").join(last, [*KEY, "__range"], "left_semi")
    return tagged.filter(F.col("__before") == SAVE).unionByName(first.select(*tagged.columns)).drop("__before", "__range").select(*log.columns)


def count_by_table(log: DataFrame) -> DataFrame:
    return live(log).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_records"))


def affected(log: DataFrame, table: str) -> DataFrame:
    """What a drop or truncate of ``table`` would return: its live rows."""
    return live(log.filter(F.col("table_name") == table)).agg(F.count(F.lit(1)).alias("affected"))


def in_scope(df: DataFrame, tables: list[str] | None) -> DataFrame:
    return df.filter(F.col("table_name").isin(*tables)) if tables else df


def removed_count(log: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """What compaction returns: deleted rows in scope; overwritten ones do not count."""
    return in_scope(effective_deletes(log), tables).agg(F.count(F.lit(1)).alias("removed"))


def compacted(log: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """The changelog after compaction: last live rows in scope, everything out of scope."""
    columns = [c for c in log.columns if c not in KEY]
    last = in_scope(log, tables).filter("key IS NOT NULL").groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("s"))
    kept = last.filter(F.col("s.op") == SAVE).select(*KEY, *(F.col(f"s.{c}").alias(c) for c in columns)).select(*log.columns)
    return kept.unionByName(log.filter(~F.col("table_name").isin(*tables))) if tables else kept


def last_in_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last by ``order``; a batch without an order is refused."""
    if not order:
        raise ValueError("A batch needs an order: the last of equal keys wins.")
    rest = [c for c in batch.columns if c not in keys]
    found = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return found.select(*keys, *(F.col(f"s.{c}").alias(c) for c in rest))

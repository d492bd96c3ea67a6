"""Reads on a changelog: point, multi-key, paged, filtered; and the router between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions import checks
from recordlake.functions.text import content_match
from recordlake.operators.index import lookup_accumulated
from recordlake.operators.state import latest, live, live_paged, SAVE

#: so many keys of 36 characters are a few MB
BROADCAST_KEYS = 50_000


def page(df: DataFrame, order: str, skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` by ``order``, which must be unique."""
    checks.paging(skip, take)
    out = df.orderBy(order).offset(skip)
    return out if take is None else out.limit(take)


def get(log: DataFrame, table: str, key: str) -> DataFrame:
    """The live row of a key, or none. The key reaches the scan."""
    return latest(log.filter((F.col("table_name") == table) & (F.col("key") == key))).filter(F.col("op") == SAVE)


def multi_get(log: DataFrame, table: str, keys: Sequence[str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Live rows in the order of ``keys``, as often as a key is asked for; missing keys do not count for paging."""
    spark = log.sparkSession
    wanted = spark.createDataFrame(list(enumerate(keys)), "pos long, key string")
    # only the rows of the caller's keys are aggregated; few keys are broadcast, many are joined by a shuffle
    hint = F.broadcast if len(keys) <= BROADCAST_KEYS else (lambda df: df)
    rows = log.filter(F.col("table_name") == table).join(hint(wanted.select("key").distinct()), "key", "left_semi")
    found = live(rows).join(hint(wanted), "key")
    return page(found.select("pos", "table_name", "key", "data", "seq"), "pos", skip, take)


def filter_records(log: DataFrame, table: str, field: str | None = None, value: str | None = None, skip: int = 0, take: int | None = None, indexed: bool | None = None, indexes: DataFrame | None = None, ignore_case: bool = True, lookup: str = "latest") -> DataFrame:
    """Records of a table by field and value.

    In this order: negative paging is an error; nothing to take is no rows; a field without a value is an
    error; a field with an index is an exact match on it (no rows if it has none, no fallback); no value is
    a page of all; else the value is looked for in the text, whatever the field.
    """
    checks.paging(skip, take)
    rows = log.filter(F.col("table_name") == table)
    if take == 0:
        return live_paged(rows, "indexed_fields").limit(0)
    if field and not value:
        raise ValueError("A field needs a value.")
    if field and value and indexed:
        if lookup == "accumulated":
            keys = lookup_accumulated(rows, field, value, indexes).select("key")
            return page(live_paged(rows, "indexed_fields").join(keys, "key", "left_semi"), "first_seq", skip, take)
        return page(live_paged(rows, "indexed_fields").filter(F.col("indexed_fields")[field] == value), "first_seq", skip, take)
    found = live_paged(rows, "indexed_fields")
    if value:
        found = found.filter(content_match(F.col("data"), "contains", value, ignore_case))
    return page(found, "first_seq", skip, take)


def list_tables(log: DataFrame) -> DataFrame:
    return live(log).select("table_name").distinct()


def table_exists(log: DataFrame, tables: Sequence[str]) -> DataFrame:
    """``table_name, present`` for each name: a table is there while it has a live row."""
    asked = log.sparkSession.createDataFrame([(t,) for t in tables], "table_name string")
    there = list_tables(log.filter(F.col("table_name").isin(*tables))).withColumn("there", F.lit(True))
    return asked.join(there, "table_name", "left").select("table_name", F.coalesce("there", F.lit(False)).alias("present"))


def table_info(log: DataFrame, indexes: DataFrame) -> DataFrame:
    """``table_name, n_records, n_indexes, fields`` of tables with live rows."""
    counts = live(log).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_records"))
    defined = indexes.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_indexes"), F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))
    return counts.join(defined, "table_name", "left").select("table_name", "n_records", F.coalesce("n_indexes", F.lit(0)).alias("n_indexes"), F.coalesce("fields", F.lit("")).alias("fields"))

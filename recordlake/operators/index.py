"""Equality indexes derived from the changelog, and the lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.operators.ranges import carried, key_range, ranked
from recordlake.operators.state import KEY, SAVE, last_deletes, live

SPARSE_STEP = 64
#: seqs that meet in one window
RANGE = 1_000_000


def postings(log: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
    """``table_name, field, value, key, seq`` of saved fields; with ``indexes`` only those declared before the save.

    ``indexes``: ``table_name, field, created_seq``. There is no backfill.
    """
    p = log.filter(F.col("op") == SAVE).select("table_name", "key", "seq", F.explode("indexed_fields").alias("field", "value"))
    if indexes is None:
        return p
    i = indexes.select(F.col("table_name").alias("__t"), F.col("field").alias("__f"), "created_seq")
    hit = (p.table_name == F.col("__t")) & (p.field == F.col("__f")) & (p.seq > F.col("created_seq"))
    return p.join(i, hit, "left_semi")


def lookup_latest(log: DataFrame, field: str, value: str) -> DataFrame:
    """Live rows whose last version has the value."""
    return live(log, "indexed_fields").filter(F.col("indexed_fields")[field] == value)


def lookup_accumulated(log: DataFrame, field: str, value: str, indexes: DataFrame | None = None) -> DataFrame:
    """Live rows of which any version since their last delete had the value."""
    tagged = last_deletes(log.filter("key IS NOT NULL"))
    hits = postings(tagged.filter("seq > last_d"), indexes).filter((F.col("field") == field) & (F.col("value") == value))
    return live(log, "indexed_fields").join(hits.select(*KEY).distinct(), KEY, "left_semi")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Runs of ``field, value, key`` as one: each mapping once. A row a mapping: a value may have most of the keys."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.select("field", "value", "key").distinct()


def total_mappings(p: DataFrame) -> DataFrame:
    """Different (value, key) pairs."""
    return p.select("field", "value", "key").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("mappings"))


def flush_chunks(p: DataFrame, threshold: int) -> DataFrame:
    """Different mappings with the number of the flush that takes them, in order of first appearance, by table and field."""
    first = p.groupBy("table_name", "field", "value", "key").agg(F.min("seq").alias("seq"))
    found = ranked(first, ["table_name", "field"], ["seq", "value", "key"], F.floor(F.col("seq") / RANGE), "place")
    return found.withColumn("chunk", F.floor(F.col("place") / threshold).cast("long")).drop("place")


def runs_left(flushes: DataFrame, trigger: int) -> DataFrame:
    """Runs left of ``n`` flushes (``table_name, field, n``) when ``trigger`` runs merge to one."""
    n, t = F.col("n"), F.lit(trigger)
    # after the first merge each further trigger - 1 flushes merge again
    left = F.when(n < t, n).otherwise(1 + F.pmod(n - t, t - 1))
    return flushes.select("table_name", "field", n.alias("flushes"), left.cast("long").alias("runs"))


def sparse_entries(sorted_keys: DataFrame, step: int = SPARSE_STEP, ranges: Column | None = None) -> DataFrame:
    """Every ``step``-th of (``table_name, key, at``), by key, from the first on; ``ranges``: the key's, if already known."""
    found = ranked(sorted_keys, ["table_name"], ["key"], key_range(sorted_keys, "key") if ranges is None else ranges, "place")
    return found.filter(F.col("place") % step == 0).drop("place")


def sparse_floor(probes: DataFrame, entries: DataFrame, ranges: Column | None = None) -> DataFrame:
    """As-of: for each probe (``table_name, key``) the ``at`` of the greatest entry not over it, else 0.

    Probes and entries are merged and carried forward, so nothing is paired with anything.
    """
    both = probes.select("table_name", "key", F.lit(None).cast("long").alias("at"), F.lit(1).alias("probe")).unionByName(
        entries.select("table_name", "key", F.col("at").cast("long").alias("at"), F.lit(0).alias("probe")))
    found = carried(both, ["table_name"], ["key", "probe"], key_range(both, "key") if ranges is None else ranges, "at", "floor")
    return found.filter("probe = 1").select("table_name", "key", F.coalesce("floor", F.lit(0)).alias("floor"))

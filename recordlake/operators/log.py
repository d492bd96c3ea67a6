"""Computations on the log itself: offsets, validity, plans, checkpoints.

Running sums over the whole log have no key to partition by. They are made in two steps: sums by range of
``seq``, prefix sums over the few ranges, then running sums inside each range; only one row a range meets in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, SLOT = 4096, 305


def running_before(df: DataFrame, order: str, values: dict[str, Column], width: int = 1_000_000) -> DataFrame:
    """``df`` with, for each name, the sum of its value over all rows with a smaller ``order`` (unique)."""
    df = df.withColumn("__range", F.floor(F.col(order) / width))
    for name, value in values.items():
        df = df.withColumn(f"__{name}", value.cast("long"))
    sums = df.groupBy("__range").agg(*(F.sum(f"__{n}").alias(f"__sum_{n}") for n in values))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__range", *(F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in values))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(bases, "__range")
    for n in values:
        out = out.withColumn(n, F.col(f"__base_{n}") + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)))
    return out.drop("__range", *(f"__{n}" for n in values), *(f"__base_{n}" for n in values))


def plan_offsets(saves: DataFrame) -> DataFrame:
    """``data_offset`` (bytes of all earlier payloads; the version) and ``index_offset`` (header plus slots) of each save."""
    size = F.octet_length("data")
    out = running_before(saves, "seq", {"data_offset": size, "slot": F.lit(1)})
    return out.withColumn("version", F.col("data_offset")).withColumn("index_offset", HEADER + SLOT * F.col("slot")).drop("slot")


def data_end(saves: DataFrame) -> DataFrame:
    """``data_end``: where the next payload goes, after the one that ends last; 0 without any."""
    ends = plan_offsets(saves).select((F.col("data_offset") + F.octet_length("data")).alias("at"))
    return ends.agg(F.coalesce(F.max("at"), F.lit(0)).cast("long").alias("data_end"))


def valid_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Rows before the first bad one: everything after it is gone with it."""
    first = log.filter(bad).agg(F.min("seq").alias("first_bad"))
    return log.join(F.broadcast(first), (F.col("first_bad").isNull()) | (F.col("seq") < F.col("first_bad")), "left_semi")


def check_plans(planned: DataFrame) -> DataFrame:
    """``commit_id, rows, accepted``: a commit stands if all its rows are where the log says they must be."""
    fits = (F.col("planned_offset") == F.col("data_offset")) & (F.octet_length("data") > 0) & F.col("table_name").isNotNull()
    return planned.groupBy("commit_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(fits).alias("accepted"))


def checkpoint_epochs(commits: DataFrame, interval: int) -> DataFrame:
    """``commit_id, epoch``: a commit is one tracked write, however many rows it has."""
    every = commits.select("commit_id").distinct()
    ranked = running_before(every, "commit_id", {"before": F.lit(1)})
    return ranked.select("commit_id", F.floor(F.col("before") / interval).cast("long").alias("epoch"))


def delete_targets(deletes: DataFrame, slots: DataFrame) -> DataFrame:
    """Logged deletes whose slot still holds their key."""
    return deletes.join(slots.select("table_name", "key", "index_offset"), ["table_name", "key", "index_offset"], "left_semi")

"""Order without a window over everything: ranks and carried values in two steps, by ranges of the order.

A range's sums meet in one small window, the rows of a range in another; no task sees more than one range of one
group.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_bound(values: Column, probe: Column) -> Column:
    """How many elements of a sorted array are at most ``probe``, by binary search."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.get(values, middle) <= probe
        going = s["lo"] < s["hi"]
        return F.struct(F.when(going & low, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(going & ~low, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step, lambda s: s["lo"])


def key_range(df: DataFrame, key: str, rows: int = 1_000_000, most: int = 256) -> Column:
    """The number of a key's range, which never falls as the key rises; even ranges of about ``rows`` rows, ``most`` at most.

    The driver holds the least and the greatest key and at most ``most`` quantiles, of the seven bytes after the prefix
    that all keys have.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    ranges = min(most, -(-n // rows))
    if ranges <= 1:
        return F.lit(0)
    shared = len(os.path.commonprefix([low.encode(), high.encode()]))
    digits = F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), shared + 1, 7)), 14, "0")
    number = F.conv(digits, 16, 10).cast("long")
    cuts = df.select(number.alias("n")).approxQuantile("n", [i / ranges for i in range(1, ranges)], 0.001)
    cuts = sorted({math.floor(c) for c in cuts})
    return upper_bound(F.array(*map(F.lit, cuts)), number) if cuts else F.lit(0)


def ranked(df: DataFrame, by: list[str], order: list[str], at: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the rank from 0 in the group ``by``; ``at``: a range number that never falls as ``order`` rises."""
    d = df.withColumn("__range", at)
    sizes = d.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order)
    out = d.withColumn("__at", F.row_number().over(inside) - 1).join(bases, [*by, "__range"])
    return out.withColumn(name, F.col("__base") + F.col("__at")).drop("__range", "__n", "__base", "__at")


def carried(df: DataFrame, by: list[str], order: list[str], at: Column, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the last ``value`` that is not null up to and with the row, in the group ``by``."""
    d = df.withColumn("__range", at)
    tail = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__tail")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = d.groupBy(*by, "__range").agg(tail).select(*by, "__range", F.last("__tail", ignorenulls=True).over(before).alias("__base"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn("__at", F.last(value, ignorenulls=True).over(inside)).join(bases, [*by, "__range"])
    return out.withColumn(name, F.coalesce("__at", "__base")).drop("__range", "__base", "__at")

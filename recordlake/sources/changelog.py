"""The changelog's schema, and changelogs made from plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGELOG = T.StructType([
    T.StructField("commit_id", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("table_name", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("data", T.BinaryType()), T.StructField("indexed_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("crc", T.LongType()), T.StructField("expires_at", T.LongType()),
])


def records_log(df: DataFrame, seq: Column, table: str, key: Column, data: Column, fields: dict[str, Column] | None = None) -> DataFrame:
    """A changelog with one save for each row."""
    pairs = [x for name, value in (fields or {}).items() for x in (F.lit(name), value.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(seq.cast("long").alias("seq"), F.lit("S").alias("op"), F.lit(table).alias("table_name"), key.cast("string").alias("key"), data.alias("data"), made.alias("indexed_fields"))


def events_log(events: DataFrame) -> DataFrame:
    """The events table as a changelog: users are keys, errors delete."""
    return events.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("S").alias("op"),
        F.concat(F.lit("users_"), (F.col("user_id") % 4).cast("string")).alias("table_name"), F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("data"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("indexed_fields"),
    )


def key_of(*parts: Column) -> Column:
    """A key in canonical form from the MD5 of its parts, for sources without one."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

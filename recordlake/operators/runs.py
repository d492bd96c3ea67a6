"""Stored secondary indexes: sorted runs of postings, as Parquet.

A run holds ``table_name, field, value, key, seq``, each mapping once with its last ``seq``, in the order of
table, field, value (by its UTF-8 bytes) and key. A file's footer has the least and the greatest value of each row group
and page, which is the sparse index, and a Bloom filter of the values; so an equality lookup reads the few pages that can
hold the value, or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["table_name", "field", "value", "key"]
RUN = "table_name string, field string, value string, key string, seq long"
#: mappings a file, so that a run of any size is written by tasks of one size
FILE_ROWS = 4_000_000


def mappings(postings: DataFrame) -> DataFrame:
    """Each (table, field, value, key) once, with its last ``seq``."""
    return postings.groupBy(*ORDER).agg(F.max("seq").alias("seq")).select(*ORDER, "seq")


def write_run(postings: DataFrame, path: str, rows: int) -> None:
    """A sorted run of about ``rows`` mappings at ``path``."""
    files = max(1, -(-rows // FILE_ROWS))
    found = mappings(postings).repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
    found.write.option("parquet.bloom.filter.enabled#value", "true").option("parquet.bloom.filter.expected.ndv#value", str(min(rows + 1, FILE_ROWS))).parquet(path)


def read_run(spark: SparkSession, *paths: str) -> DataFrame:
    """The mappings of runs, each in its order."""
    return spark.read.schema(RUN).parquet(*paths) if paths else spark.createDataFrame([], RUN)


def lookup(run: DataFrame, table: str, field: str, value: str) -> DataFrame:
    """``key, seq`` of a value; the three equalities reach the scan."""
    return run.filter((F.col("table_name") == table) & (F.col("field") == field) & (F.col("value") == value)).select("key", "seq")


def merged(*runs: DataFrame) -> DataFrame:
    """Several runs as the rows of one."""
    return mappings(reduce(DataFrame.unionByName, runs))

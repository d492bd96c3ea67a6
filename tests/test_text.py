from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from recordlake.functions import checks
from recordlake.functions.text import content_match, crc, text_lenient, try_text


@pytest.mark.parametrize(
    ("operator", "value", "ignore_case", "want"),
    [("contains", "LIC", True, "a"), ("contains", "LIC", False, ""), ("equals", "alice", True, "a"), ("less", "bob", True, "a"), ("greater", "Alice", False, "b"), ("contains", "(", True, "")],
)
def test_content(spark, operator, value, ignore_case, want):
    rows = [("a", bytearray(b"Alice")), ("b", bytearray(b"bob")), ("bad", bytearray(b"\xc3\x28")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, data binary")
    got = df.withColumn("m", content_match(F.col("data"), operator, value, ignore_case))
    assert not got.filter("m IS NULL").count()
    assert "".join(r.k for r in got.filter("m").collect()) == want


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        content_match(F.col("x"), "like", "a")


def test_decoding_and_checksum(spark):
    df = spark.createDataFrame([(bytearray(b"\xc3\x28"),), (bytearray("é".encode()),)], "data binary")
    got = df.select(text_lenient(F.col("data")).alias("l"), try_text(F.col("data")).alias("t"), crc(F.col("data")).alias("c")).collect()
    assert [(r.l, r.t.ok, r.t.value, r.c) for r in got] == [("�(", False, "", zlib.crc32(b"\xc3\x28")), ("é", True, "é", zlib.crc32("é".encode()))]


@pytest.mark.parametrize("name", ["", "  ", "a\x01b", "x" * 256, "é" * 128, None])
def test_bad_table_names(name):
    with pytest.raises(ValueError):
        checks.table_name(name)


def test_good_names_and_payloads():
    assert checks.table_name("é" * 127) == "é" * 127
    assert checks.payload("é") == "é".encode()
    for bad in (None, "", b""):
        with pytest.raises(ValueError):
            checks.payload(bad)
    with pytest.raises(ValueError):
        checks.field_name("")

"""Sequence packing by best-fit decreasing over a segment tree.

Every document becomes its token ids and one end id; a document over the window is first cut into full
windows, so what is left to pack are pieces of 1 to ``window`` tokens. Best-fit decreasing looks at
lengths only, and pieces of one length are interchangeable; so the plan is made on the counts by length
(at most ``window`` numbers, however many documents there are): for each length, longest first, the
tightest open windows that can hold it are found in a segment tree indexed by remaining capacity, and
whole ranges of equal windows are filled at once. It is the packing that piece-by-piece best-fit
decreasing makes. The plan has a few rows a length; each piece then finds its place by its rank among
the pieces of its length, which is counted by bucket, so no length meets in one task.

Defined cases: null text counts as empty, an empty document is the end id alone; repeated rows are
packed as often as they come; a null id is kept; extra columns are dropped; an empty table gives none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm.common import appended, written
from recordlake.llm.wordpieces import WordEncoder


class CapacityTree:
    """A segment tree over remaining capacities: which is the smallest, from a bound up, with an open window?"""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        i = at + self.size
        self.any[i] = on
        i //= 2
        while i:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
            i //= 2

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces ``first`` to ``last`` (without) of one length: ``stack`` of them in each window from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    stack: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[list[Placement], dict[int, int]]:
    """The plan, and the number of windows by remaining capacity."""
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: ranges of equal windows (first, how many)
    plan: list[Placement] = []
    fresh = 0

    def put(capacity: int, first: int, many: int) -> None:
        open_.setdefault(capacity, []).append((first, many))
        tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        done, many = 0, counts[length]
        while done < many:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                stack = window // length
                first, have = fresh, max(1, (many - done) // stack)
                fresh += have
            else:
                first, have = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
                stack = capacity // length
            full = min(have, (many - done) // stack)
            if full == 0:  # the last few pieces share one window
                stack, full = many - done, 1
            plan.append(Placement(length, done, done + full * stack, first, stack, window - capacity))
            put(capacity - stack * length, first, full)
            if have > full:
                put(capacity, first + full, have - full)
            done += full * stack
    return plan, {c: sum(m for _, m in ranges) for c, ranges in open_.items() if ranges}


def tokenized(docs: DataFrame, path: str, end_id: int, window: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``doc_tokens`` and one ``crc`` for each cut of ``window`` tokens, in order."""
    end = end_id.to_bytes(4, "little")

    def make():
        encoder = WordEncoder(path)

        def run(texts: list[str | None]) -> list[list]:
            whole = [encoder.encode(t or "") + end for t in texts]
            return [[len(ids) // 4 for ids in whole], [[zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)] for ids in whole]]

        return run

    return appended(docs.select(*dict.fromkeys([*keep, text])), text, make, "doc_tokens long, crcs array<long>").select(*keep, "doc_tokens", "crcs")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    base = written(tokenized(docs.select(F.col(id_col).alias("id"), text), path, end_id, window, ["id"], text), "pieces")
    pieces = base.select("id", "doc_tokens", F.posexplode("crcs").alias("k", "crc"))
    start = F.col("k").cast("long") * window
    pieces = pieces.select("id", "doc_tokens", start.alias("start"), F.least(F.lit(window), F.col("doc_tokens") - start).alias("length"), F.col("crc").alias("ids_crc32"))

    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, window)

    # rank among the pieces of a length: by bucket, then within the bucket
    buckets = max(1, sum(counts.values()) // 10_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("bucket", "length").orderBy("id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.withColumn("r", F.row_number().over(inner) - 1).join(sizes, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("r"))
    # a few rows for each of at most ``window`` lengths
    rows = [(p.length, p.first, p.last, p.sequence, p.stack, p.offset) for p in plan]
    places = spark.createDataFrame(rows, "length long, first long, last long, sequence long, stack long, at long")
    hit = (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    out = ranked.join(F.broadcast(places), hit).drop(places["length"])
    nth = F.col("rank") - F.col("first")
    return out.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("stack"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("stack") * F.col("length")).cast("long").alias("offset"),
    )

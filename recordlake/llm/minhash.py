"""MinHash near-duplicates by DartMinHash.

A text is a weighted set of shingles (five lower-case words; weight 1, or the number of times it
occurs). Each shingle owns a strip of height weight over the rank axis, cut at 1, 2, 4, ... into regions.
Darts hit a region at ranks that form a Poisson process drawn from a hash of shingle and region, so any
two texts with a shingle see the same darts; a dart counts if it lies below the shingle's weight. Each
dart belongs to one of ``bands * rows`` coordinates by hash, and the earliest dart of each coordinate is
the signature. Ranks are drawn only up to the point by which about k (ln k + 3) darts have landed; a text
that still lacks a coordinate goes on from there. Two signatures agree in a coordinate with the
probability of their weighted Jaccard similarity.

Texts with equal words collapse to one representative first. Representatives that share a band (4
coordinates; 32 bands lose a pair of similarity 0.8 with probability 5e-8) are candidates. In every
bucket all members are compared with the smallest one, exactly, by their shingles. What a bucket then
still holds in different components is compared too: in a bucket of at most ``block`` members the pairs
across components (each pair once for all its buckets); in a larger one its members outside its largest
component against all its members, in chunks of ``4 * block``, as long as those outside fill at most ``chunks`` of them; so that
costs its size times a bound. The members of buckets with more outside are divided by shingles, exactly: in one order of all
their shingles, rarest first, each has a prefix, without which the rest weighs less than the threshold's share of it. Two texts
that share no shingle of their prefixes share less than that and are not similar. So those who share one are compared, as
in buckets, large groups in chunks without a bound. A bucket of copies costs its size, a bucket of unlike texts is not
compared pair by pair unless rare shingles are common to them too, and no similar pair of a bucket is lost.

Defined cases: null text counts as empty; texts without words are equal to each other; a text of one to
four words is one shingle; rows with a null id get a null class and are kept; rows with equal ids are one
node; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm.common import id_columns, let_go, scratch, written
from recordlake.llm.components import components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles(text: str | None, size: int = 5, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles as sorted 64-bit hashes, and their weights."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, np.uint64(min(size, len(words))))
    for j in range(min(size, len(words))):
        mixed = _mix(mixed * _A + h[j : j + n])
    keys, counts = np.unique(mixed, return_counts=True)
    return keys, counts.astype(np.float64) if weighted else np.ones(len(keys))


class DartMinHash:
    def __init__(self, k: int) -> None:
        self.k = k
        self.expected = k * (math.log(k) + 3)

    def _throw(self, owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, until: np.ndarray):
        """All darts below the weights up to rank ``until`` of their owner: owner, coordinate, rank, dart."""
        out = []
        region, low, width = 0, 0.0, 1.0
        while len(keys):
            seed = _mix(keys + np.uint64((region + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF))
            at, rank, step, limit = np.arange(len(keys)), np.zeros(len(keys)), 0, until[owner]
            while len(at):
                step += 1
                dart = _mix(seed[at] ^ np.uint64(step * int(_C) & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(_uniform(_mix(dart + _A))) / width
                on = rank < limit[at]
                at, rank, dart = at[on], rank[on], dart[on]
                if width == 1.0 and low == 0.0 and (weights >= 1).all():
                    hit = slice(None)
                else:
                    hit = low + width * _uniform(_mix(dart + _B)) < weights[at]
                out.append((owner[at][hit], (dart[hit] % np.uint64(self.k)).astype(np.int64), rank[hit], dart[hit]))
            low, width, region = low + width, max(1.0, low + width), region + 1
            above = weights > low
            owner, keys, weights = owner[above], keys[above], weights[above]
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))

    def signatures(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The earliest dart of each coordinate, for each non-empty weighted set."""
        out = np.zeros((len(sets), self.k), np.uint64)
        todo, factor = np.arange(len(sets)), 1.0
        while len(todo):
            sizes = [len(sets[i][0]) for i in todo]
            owner = np.repeat(np.arange(len(todo)), sizes)
            total = np.array([sets[i][1].sum() for i in todo])
            who, coordinate, rank, dart = self._throw(owner, np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo]), factor * self.expected / total)
            slot = who * self.k + coordinate
            order = np.argsort((slot.astype(np.uint64) << np.uint64(32)) | rank.astype(np.float32).view(np.uint32).astype(np.uint64))
            slot = slot[order]
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            found = np.zeros((len(todo), self.k), np.uint64)
            found.reshape(-1)[slot[first]] = dart[order][first]
            full = np.bincount(slot[first] // self.k, minlength=len(todo)) == self.k
            out[todo[full]] = found[full]
            todo, factor = todo[~full], factor * 2
        return out


def _features(bands: int, rows: int, size: int, weighted: bool, batch: int = 1000):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dart = DartMinHash(bands * rows)
        for whole in it:
            for k in range(0, len(whole), batch):
                pdf = whole.iloc[k : k + batch]
                sets = [shingles(t, size, weighted) for t in pdf["text"]]
                some = [i for i, s in enumerate(sets) if len(s[0])]
                signed = dart.signatures([sets[i] for i in some]).reshape(len(some), bands, rows) if some else []
                keys: list = [np.empty(0, np.int64)] * len(pdf)
                for i, s in zip(some, signed, strict=True):
                    h = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        h = _mix(h * _A + s[:, r])
                    keys[i] = h.view(np.int64)
                same = [xxhash.xxh3_128(" ".join((t or "").lower().split()).encode()).intdigest() for t in pdf["text"]]
                yield pd.DataFrame({
                    "known": pdf["known"], "id": pdf["id"], "t1": [(h >> 64) - (1 << 63) for h in same], "t2": [(h & (1 << 64) - 1) - (1 << 63) for h in same], "bands": keys,
                })
        let_go()

    return run


def _shingle_rows(size: int, weighted: bool):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sets = [shingles(t, size, weighted) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "s": [k.tobytes() for k, _ in sets], "w": [w.astype(np.float32).tobytes() if weighted else b"" for _, w in sets]})
        let_go()

    return run


def _shingles_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each shingle of each set."""
    for pdf in it:
        g = np.frombuffer(b"".join(pdf["s"]), np.int64)
        weights = np.frombuffer(b"".join(w or np.ones(len(s) // 8, np.float32).tobytes() for s, w in zip(pdf["s"], pdf["w"], strict=True)), np.float32)
        yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), [len(s) // 8 for s in pdf["s"]]), "g": g, "weight": weights.astype(float)})
    let_go()


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``id, g``: the shingles of each set that come first, rarest first, until the rest weighs less than ``threshold`` of it."""
    every = written(sets.mapInPandas(_shingles_of, "id long, g long, weight double"), "every")
    placed = every.join(every.groupBy("g").agg(F.count(F.lit(1)).alias("often")), "g")
    # a share so little too small that rounding loses no shingle
    onward = Window.partitionBy("id").orderBy(F.desc("often"), F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    heavy = F.sum("weight").over(onward) >= threshold * (1 - 1e-9) * F.sum("weight").over(Window.partitionBy("id"))
    return placed.withColumn("first", heavy).filter("first").select("id", "g")


def jaccard(a: bytes, aw: bytes, b: bytes, bw: bytes) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets; empty weights stand for ones."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    hit = x[place] == y
    if not aw and not bw:
        both = int(hit.sum())
        return both / (len(x) + len(y) - both)
    u, v = np.frombuffer(aw, np.float32).astype(float), np.frombuffer(bw, np.float32).astype(float)
    both = float(np.minimum(u[place[hit]], v[hit]).sum())
    return both / (u.sum() + v.sum() - both)


def _linked(threshold: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sim = [jaccard(*x) for x in zip(pdf["sa"], pdf["wa"], pdf["sb"], pdf["wb"], strict=True)]
            yield pdf.loc[np.array(sim) >= threshold, ["a", "b"]] if len(pdf) else pdf[["a", "b"]]

    return run


def _linked_in_block(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the members on side 0 and those on side 1 that are not joined yet; a spanning forest of them."""
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        root = {c: c for c in pdf["component"]}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for a, ca, sa, wa in zip(left["id"], left["component"], left["s"], left["w"], strict=True):
            for b, cb, sb, wb in zip(right["id"], right["component"], right["s"], right["w"], strict=True):
                x, y = find(ca), find(cb)
                short, long = sorted((len(sa), len(sb)))
                if x != y and (wa or wb or short >= threshold * long) and jaccard(sa, wa, sb, wb) >= threshold:
                    root[x] = y
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _open(placed: DataFrame, block: int) -> DataFrame:
    """Buckets that still hold several components, with their size ``n``; those with the same members count once."""
    facts = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("x2")]
    bucket = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), *facts).filter("c1 < c2")
    return placed.join(bucket.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "key")


def _with_minors(many: DataFrame) -> DataFrame:
    """``minor``: outside the bucket's largest component; ``minors``: how many of the bucket's members are."""
    shares = many.groupBy("key", "component").agg(F.count(F.lit(1)).alias("share"))
    largest = shares.groupBy("key").agg(F.max(F.struct("share", "component")).alias("m"))
    largest = largest.select("key", F.col("m.component").alias("largest"), F.col("m.share").alias("share"))
    out = many.join(largest, "key")
    return out.withColumn("minor", F.col("component") != F.col("largest")).withColumn("minors", F.col("n") - F.col("share")).drop("largest", "share")


def _components(d: DataFrame, known: DataFrame, threshold: float, size: int, weighted: bool, block: int, chunks: int) -> DataFrame:
    """``node, component`` of the representatives that have links."""
    reps = known.groupBy("t1", "t2").agg(F.min("id").alias("rep"))
    reps = written(known.join(reps.withColumnsRenamed({"t1": "u1", "t2": "u2"}), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & (F.col("id") == F.col("rep"))).select("id", F.posexplode("bands").alias("band", "h")), "bands")
    # within a band number, the hash is the bucket; buckets of one are no candidates
    leaders = reps.groupBy("band", "h").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("band", "h", "a")
    # a repeated row, or two texts of one id, are one member of a bucket
    members = written(reps.join(leaders, ["band", "h"]).select("band", "h", "a", "id").dropDuplicates(["band", "h", "id"]), "members")
    pairs = written(members.filter("id != a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    involved = members.select("id").distinct()
    sets = written(d.filter("known").join(involved, "id", "left_semi").mapInPandas(_shingle_rows(size, weighted), "id long, s binary, w binary").dropDuplicates(["id"]), "shingles")

    side = lambda k: sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"), F.col("w").alias(f"w{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    links = written(both.mapInPandas(_linked(threshold), "a long, b long"), "links")
    parts = components(links)

    placed = members.select("band", "h", "id").join(parts, F.col("id") == F.col("node"), "left")
    now = placed.select(F.xxhash64("band", "h").alias("key"), "id", F.coalesce("component", "id").alias("component"))
    few, blocks = [], []
    for divided in (False, True):
        open_ = written(_open(written(now, "placed"), block), "open")
        few.append(open_.filter(F.col("n") <= block).select("key", "id", "component"))
        many = written(_with_minors(open_.filter(F.col("n") > block)), "many")
        wide = F.col("minors") > chunks * 4 * block
        blocks.append(many if divided else many.filter(~wide))
        many = many.filter(wide)
        if divided or many.isEmpty():
            break
        # similar texts share a shingle of their prefixes; all wide buckets at once, so that nothing is compared for each of them
        apart = written(many.select("id", "component").distinct(), "apart")
        now = _prefixes(sets.join(apart, "id", "left_semi"), threshold).join(apart, "id").select(F.xxhash64("g").alias("key"), "id", "component")

    # a small bucket: its pairs of different components, at most ``block - 1`` a member, each pair once over all buckets
    groups = reduce(DataFrame.unionByName, few).groupBy("key").agg(F.collect_list(F.struct("id", "component")).alias("m"))
    across = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["component"] > x["component"]), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))))
    checked = groups.select(F.explode(across).alias("p")).select("p.a", "p.b").distinct().join(pairs, ["a", "b"], "left_anti")
    by_pair = checked.join(side("b"), "b").join(side("a"), "a").mapInPandas(_linked(threshold), "a long, b long")
    # a large one in chunks of about ``4 * block`` members by hash, so it never meets in one task: those with members
    # outside its largest component against all
    rest = reduce(DataFrame.unionByName, blocks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (4 * block))))
    rest = written(rest.select("key", "id", "component", "minor", "chunk"), "rest")
    found = rest.groupBy("key", "chunk").agg(F.max("minor").alias("minor"))
    left = found.filter("minor").select("key", F.col("chunk").alias("p"))
    grid = left.join(found.select("key", F.col("chunk").alias("q")), "key")
    on_left = rest.filter("minor").withColumnRenamed("chunk", "p").join(grid, ["key", "p"]).withColumn("side", F.lit(0))
    on_right = rest.withColumnRenamed("chunk", "q").join(grid, ["key", "q"]).withColumn("side", F.lit(1))
    work = on_left.select("key", "p", "q", "side", "id", "component").unionByName(on_right.select("key", "p", "q", "side", "id", "component")).join(sets, "id")
    by_block = work.groupBy("key", "p", "q").applyInPandas(_linked_in_block(threshold), "a long, b long")
    later = written(by_pair.union(by_block), "links")

    return components(links.union(later)) if not later.isEmpty() else parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, weighted: bool = False, bands: int = 32, rows: int = 4, block: int = 64, chunks: int = 64) -> DataFrame:
    """One row for each row of ``docs``: id, ``class_id`` (the smallest id of its group), ``kept``."""
    d = docs.select(*id_columns(id_col), F.col(text).alias("text"))
    features = written(d.mapInPandas(_features(bands, rows, size, weighted), "known boolean, id long, t1 long, t2 long, bands array<long>"), "features")
    known = features.filter("known")
    with scratch():
        joined = written(_components(d, known, threshold, size, weighted, block, chunks), "components", keep=True)
    firsts = known.groupBy("t1", "t2").agg(F.min("id").alias("rep"))
    out = features.select("known", "id", "t1", "t2").join(firsts, ["t1", "t2"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    of_known = lambda c: F.when(F.col("known"), c)
    class_id = of_known(F.coalesce("component", "rep"))
    return out.select(of_known(F.col("id")).alias(id_col), class_id.alias("class_id"), (~F.col("known") | F.coalesce(F.col("id") == class_id, F.lit(True))).alias("kept"))

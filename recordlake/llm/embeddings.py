"""Embedding near-duplicates: an epsilon grid order join.

Unit vectors at a cosine of at least t are at most eps = sqrt(2 - 2t) apart, and so are their
projections on any orthonormal directions. Vectors are projected on the leading principal directions
of the whole table, sorted by the grid cells (side eps) of those coordinates, and cut into blocks of
consecutive vectors with the box of their coordinates. Pairs of blocks whose boxes are further apart
than eps are skipped; a surviving pair is joined by recursion on halves of the two intervals with the
same test, down to small intervals whose cosines are computed in double precision. The principal
directions and the boxes only decide what is skipped; what is skipped is provably no link.

Equal vectors of a label collapse to one representative with a multiplicity first. Blocks meet in tiles
of eight, so that a block travels once for each pair of tiles. A pair of blocks returns, for each
representative with links, the number of linked vectors and the smallest one of its local component, never the links themselves: the output is linear in the vectors of the two blocks.

Defined cases: a vector that is null, zero, or holds a null or non-finite component, and a row with a
null label or null id, links with nothing; its component is its own id. Vectors of different lengths
do not link. Rows that repeat a vector are separate vectors that link with each other; rows that
share an id share a node of the link graph. Extra columns are dropped; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import parallelism, scratch, written
from recordlake.llm.components import components

LEAF = 256
#: eight blocks are a tile
TILE_BITS = 3


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _second_moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in it:
        for n, part in pdf.groupby(pdf["v"].map(len)):
            u = _unit(part["v"].tolist())
            sums[n] = sums.get(n, 0) + u.T @ u
    yield pd.DataFrame({"n": list(sums), "m": [m.tobytes() for m in sums.values()]})


def _add_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(m) for m in pdf["m"])
    return pd.DataFrame({"n": [pdf["n"].iloc[0]], "m": [total.tobytes()]})


def principal(vectors: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """Leading directions for each vector length; the driver gets at most 16 square matrices a length."""
    parts = vectors.select("v").mapInPandas(_second_moments, "n int, m binary")
    parts = parts.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("n", "at").applyInPandas(_add_moments, "n int, m binary")
    sums: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        sums[r.n] = sums.get(r.n, 0) + np.frombuffer(bytes(r.m)).reshape(r.n, r.n)
    return {n: np.linalg.eigh(m)[1][:, ::-1][:, :dims] for n, m in sums.items()}


def _grid(axes: dict[int, np.ndarray], eps: float, dims: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = np.zeros((len(pdf), dims))
            sizes = pdf["v"].map(len).to_numpy()
            for n in set(sizes.tolist()):
                at = np.flatnonzero(sizes == n)
                y = _unit(pdf["v"].iloc[at].tolist()) @ axes[n]
                out[at, : y.shape[1]] = y
            cells = np.floor(out / eps).astype(int)
            yield pdf.assign(y=list(out), **{f"c{i}": cells[:, i] for i in range(dims)})

    return run


def _blocks(size: int, dims: int):
    """Consecutive runs of one group, ``size`` vectors at most each."""

    def cut(pid: int, seq: int, rows: list[tuple]) -> dict:
        y = np.array([r[3] for r in rows])
        return {
            "bid": (pid << 32) | seq, "grp": rows[0][0], "lo": y.min(axis=0), "hi": y.max(axis=0), "ys": y.tobytes(),
            "ids": np.array([r[1] for r in rows], dtype=np.int64).tobytes(), "mult": np.array([r[2] for r in rows], dtype=np.int64).tobytes(), "vs": _unit([r[4] for r in rows]).tobytes(),
        }

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        seq = pid = 0
        for pdf in it:
            for row in zip(pdf["grp"], pdf["id"], pdf["mult"], pdf["y"], pdf["v"], pdf["pid"], strict=True):
                if held and (len(held) >= size or held[0][0] != row[0]):
                    yield pd.DataFrame([cut(pid, seq, held)])
                    held, seq = [], seq + 1
                held.append(row[:5])
                pid = row[5]
        if held:
            yield pd.DataFrame([cut(pid, seq, held)])

    return run


def _apart(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> float:
    gap = np.maximum(0.0, np.maximum(blo - ahi, alo - bhi))
    return float((gap * gap).sum())


def ego_links(xa, ya, xb, yb, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at a cosine of at least ``threshold``; for one block with itself each pair once."""
    eps2 = (2 - 2 * threshold) * (1 + 1e-9)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(xa), 0, len(xb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and a0 >= b1:  # below the diagonal: its mirror image is done
            continue
        if _apart(ya[a0:a1].min(axis=0), ya[a0:a1].max(axis=0), yb[b0:b1].min(axis=0), yb[b0:b1].max(axis=0)) > eps2:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            for p in [(a0, am), (am, a1)] if a1 - a0 > LEAF else [(a0, a1)]:
                for q in [(b0, bm), (bm, b1)] if b1 - b0 > LEAF else [(b0, b1)]:
                    stack.append((*p, *q))
            continue
        i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= threshold)
        i, j = i + a0, j + b0
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        found.append((i, j))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id each of n rows reaches by the links (i, j)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def _join_tiles(threshold: float, dims: int):
    def one(a: dict, b: dict) -> pd.DataFrame:
        same = a is b
        i, j = ego_links(a["x"], a["y"], b["x"], b["y"], same, threshold)
        if same:
            every, many, at = a["ids"], a["mult"], j
        else:
            every, many, at = np.concatenate([a["ids"], b["ids"]]), np.concatenate([a["mult"], b["mult"]]), j + len(a["ids"])
        n = len(every)
        links = np.bincount(i, weights=many[at], minlength=n) + np.bincount(at, weights=many[i], minlength=n)
        root = _local_roots(n, i, at, every)
        has = links > 0
        return pd.DataFrame({"id": every[has], "links": links[has].astype(np.int64), "root": root[has]})

    def run(pairs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The pairs of blocks of two tiles; each block is there once, whatever the number of its pairs."""
        held = {}
        for bid, ids, mult, ys, vs in zip(blocks["bid"].tolist(), blocks["ids"], blocks["mult"], blocks["ys"], blocks["vs"], strict=True):
            ids = np.frombuffer(ids, np.int64)
            held[bid] = {"ids": ids, "mult": np.frombuffer(mult, np.int64), "x": np.frombuffer(vs).reshape(len(ids), -1), "y": np.frombuffer(ys).reshape(len(ids), dims)}
        found = [one(held[p], held[q]) for p, q in zip(pairs["p"].tolist(), pairs["q"].tolist(), strict=True)]
        return pd.concat(found) if found else pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")

    return run


def _links(reps: DataFrame, threshold: float, eps: float, dims: int, block: int) -> DataFrame:
    """``id, links, root`` by pair of blocks: linked vectors, and the smallest one of the pair's component."""
    spark = reps.sparkSession
    axes = principal(reps, dims)
    cells = ", ".join(f"c{i} long" for i in range(dims))
    grid = reps.select("id", "mult", "grp", "v").mapInPandas(_grid(axes, eps, dims), f"id long, mult long, grp long, v array<double>, y array<double>, {cells}")
    order = ["grp", *(f"c{i}" for i in range(dims)), "id"]
    placed = grid.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    kind = "bid long, grp long, lo array<double>, hi array<double>, ys binary, ids binary, mult binary, vs binary"
    blocks = written(placed.mapInPandas(_blocks(block, dims), kind), "blocks")

    # pairs of blocks: equal group, overlapping or neighbouring cells of the first direction, boxes within eps
    box = blocks.select("bid", "grp", "lo", "hi")
    first = lambda s: (F.floor(F.col(s)[0] / eps)).cast("long")
    left = box.select(F.col("bid").alias("p"), "grp", F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.explode(F.sequence(first("lo"), first("hi"))).alias("cell"))
    right = box.select(F.col("bid").alias("q"), "grp", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), F.explode(F.sequence(first("lo") - 1, first("hi") + 1)).alias("cell"))
    gap = F.aggregate(F.arrays_zip("plo", "phi", "qlo", "qhi"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z.qlo - z.phi, z.plo - z.qhi), F.lit(2.0)))
    pairs = left.join(right, ["grp", "cell"]).filter((F.col("p") <= F.col("q")) & (gap <= eps * eps * (1 + 1e-9))).select("p", "q").distinct()
    # neighbouring blocks are a tile: a block travels once for each pair of tiles and not for each of its pairs
    tile = lambda c: F.shiftright(c, TILE_BITS)
    pairs = written(pairs.withColumn("tp", tile("p")).withColumn("tq", tile("q")), "pairs")
    sides = pairs.select(F.col("tp").alias("wp"), F.col("tq").alias("wq"), F.explode(F.array("p", "q")).alias("bid")).distinct()
    work = sides.join(blocks.select("bid", "ids", "mult", "ys", "vs"), "bid")
    joined = pairs.groupBy("tp", "tq").cogroup(work.groupBy("wp", "wq"))
    return joined.applyInPandas(_join_tiles(threshold, dims), "id long, links long, root long")


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93, dims: int = 6, block: int = 2048) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_links``, ``component_id`` and ``kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    eps = math.sqrt(2 - 2 * threshold) or 1e-9
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).alias("v"))
    base = base.withColumn("ok", _usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # two 64-bit hashes stand for the label and the vector
    base = base.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v", "label")))
    reps = base.filter("ok").groupBy("h1", "h2").agg(F.min(F.struct("id", "label", "v")).alias("r"), F.count(F.lit(1)).alias("mult"))
    reps = reps.select("h1", "h2", "mult", F.col("r.id").alias("id"), F.col("r.v").alias("v"), F.xxhash64(F.col("r.label"), F.size("r.v")).alias("grp"))
    reps = written(reps, "vectors")
    with scratch():
        found = written(_links(reps, threshold, eps, dims, block), "links", keep=True)
        parts = written(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components", keep=True)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = reps.select("h1", "h2", "id", "mult").join(counts, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = base.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))

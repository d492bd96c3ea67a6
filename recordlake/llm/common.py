"""Shared plumbing: tables, the shared folder, written intermediate tables, blocks."""

from __future__ import annotations

import ctypes
import gc
import mmap
import pickle
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

_OWN_DIR: dict[str, str] = {}
_SCRATCH: list[list[DataFrame]] = []
PAGE = mmap.PAGESIZE


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Rows travel to Python 1,000 at a time and not 10,000: whole texts are a few KB and some are MB, and a batch is held
    several times over, by the JVM outside its heap and by the worker. A number that the session chose itself stays."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="recordlake-")
        context.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts lineage.

    A surrounding ``scratch`` deletes the table when it ends, or with ``keep`` the one around that, if there is one.
    """
    path = f"{shared_dir(df.sparkSession)}/recordlake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._recordlake_path = path  # type: ignore[attr-defined]
    for scope in (_SCRATCH[:-1] if keep else _SCRATCH)[-1:]:
        scope.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end; what is kept must not read them any more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            forget(df)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_recordlake_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def block_count(df: DataFrame, text: str = "text", block_bytes: int = 12_000_000) -> int:
    """Blocks of about ``block_bytes`` bytes of text each, or of a quarter if that keeps more tasks busy; at least one."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes), min(parallelism(df.sparkSession), 4 * total // block_bytes))


def appended(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[list]]], kind: str, replace: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns (``kind``) that ``make()`` computes from the values of ``text`` (and of ``drop``, which go).

    Other columns pass as Arrow arrays, unread. With ``replace`` the first computed column takes the place of ``text``.
    """
    kept = [f for f in df.schema if f.name not in drop]
    new = list(StructType.fromDDL(kind))
    out = [new[0] if replace and f.name == text else f for f in kept] + new[replace:]
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in (text, *drop)]
            made = [pa.array(v, t) for v, t in zip(compute(*values), types, strict=True)]
            arrays = [made[0] if replace and f.name == text else batch.column(f.name) for f in kept] + made[replace:]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])
        del compute
        let_go()

    return df.mapInArrow(run, StructType(out))


#: a bundle of messages: where it is on its way to, the smallest number of its senders, the messages
BUNDLE = "at long, source long, data binary"
FAN = 256
#: the operators' fan: what a row costs besides its message (some 100 bytes) is a tenth of a block's messages for as many
#: receivers, while a second shuffle writes all of them once more
WIDE = 16384


def hops(count: int, fan: int = FAN) -> int:
    """Shuffles that messages to ``count`` receivers take: digits of the receivers' numbers to a base of at most ``fan``."""
    n, reach = 1, fan
    while reach < count:
        n, reach = n + 1, reach * fan
    return n


def base(count: int, fan: int = FAN) -> int:
    """The smallest base that has the receivers' numbers in as many digits: with a larger one, a little over ``fan`` receivers
    would be two leading digits, and one carrier would get most messages of all."""
    steps, n = hops(count, fan), 2
    while n**steps < count:
        n += 1
    return n


def bundled(messages: Iterable[tuple[int, object]], source: int, count: int, fan: int = FAN) -> pd.DataFrame:
    """What a sender emits: its messages (receiver, payload) in at most ``fan`` rows, by the leading digit of the receiver."""
    return _bundles([(to, source, payload) for to, payload in messages], source, base(count, fan) ** (hops(count, fan) - 1))


def _bundles(messages: list[tuple[int, int, object]], source: int, width: int) -> pd.DataFrame:
    at = defaultdict(list)
    for m in messages:
        at[m[0] // width].append(m)
    data = pd.Series([pickle.dumps(x) for x in at.values()], dtype=object)
    return pd.DataFrame({"at": pd.Series(list(at), dtype="int64"), "source": pd.Series([source] * len(at), dtype="int64"), "data": data})


def delivered(sent: DataFrame, count: int, fan: int = FAN) -> DataFrame:
    """Bundles carried on until ``at`` is their receiver, by one digit a shuffle.

    A row for each pair of sender and receiver would be the square of the input. Here a sender emits at
    most ``fan`` rows; a hop puts the bundles of ``base ** level`` neighbouring senders for one prefix together,
    which is about as much as one sender sends, and emits at most ``fan`` rows again. Messages nobody has to
    send are no rows.
    """
    steps, digit = hops(count, fan), base(count, fan)
    for level in range(1, steps):
        groups = sent.groupBy("at", F.floor(F.col("source") / digit**level))
        sent = groups.applyInPandas(_carried(digit ** (steps - 1 - level)), BUNDLE)
    return sent


def _carried(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["at"].iloc[0] < 0:  # no message: what a sender keeps for itself
            return pdf
        return _bundles([m for data in pdf["data"] for m in pickle.loads(data)], int(pdf["source"].min()), width)

    return run


def opened(pdf: pd.DataFrame) -> list[tuple[int, object]]:
    """(sender, payload) of the bundles that have reached their receiver, by sender."""
    return sorted(((m[1], m[2]) for data in pdf["data"] for m in pickle.loads(data)), key=lambda m: m[0])


def packed(docs: DataFrame, blocks: int, id_col: str, *values: str) -> DataFrame:
    """``block, docs``: rows (id, values) dealt to blocks by hash, each batch's share of a block as one compressed row.

    Equal rows travel as one with their number, so that a row repeated without end is a few bytes a batch.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for pdf in it:
            rows = Counter(zip(known_ids(pdf), *(pdf[f"v{k}"] for k in range(len(values))), strict=True))
            shares: dict[int, list] = defaultdict(list)
            for row, n in rows.items():
                shares[xxhash.xxh3_64_intdigest(repr(row).encode()) % blocks].append((n, row))
            yield pd.DataFrame({"block": pd.Series(list(shares), dtype="int64"), "docs": [z.compress(pickle.dumps(s)) for s in shares.values()]})
        let_go()

    taken = docs.select(*id_columns(id_col), *(F.col(c).alias(f"v{k}") for k, c in enumerate(values)))
    return taken.mapInPandas(run, "block long, docs binary")


def unpacked(pdf: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a block, (id, values), as often as they came."""
    z = zstandard.ZstdDecompressor()
    for data in pdf["docs"]:
        for n, row in pickle.loads(z.decompress(data)):
            yield from repeat(row, n)


def exact_ids(values: list[int | None]) -> pd.api.extensions.ExtensionArray:
    """Nullable ids without a detour over floating point, which is exact to 2^53 only."""
    return pd.array(values, dtype="Int64")


def known_ids(pdf: pd.DataFrame) -> list[int | None]:
    """The ids of rows that came as ``known boolean, id long`` (0 where not known)."""
    return [i if k else None for k, i in zip(pdf["known"].tolist(), pdf["id"].tolist(), strict=True)]


def id_columns(id_col: str) -> tuple[Column, Column]:
    """``known, id``: an id as two columns without nulls, which pandas keeps exact."""
    return F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id")


def dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with keys, and where its keys are, in their order."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    for p, at in zip(part[order][first].tolist(), np.split(order, first[1:]), strict=len(first) > 0):
        yield p, at


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for garbage while a block builds its tables: it would walk all of them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


#: bytes that a worker may keep between groups
KEPT = 220 << 20


def let_go() -> None:
    """Give memory that a large group has left behind back to the system, if that is much; workers live on and are reused."""
    try:
        with open("/proc/self/statm") as numbers:
            if int(numbers.read().split()[1]) * PAGE < KEPT:
                return
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system or C library
        pa.default_memory_pool().release_unused()


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file is; every operator takes a path of its own as well."""
    import public_tokenizers

    return public_tokenizers.path(name)

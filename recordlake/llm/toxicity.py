"""Toxicity by compression distance under trained zstandard dictionaries.

Training (driver, on a bounded sample of labelled rows): zstandard trains one dictionary on windows of
ordinary text and several small ones (other segment lengths) on toxic text. Toxic texts are ordinary for
the most part, so the toxic dictionaries are trained on what is news in them: the runs of ``GRAM``-byte
strings that toxic texts have several times as often as ordinary ones. Each toxic dictionary is then
appended to the ordinary one, and the ordinary one gets as many bytes that match nothing; so what both kinds
of text have in common costs the same under all of them, and a difference comes from the toxic part alone.

A window is a run of whole words of about ``window`` bytes. Its distance is its compressed length under the
ordinary dictionary less the mean of its lengths under the toxic ones. A text's features are its largest
distances, the shares of its windows with notable ones, and its number of windows, as the largest of many
is larger by chance. A logistic fit calibrates them; its features come from texts that the dictionaries of
their own half of the sample have not seen, so that learning by heart does not count. The threshold (score
0.5) is set where at most the share ``false_alarms`` of those ordinary texts lies above it.

Scoring (executors) runs over every window of every whole text.

Bounds: at most ``sample`` labelled rows of each class, chosen by a hash of the id among those with a document,
are fetched to fit on, with their whole texts (one text for each id); the dictionaries have a fixed size.

Defined cases: null text counts as empty; an empty text has no windows and a score of its own; without
labelled rows of both classes every score is 0; an id with both labels is toxic; repeated rows are scored
as often as they come; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import appended

LEVEL = 3
ORDINARY, TOXIC = 16_384, 1_024  # bytes of the two parts of a dictionary
SEGMENTS = (16, 20, 24, 28, 32)  # segment lengths, one toxic dictionary each
GRAM, NEWS, LEAST = 7, 6.0, 8  # bytes; how many times as often in toxic texts; in so many of them at least
TOP, NOTABLE = 4, (2.0, 3.0)
#: bytes that no text has
NOTHING = bytes([*range(1, 9), 11, *range(14, 32)]) * (TOXIC // 26)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: tuple[bytes, ...]
    center: np.ndarray
    spread: np.ndarray
    coefficients: np.ndarray  # intercept, features, their squares
    window: int


def _plain(text: str) -> bytes:
    return b" " + b" ".join(text.encode().lower().split()) + b" "


def windows(text: str, size: int) -> list[bytes]:
    """All words of a text, in runs of whole words that reach ``size`` bytes."""
    out, held, n = [], [], 0
    for w in text.encode().lower().split():
        held.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def _grams(data: bytes) -> np.ndarray:
    """The strings of ``GRAM`` bytes as numbers, by place."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | a[k : k + len(out)]
    return out


def _marks(toxic: list[bytes], ordinary: list[bytes], least: int) -> np.ndarray:
    """The strings, sorted, that toxic texts have ``NEWS`` times as often as ordinary ones, in ``least`` texts or more.

    Ordinary texts are only asked for the strings that enough toxic ones have, so no table of all strings is held.
    """
    keys, own = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    keys, own = keys[own >= least], own[own >= least]
    others = np.zeros(len(keys), int)
    for t in ordinary if len(keys) else ():
        grams = np.unique(_grams(t))
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        others[at[keys[at] == grams]] += 1
    return keys[(own + 0.5) / (len(toxic) + 1) > NEWS * (others + 0.5) / (len(ordinary) + 1)]


def _news(toxic: list[bytes], marks: np.ndarray) -> Iterator[bytes]:
    """The runs of those strings."""
    for data in toxic if len(marks) else ():
        grams = _grams(data)
        at = np.flatnonzero(marks[np.minimum(np.searchsorted(marks, grams), len(marks) - 1)] == grams)
        change = np.zeros(len(data) + 1, int)
        np.add.at(change, at, 1)
        np.add.at(change, at + GRAM, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]])))
        yield from (data[x:y] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains, without its head; the samples themselves if they are too few to train on."""
    try:
        got = zstandard.train_dictionary(size + 1024, samples, k=segment, d=6, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        got = b"".join(samples)[-size:]
    return got.rjust(size, NOTHING[:1])


def _dictionaries(toxic: list[bytes], ordinary: list[bytes], base: bytes) -> tuple[bytes, ...]:
    # a few texts have nothing in common often enough
    least = max(2, min(LEAST, len(toxic) // 20))
    news = list(_news(toxic, _marks(toxic, ordinary, least))) if toxic else []
    return tuple(base + _trained(news, TOXIC, k) for k in SEGMENTS)


class Distances:
    """Distances of windows under an ordinary dictionary and toxic ones; made once a worker."""

    def __init__(self, ordinary: bytes, toxic: tuple[bytes, ...]) -> None:
        self.compressors = []
        for d in (ordinary, *toxic):
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def _lengths(self, compressor: zstandard.ZstdCompressor, data: list[bytes]) -> np.ndarray:
        made = compressor.multi_compress_to_buffer(data, threads=0)
        return np.fromiter((len(made[i]) for i in range(len(data))), np.float64, len(data))

    def of(self, data: list[bytes]) -> np.ndarray:
        if not data:
            return np.empty(0)
        ordinary, *toxic = (self._lengths(c, data) for c in self.compressors)
        return ordinary - sum(toxic) / len(toxic)


def _features(distances: np.ndarray) -> np.ndarray:
    top = np.zeros(TOP)
    largest = np.sort(distances)[::-1][:TOP]
    top[: len(largest)] = largest
    return np.array([*top, *((distances >= x).mean() if len(distances) else 0.0 for x in NOTABLE), math.log1p(len(distances))])


def _design(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = (x - center) / spread
    return np.hstack([z, z * z])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(toxic: list[str], ordinary: list[str], window: int = 64, false_alarms: float = 0.01) -> Model:
    """Dictionaries and calibration from two lists of texts."""
    texts = [sorted(set(toxic)), sorted(set(ordinary))]
    plain = [[_plain(t) for t in x] for x in texts]
    cut = [[windows(t, window) for t in x] for x in texts]
    base = _trained([w for x in cut[1] for w in x], ORDINARY, SEGMENTS[-1])

    def made(half: slice) -> tuple[bytes, ...]:
        return _dictionaries(plain[0][half], plain[1][half], base)

    x, y = [], []
    for own, other in ((slice(0, None, 2), slice(1, None, 2)), (slice(1, None, 2), slice(0, None, 2))):
        distances = Distances(base + NOTHING[:TOXIC], made(own))
        for k in (0, 1):
            x += [_features(distances.of(w)) for w in cut[k][other]]
            y += [1.0 - k] * len(cut[k][other])
    x, y = np.array(x), np.array(y)
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _design(x, center, spread)
    b = _logistic(z, y)
    clean = np.sort((b[0] + z @ b[1:])[y == 0])[::-1]
    b[0] -= clean[min(int(false_alarms * len(clean)), len(clean) - 1)] + 1e-9
    return Model(base + NOTHING[:TOXIC], made(slice(None)), center, spread, b, window)


class Scorer:
    def __init__(self, model: Model, batch: int = 20_000) -> None:
        self.model, self.batch = model, batch
        self.distances = Distances(model.ordinary, model.toxic)

    def all(self, texts: list[str]) -> list[float]:
        """The score of each text; windows of several texts are compressed in one call."""
        out, held, sizes = [], [], []
        for t in texts:
            found = windows(t, self.model.window)
            held += found
            sizes.append(len(found))
            if len(held) >= self.batch:
                out += self._scores(held, sizes)
                held, sizes = [], []
        return out + self._scores(held, sizes)

    def _scores(self, held: list[bytes], sizes: list[int]) -> list[float]:
        if not sizes:
            return []
        each = np.split(self.distances.of(held), np.cumsum(sizes)[:-1])
        m = self.model
        z = m.coefficients[0] + _design(np.array([_features(d) for d in each]), m.center, m.spread) @ m.coefficients[1:]
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

    def __call__(self, text: str) -> float:
        return self.all([text])[0]


def held_out(id_col: str, remainder: int = 0) -> F.Column:
    """crc32 of the id as text, modulo 5, equals ``remainder``."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 3000, window: int = 64) -> Model | None:
    """Fit on at most ``sample`` labelled rows of each class, with their whole texts."""
    d = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    # only labels with a document count towards the sample
    known = known.join(d.select("id"), "id", "left_semi")
    some = [known.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (1, 0)]
    rows = d.join(F.broadcast(some[0].unionByName(some[1])), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    texts: tuple[list[str], list[str]] = ([], [])
    for r in rows.select("y", "text").toLocalIterator():
        texts[r.y == 0].append(r.text)
    return fit(*texts, window=window) if all(texts) else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the id) and ``score``; every row of ``docs`` once."""
    def make():
        scorer = Scorer(model) if model is not None else None
        return lambda texts: [scorer.all([t or "" for t in texts]) if scorer else [0.0] * len(texts)]

    keep = keep or [id_col]
    return appended(docs.select(*dict.fromkeys([*keep, text])), text, make, "score double").select(*keep, "score")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    found = score(docs, train(docs, labels, id_col, **options), id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

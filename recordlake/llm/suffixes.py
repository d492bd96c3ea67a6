"""Suffix-array deduplication: threshold-bounded interval expansion over a Burrows-Wheeler transform.

A byte is removed if a string of ``least`` (50) bytes that covers it also starts in a document with a
smaller id. All strings of that length are compared over the whole corpus, exactly, in four steps.

1. Blocks of documents: each 50-byte window has a minimizer, the smallest hash among its 24-byte
   strings. Equal windows have equal minimizers, so a window whose minimizer occurs in one document only
   cannot be shared. Blocks ask the parts of the hash space which of their minimizers others have too.
2. Blocks send the runs of windows with a shared minimizer ("segments", at most 113 bytes) to the part of
   that minimizer, each different one once with the smallest id that has it in the block. Runs of a minimizer
   that ``hot`` blocks or more have (a ruler, a licence) are cut into single windows, which go to the part of
   their own hash: a minimizer does not meet in one task, and equal windows need no more than be equal.
3. Each part joins the different segments whose minimizers have several to one text, sorts its suffixes, and keeps the
   Burrows-Wheeler transform, whose stable sort leads from a place to the place of the suffix one character
   shorter. Common prefixes come breadth first, by increasing value: a level extends every interval of suffixes
   backward by one character of the transform; neighbours get a border between them at the level at which
   their shorter suffixes have come into different intervals. Expansion stops at 50: what has no border
   then are the classes of suffixes that share 50 bytes or more. Each class has the smallest id of its
   members; blocks get these back.
4. Blocks remove the bytes of windows whose class has a smaller id than their document.

Messages travel as ``common.delivered`` says, documents as compressed batches. What a passage, line or copy
that a third of all documents share costs is one segment a block. Texts longer than a batch are cut into
overlapping batches of windows; no window is lost.

Defined cases: null text counts as empty; texts under 50 bytes stay whole; documents with a null id stay
whole and remove nothing; rows with equal ids do not remove each other's bytes; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import BUNDLE, WIDE, block_count, bundled, dealt, delivered, exact_ids, let_go, opened, packed, unpacked
from recordlake.llm.lm import expand, gaps, squeeze

KMER, RUN, BATCH = 24, 64, 1 << 20
#: bits of a hash that are left out: 48 stay, as keys travel; strings that share one are compared by content all the same
SPARE = np.uint64(16)
BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
NO_ID = np.iinfo(np.int64).max


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Minimizers:
    """Runs of windows with one minimizer, over batches of texts."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.up = np.empty(0, np.uint64)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:  # a little more, for later batches
            self.up = _powers(n + n // 8 + 1, BASE)
            self.down = _powers(n + n // 8 + 1, pow(BASE, -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[KMER:] - sums[:-KMER]) * self.down[: n - KMER + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h >> SPARE

    def _smallest(self, h: np.ndarray) -> np.ndarray:
        width, done = self.least - KMER + 1, 1
        while 2 * done <= width:
            h = np.minimum(h[:-done], h[done:])
            done *= 2
        rest = width - done
        return np.minimum(h[:-rest], h[rest:]) if rest else h

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """By batch: document number, first window in the document, number of windows, minimizer, place in the batch; the batch."""
        pieces: list[tuple[int, int, bytes]] = []
        held = 0
        for k, t in enumerate(texts):
            for at in range(0, len(t) - self.least + 1, BATCH):
                piece = t[at : at + BATCH + self.least - 1]
                pieces.append((k, at, piece))
                held += len(piece)
                if held >= BATCH:
                    yield self._batch(pieces)
                    pieces, held = [], 0
        if pieces:
            yield self._batch(pieces)

    def _batch(self, pieces: list[tuple[int, int, bytes]]):
        joined = b"".join(p[2] for p in pieces)
        m = self._smallest(self._hashes(np.frombuffer(joined, np.uint8)))
        sizes = np.array([len(p[2]) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - self.least + 1  # windows from there to the next start lie in two pieces
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        new[starts] = new[ends[:-1]] = True
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(m))
        who = np.searchsorted(starts, first, "right") - 1
        inside = first < ends[who]
        first, length, who = first[inside], length[inside], who[inside]
        if length.max() > RUN:  # periodic texts
            cuts = -(-length // RUN)
            before = RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            first, length, who = np.repeat(first, cuts) + before, np.minimum(RUN, np.repeat(length, cuts) - before), np.repeat(who, cuts)
        offset = np.array([p[1] for p in pieces])[who] + first - starts[who]
        return np.array([p[0] for p in pieces])[who], offset, length, m[first], first, joined


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]


def _texts(rows: list[tuple]) -> list[bytes]:
    """The bytes to compare; a document without id takes no part."""
    return [b"" if r[0] is None else r[1].encode() for r in rows]


def _ids(rows: list[tuple]) -> np.ndarray:
    return np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)


def _in_part(keys: np.ndarray, parts: int) -> bytes:
    """Sorted keys of one part, which has all keys of one remainder: it tells them apart by their quotients, and so the more parts
    there are, the fewer bits a key takes."""
    return squeeze(gaps(keys // np.uint64(parts)))


def _question(parts: int, least: int, fan: int = WIDE):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, several = _distinct([(r[3], r[0]) for r in Minimizers(least).runs(_texts(list(unpacked(pdf))))])
        sent = ((p, (_in_part(keys[at], parts), np.packbits(several[at]).tobytes())) for p, at in dealt(keys, parts))
        return bundled(sent, int(pdf["block"].iloc[0]), parts, fan)

    return run


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different minimizers, sorted, and whether more than one document has each."""
    if not found:
        return np.empty(0, np.uint64), np.empty(0, bool)
    m, doc = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(m, kind="stable")
    m, doc = m[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _shared(blocks: int, hot: int, fan: int = WIDE):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which minimizers of each block another document has too, and which of them ``hot`` blocks have."""
        messages = opened(pdf)
        keys = [np.cumsum(expand(x), dtype=np.uint64) for _, (x, _) in messages]
        several = [_bits(x, len(k)) for (_, (_, x)), k in zip(messages, keys, strict=True)]
        _, place, many = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        common = many > 1
        common[place[np.concatenate(several)]] = True
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = zip(np.split(common[place], cuts), np.split((many >= hot)[place], cuts), strict=True)
        return bundled(((block, tuple(np.packbits(x).tobytes() for x in a)) for (block, _), a in zip(messages, answers, strict=True)), int(pdf["at"].iloc[0]), blocks, fan)

    return run


def _segments(runs: list[Run], ids: np.ndarray, shared: np.ndarray, hot: np.ndarray, least: int):
    """Segments with a minimizer in ``shared`` (sorted; ``hot``: by window): contents in order of appearance, smallest id, key; and where each occurs."""
    numbers: dict[bytes, int] = {}
    smallest: list[int] = []
    key: list[int] = []
    where = []
    for doc, offset, length, m, at, joined in runs:
        place = np.minimum(np.searchsorted(shared, m), max(len(shared) - 1, 0))
        hit = np.flatnonzero(shared[place] == m) if len(shared) else np.empty(0, int)
        single = hot[place[hit]] if len(shared) else np.empty(0, bool)
        # a hot run becomes as many runs of one window
        times = np.where(single, length[hit], 1)
        one = np.repeat(hit, times)
        step = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
        single, size = np.repeat(single, times), np.where(np.repeat(single, times), 1, length[one])
        number = np.empty(len(one), np.int64)
        begin = at[one] + step
        end = begin + size + least - 1
        for i, (b, e, o, k, w) in enumerate(zip(begin.tolist(), end.tolist(), ids[doc[one]].tolist(), m[one].tolist(), single.tolist(), strict=True)):
            content = joined[b:e]
            n = numbers.get(content)
            if n is None:
                n = numbers[content] = len(smallest)
                smallest.append(o)
                key.append(xxhash.xxh3_64_intdigest(content) >> int(SPARE) if w else k)
            elif o < smallest[n]:
                smallest[n] = o
            number[i] = n
        where.append((doc[one], offset[one] + step, size, number))
    return list(numbers), np.array(smallest, np.int64), np.array(key, np.uint64), where


def _by_part(key: np.ndarray, contents: list[bytes], parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The segments of each part by key and content: the order in which a block sends them and gets answers. The order in which they
    appear would not do: every shuffle may give a block its rows in another one."""
    _, place, many = np.unique(key, return_inverse=True, return_counts=True)
    tied = sorted(np.flatnonzero(many[place] > 1).tolist(), key=contents.__getitem__)
    rank = np.zeros(len(key), np.int64)
    rank[tied] = np.arange(len(tied))
    for p, at in dealt(key, parts):
        yield p, at[np.lexsort((rank[at], key[at]))]


def _send(parts: int, least: int, fan: int = WIDE):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block, rows = int(docs["block"].iloc[0]), list(unpacked(docs))
        runs = list(Minimizers(least).runs(_texts(rows)))
        keys, _ = _distinct([(r[3], r[0]) for r in runs])
        common, hot, got = np.zeros(len(keys), bool), np.zeros(len(keys), bool), dict(opened(answers))
        for p, at in dealt(keys, parts):
            common[at], hot[at] = (_bits(x, len(at)) for x in got[p])
        shared, hot = keys[common], hot[common]
        contents, smallest, key, _ = _segments(runs, _ids(rows), shared, hot, least)
        z = zstandard.ZstdCompressor(level=1)
        sent = []
        for p, at in _by_part(key, contents, parts):
            mine = [contents[i] for i in at]
            sent.append((p, (z.compress(b"".join(mine)), squeeze(np.array([len(c) for c in mine], np.uint64)), _in_part(key[at], parts), squeeze(smallest[at].astype(np.uint64)))))
        # the block's own note, handed through by the next step
        note = pickle.dumps((squeeze(gaps(shared)), np.packbits(hot).tobytes()))
        made = pd.concat([pd.DataFrame({"at": [-1 - block], "source": [block], "data": [note]}), bundled(sent, block, parts, fan)])
        del rows, runs, contents, sent
        let_go()
        return made

    return run


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of segments that each end with 0, ties by place; ``left``: bytes up to and with that 0."""
    n = len(text)
    keys = text.astype(np.uint64)
    for k in (1, 2, 4):
        keys = (keys << np.uint64(8 * k)) | np.where(left > k, np.append(keys, np.zeros(k, np.uint64))[k:], np.uint64(0))
    length, most = 8, int(left.max())
    while True:
        # not a stable sort, which takes three times as long: equal suffixes are put in order at the end
        order = np.argsort(keys)
        sorted_ = keys[order]
        new = np.zeros(n, np.uint64)
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        if length >= most:
            return np.argsort((rank << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        after = np.zeros(n, np.uint64)
        far = np.flatnonzero(left > length)
        after[far] = rank[far + length] + np.uint64(1)
        keys = (rank << np.uint64(32)) | after
        length *= 2


def prefix_classes(text: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place in it whether a class of ``least`` common bytes starts there.

    Breadth first over levels: ``border[j]`` says that neighbours j-1 and j differ within the bytes seen so
    far. Extending an interval backward by one character of the transform moves its borders to the
    places that the character's occurrences have in the suffix array; a place gets its border at the level
    at which a border first lies between the two occurrences that become its neighbours.
    """
    n = len(text)
    order = suffix_order(text, left)
    first = text[order]
    transform = text[order - 1]
    # the k-th occurrence of a character in the transform becomes the k-th suffix that begins with it
    source = np.argsort(transform, kind="stable").astype(np.int32)
    border = np.ones(n, bool)
    border[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    active = np.flatnonzero(~border).astype(np.int32)
    low, high = source[active - 1], source[active]
    found = 0
    for _ in range(1, least):
        passed = np.cumsum(border, dtype=np.int32)
        now = passed[high] != passed[low]
        before, found = found, np.count_nonzero(now)
        if found == before:
            break
        border[active[now]] = True
        if 8 * found > len(active):
            keep, found = ~now, 0
            active, low, high = active[keep], low[keep], high[keep]
    return order, border


def _spread(starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The positions of the chosen ranges, one after the other."""
    n = lengths[chosen]
    return np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _smallest_of_classes(contents: list[bytes], smallest: np.ndarray, least: int) -> np.ndarray:
    """For each window of each segment, in order, the smallest id among the segments that have it."""
    sizes = np.array([len(c) for c in contents])
    # UTF-8 has no byte above 0xF4: one more leaves 0 for the ends
    text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)
    left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - np.arange(len(text))
    order, border = prefix_classes(text, left, least)
    owner = np.repeat(smallest, sizes + 1)
    owner[left <= least] = NO_ID  # no window starts there
    head = np.flatnonzero(border)
    low = np.minimum.reduceat(owner[order], head)
    best = np.empty(len(text), np.int64)
    best[order] = np.repeat(low, np.diff(head, append=len(text)))
    return best[left > least]


def _classes(least: int, blocks: int, fan: int = WIDE):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["at"].iloc[0] < 0:
            return pdf
        numbers: dict[bytes, int] = {}
        smallest: list[int] = []
        keys: list[int] = []
        asked = []
        z = zstandard.ZstdDecompressor()
        for block, (data, sizes, key, ids) in opened(pdf):
            at, mine, data = 0, [], z.decompress(data)
            for size, m, o in zip(expand(sizes).tolist(), np.cumsum(expand(key), dtype=np.uint64).tolist(), expand(ids).astype(np.int64).tolist(), strict=True):
                content = data[at : at + size]
                at += size
                n = numbers.setdefault(content, len(smallest))
                if n == len(smallest):
                    smallest.append(o)
                    keys.append(m)
                elif o < smallest[n]:
                    smallest[n] = o
                mine.append(n)
            asked.append((block, np.array(mine, np.int64)))
        windows = np.array([len(c) for c in numbers]) - least + 1
        starts = np.cumsum(windows) - windows
        best = np.repeat(np.array(smallest, np.int64), windows)
        # equal windows have equal minimizers: segments that are alone with theirs, equal ones being one by now, share nothing more
        _, place, many = np.unique(np.array(keys, np.uint64), return_inverse=True, return_counts=True)
        compared = np.flatnonzero(many[place] > 1)
        if len(compared):
            every = list(numbers)
            best[_spread(starts, windows, compared)] = _smallest_of_classes([every[i] for i in compared], np.array(smallest, np.int64)[compared], least)
        part = int(pdf["at"].iloc[0])
        made = bundled(((block, squeeze(best[_spread(starts, windows, mine)].astype(np.uint64))) for block, mine in asked), part, blocks, fan)
        del numbers, asked, best
        let_go()
        return made

    return run


def _removed(parts: int, least: int, give_text: bool, carry: tuple[str, ...] = ()):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = list(unpacked(docs))
        ids, whole = _ids(rows), [r[1].encode() for r in rows]
        note = answers["at"] < 0
        gapped, bits = pickle.loads(answers["data"][note].iloc[0])
        shared = np.cumsum(expand(gapped), dtype=np.uint64)
        got = dict(opened(answers[~note]))
        contents, _, key, where = _segments(list(Minimizers(least).runs(_texts(rows))), ids, shared, _bits(bits, len(shared)), least)
        windows = np.array([len(c) for c in contents], np.int64) - least + 1
        asked = list(_by_part(key, contents, parts))
        del contents
        starts = np.cumsum(windows) - windows
        best = np.empty(int(windows.sum()), np.int64)
        for p, at in asked:
            best[_spread(starts, windows, at)] = expand(got[p]).astype(np.int64)
        # windows to remove, as changes of the number of covering windows
        hits: dict[int, list[np.ndarray]] = defaultdict(list)
        for doc, offset, length, number in where:
            at = _spread(starts, windows, number)
            owner = np.repeat(doc, length)
            begin = np.repeat(offset - (np.cumsum(length) - length), length) + np.arange(length.sum())
            hit = best[at] < ids[owner]
            owner, begin = owner[hit], begin[hit]
            if len(owner):
                cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
                for piece, who in zip(np.split(begin, cut), owner[np.concatenate([[0], cut])].tolist(), strict=True):
                    hits[who].append(piece)
        out = []
        for k, data in enumerate(whole):
            cover = np.zeros(len(data) + 1, np.int32)
            if k in hits:
                begin = np.concatenate(hits[k])
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + least, -1)
            gone = np.cumsum(cover[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            row = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
            if give_text:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                row += (kept.decode("utf-8", "ignore"), edge.tolist())
            out.append((*row, *rows[k][2:]))
        columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "edges"] if give_text else []), *carry]
        made = pd.DataFrame(out, columns=columns)
        made.insert(0, "id", exact_ids([r[0] for r in rows]))
        del rows, whole, where, asked, best, hits, out
        let_go()
        return made

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 50, block_bytes: int = 6_000_000, hot: int = 256, give_text: bool = False, carry: tuple[str, ...] = (), fan: int = WIDE) -> DataFrame:
    """One row for each document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    With ``give_text`` also ``kept`` (bytes of characters cut in two are left out) and ``edges``, the removed
    byte ranges as start and end in turn; string columns named in ``carry`` come along.
    """
    if least < KMER:
        raise ValueError(f"least must be {KMER} or more")
    parts = block_count(docs, text, block_bytes)
    d = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"), *(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(carry)))
    rows = packed(d, parts, "doc", "body", *(f"c{k}" for k in range(len(carry))))
    by_block, by_receiver = rows.groupBy("block"), lambda df: df.groupBy("at")
    asked = delivered(by_block.applyInPandas(_question(parts, least, fan), BUNDLE), parts, fan)
    common = delivered(by_receiver(asked).applyInPandas(_shared(parts, hot, fan), BUNDLE), parts, fan)
    sent = delivered(by_block.cogroup(by_receiver(common)).applyInPandas(_send(parts, least, fan), BUNDLE), parts, fan)
    classes = delivered(by_receiver(sent).applyInPandas(_classes(least, parts, fan), BUNDLE), parts, fan)
    # a block's note and the answers to it
    classes = classes.withColumn("block", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")))
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, edges array<long>" if give_text else "") + "".join(f", `{c}` string" for c in carry)
    out = by_block.cogroup(classes.groupBy("block")).applyInPandas(_removed(parts, least, give_text, carry), kind)
    return out.withColumnRenamed("id", id_col)

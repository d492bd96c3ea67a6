"""Language-model scoring with a weighted backoff automaton, spread over blocks of documents.

Model: n-grams of ``order`` tokens and less, smoothed towards the next shorter history: P(w) gives unseen
words the Good-Turing share n1/N and known words the rest in proportion to their counts, and
P(w|h) = (c(hw) + k P(w|h')) / (c(h) + k), where h' is h without its first token. As an automaton: a state
for each history seen in training, an arc for each word seen after it, and a failure arc of weight
k / (c(h) + k) from the state of h to that of h'. A text is read once from left to right. The state carried
to a token is that of its longest history that is a state; where the state has no arc for the token, its
failure arc is followed, and so on down to the state without history, which has an arc for every word. A
text's score is the sum of the log10 weights on its way. A state depends on the last ``order - 1`` tokens
alone, so a block's traversals run side by side, one array operation a failure step.

The automaton of the whole corpus grows with the corpus, so it is nowhere held as a whole. Documents are
dealt to blocks by hash. A block sends its different n-grams, as sorted hashes with their training counts, to
the parts of the key space; a part adds up over blocks and answers each block with the total counts in the
order of its question; the block then builds the states and arcs that its texts can reach and traverses
them. A hot word is one key a block, whatever its frequency. Messages travel as ``common.delivered`` says.
Sums over all words (tokens, different words, words seen once) are added up from the parts' words.

Words are held as 64-bit hashes: among n different words about n^2 / 2^65 pairs share one (0.03 at 10^9), and
count as one word; longer n-grams as 56-bit ones. All words without training count are one symbol to the model.

Defined cases: null text counts as empty (its only token is the end); rows with a null id are training
rows; without training rows every word is unknown, train_tokens is 0 and the model gives each token
log10(1/2); repeated rows are scored and counted as often as they come; extra columns are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import BUNDLE, WIDE, block_count, bundled, dealt, delivered, exact_ids, let_go, opened, packed, unpacked

GRAM_BITS = 56
END = b""  # no word is empty
FIRST = np.uint64(0x9E3779B97F4A7C15)  # the history before the first word


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, so that high zero bytes cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; ``np.cumsum`` undoes it."""
    return np.diff(keys, prepend=np.uint64(0))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Grams:
    """The tokens of a block's documents, and for each length the different n-grams in the order of their hashes."""

    ends: np.ndarray  # by document, the number of tokens up to its end
    keys: list[np.ndarray]  # by length less one
    at: list[np.ndarray]  # by length less one: by token, the number of the n-gram that ends there; -1 before there is one


def grams(texts: list[str], order: int = 2) -> Grams:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    tokens, total = [], 0
    ends = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        words.append(END)
        tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        total += len(words)
        ends[i] = total
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    words, place = np.unique(hashes, return_inverse=True)
    keys, at = [words], [place[np.concatenate(tokens)]]
    word, begin = words[at[0]], np.concatenate([[0], ends[:-1]])
    since = np.arange(total) - np.repeat(begin, np.diff(ends, prepend=0))  # tokens before, in the document
    longer = word
    for length in range(2, order + 1):
        history = np.concatenate([[FIRST], longer[:-1]])
        if length == 2:
            history[begin] = FIRST
        longer = _mix(history, word)
        there = np.flatnonzero(since >= length - 2)
        found, place = np.unique(longer[there] >> np.uint64(64 - GRAM_BITS), return_inverse=True)
        keys.append(found)
        at.append(np.full(total, -1))
        at[-1][there] = place
    return Grams(ends, keys, at)


def _question(parts: int, order: int, fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(unpacked(pdf))
        g = grams([t for _, _, t in rows], order)
        trained = np.repeat([not held for _, held, _ in rows], np.diff(g.ends, prepend=0))
        messages: dict[int, list] = defaultdict(lambda: [None] * order)
        for n, (keys, at) in enumerate(zip(g.keys, g.at, strict=True)):
            counts = np.bincount(at[at >= 0], weights=trained[at >= 0], minlength=len(keys)).astype(np.uint64)
            for p, here in dealt(keys, parts):
                messages[p][n] = (squeeze(gaps(keys[here])), squeeze(counts[here]))
        return bundled(messages.items(), int(pdf["block"].iloc[0]), parts, fan)

    return run


def _sums(asked: list) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The total count of each key asked for, the place of each block's keys among them, and how many each block has."""
    keys = [np.cumsum(expand(x[0]), dtype=np.uint64) for x in asked]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([expand(x[1]) for x in asked]).astype(np.float64)
    return np.bincount(place, weights=counts, minlength=len(every)).astype(np.uint64), place, [len(k) for k in keys]


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a part's words: tokens, different words, words seen once, in training."""
    words = [m[0] for _, m in opened(pdf) if m[0] is not None]
    sums = _sums(words)[0] if words else np.empty(0, np.uint64)
    return pd.DataFrame({"tokens": [int(sums.sum())], "different": [int((sums > 0).sum())], "once": [int((sums == 1).sum())]})


def _answer(blocks: int, order: int, fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        messages = opened(pdf)
        out: dict[int, list] = defaultdict(lambda: [None] * order)
        for n in range(order):
            asked = [(block, m[n]) for block, m in messages if m[n] is not None]
            if asked:
                sums, place, sizes = _sums([m for _, m in asked])
                for (block, _), mine in zip(asked, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
                    out[block][n] = squeeze(sums[mine])
        made = bundled(out.items(), int(pdf["at"].iloc[0]), blocks, fan)
        del out, messages
        let_go()
        return made

    return run


def _counts_at(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at))
    out[at >= 0] = counts[at[at >= 0]]
    return out


class BackoffAutomaton:
    """The part of the automaton that some texts can reach: ``counts`` by length less one, of the n-grams of ``grams``.

    A state is a token's history: its length, and the n-gram that ends before the token.
    """

    def __init__(self, counts: list[np.ndarray], firsts: int, n: int, once: int, k: float) -> None:
        self.counts, self.firsts, self.k = counts, firsts, k
        unseen = (once + 0.5) / (n + 1) if n else 0.5
        self.alone = np.where(counts[0] > 0, (1 - unseen) * counts[0] / max(n, 1), unseen)

    def read(self, g: Grams) -> np.ndarray:
        """The log10 weight of each token on the way of a traversal of each document."""
        order, total = len(g.at), len(g.at[0])
        seen = np.zeros((order, total))  # by length of the history: how often the state was left in training
        arc = np.ones((order, total), bool)  # whether it has an arc for the token
        p = np.empty((order, total))  # the smoothed probability there, which is the arc's weight
        p[0] = self.alone[g.at[0]]
        state = np.zeros(total, np.int64)
        begin = np.concatenate([[0], g.ends[:-1]])
        for length in range(1, order):
            before = np.concatenate([[-1], g.at[length - 1][:-1]])
            before[begin] = -1
            seen[length] = _counts_at(self.counts[length - 1], before)
            if length == 1:
                seen[1][begin] = self.firsts
            state[seen[length] > 0] = length
            times = _counts_at(self.counts[length], g.at[length])
            arc[length] = times > 0
            p[length] = np.where(seen[length] > 0, (times + self.k * p[length - 1]) / (seen[length] + self.k), p[length - 1])
        weight = np.zeros(total)
        todo = np.arange(total)
        while len(todo):
            taken = arc[state[todo], todo]
            weight[todo[taken]] += np.log10(p[state[todo[taken]], todo[taken]])
            todo = todo[~taken]
            weight[todo] += np.log10(self.k / (seen[state[todo], todo] + self.k))
            state[todo] -= 1
        return weight


def _scored(parts: int, order: int, k: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = list(unpacked(docs))
        g = grams([t for _, _, t in rows], order)
        counts = [np.zeros(len(keys), dtype=np.int64) for keys in g.keys]
        got = dict(opened(answers))
        for n, keys in enumerate(g.keys):
            for p, here in dealt(keys, parts):
                counts[n][here] = expand(got[p][n])
        n, v, once = (int(answers[c].iloc[0]) for c in ("tokens", "different", "once"))
        # texts read in training = ends counted in training
        firsts = int(counts[0][np.searchsorted(g.keys[0], np.uint64(xxhash.xxh3_64_intdigest(END)))])
        model = BackoffAutomaton(counts, firsts, n, once, k).read(g)
        c = counts[0][g.at[0]]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        starts = np.concatenate([[0], g.ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        out = pd.DataFrame({
            "id": exact_ids([i for i, _, _ in rows]), "held_out": [h for _, h, _ in rows], "n_tokens": np.diff(g.ends, prepend=0), "n_known": add((c > 0).astype(np.int64)),
            "train_tokens": n, "base_score": add(base), "score": add(model),
        })
        del rows, g, counts, got, model, c, base
        let_go()
        return out

    return run


def score_texts(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text: str = "text", order: int = 2, k: float = 4.0, block_bytes: int = 6_000_000, fan: int = WIDE) -> DataFrame:
    """Score every text with the model of the rows where ``held_out`` is not true; ``order``: the longest n-gram."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    blocks = block_count(docs, text, block_bytes)
    d = docs.select(F.col(id_col).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = packed(d, blocks, "doc", "held", "body")
    asked = delivered(rows.groupBy("block").applyInPandas(_question(blocks, order, fan), BUNDLE), blocks, fan)
    totals = asked.groupBy("at").applyInPandas(_totals, "tokens long, different long, once long")
    sums = totals.agg(*(F.sum(c).alias(c) for c in totals.columns))
    answers = delivered(asked.groupBy("at").applyInPandas(_answer(blocks, order, fan), BUNDLE), blocks, fan)
    for c in totals.columns:
        answers = answers.withColumn(c, sums.select(c).scalar())
    out = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("at")).applyInPandas(_scored(blocks, order, k), out).withColumnRenamed("id", id_col)

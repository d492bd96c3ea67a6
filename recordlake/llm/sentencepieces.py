"""SentencePiece encoding and decoding on a relational lattice.

Texts fall into units that no piece can cross: runs of spaces with the word after them, cut again between
characters that stand side by side in no piece. Each different unit is encoded once for the whole table:
its substrings of at most the longest piece's length are exploded, equi-joined to the piece table (its
size is bounded by the vocabulary, so it is broadcast), and grouped by unit to the unit's edges. A fold with
Spark's higher-order functions then finds the path.

The models here are of BPE type, for which the best path by added scores (Viterbi) is not the encoding:
BPE repeatedly takes the adjacent pair with the best score. So the fold carries the set of borders, as bits
of a long, and each step removes the border inside the best edge that joins two neighbours; edges are
sorted by score and place, so that is the first one that fits. The result equals the library's ids.

Units over 62 characters do not fit into the bits and are merged by a heap in Python, with the same rule.
For a model of unigram type, ``best_path`` is the Viterbi fold on the same lattice.

Blocks of documents, made where they are read, ask the parts of the key space for their different units and
get ids back in order, so no join carries every word of every document, and no text is shuffled: a block's
note to itself has its texts as numbers of words. Decoding joins what the ids of the units stand for, so whether
a text comes back from it is told by its units, each decoded once where it is encoded.

Defined cases: null text counts as empty; an empty text has no ids; characters without a piece become
byte pieces; rows with equal or null ids are encoded each for itself; extra columns are dropped.
"""

from __future__ import annotations

import heapq
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import BUNDLE, WIDE, block_count, bundled, delivered, exact_ids, id_columns, known_ids, let_go, opened, parallelism, uncollected
from recordlake.llm.lm import expand, squeeze

SPACE = "▁"
BITS = 62
#: a unit's number in the table: part, place in the part, characters
PLACE_BITS, LENGTH_BITS = 32, 6


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [0] * 256
        self.text: list[bytes] = []
        self.scores: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                # a space in a text and the sign that stands for it are the same to the model
                spaced = piece.replace(SPACE, " ")
                self.ids[spaced], self.scores[spaced] = i, model.get_score(i)
                self.text.append(spaced.encode())
        self.longest = max(map(len, self.ids))
        self.near = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        beside = {c for pair in self.near for c in pair}
        alone = "".join(re.escape(chr(c)) for c in range(128) if c != 32 and chr(c) not in beside)
        self.words = re.compile(rf" +[^ {alone}]*|[^ {alone}]+|[{alone}]+" if alone else " +[^ ]*|[^ ]+")

    def units(self, word: str) -> list[str]:
        """Cut where two characters stand side by side in no piece; a word of letters alone stays whole."""
        word = word.replace(SPACE, " ")
        bare = word[1:] if word[:1] == " " else word
        if len(bare) <= 24 and (bare.isalpha() or not bare):
            return [word]
        if 2 <= len(bare) <= 24 and bare[:-1].isalpha():  # one sign after a word
            return [word] if (bare[-2], bare[-1]) in self.near else [word[:-1], word[-1]]
        cuts = [0, *(i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in self.near), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merged(self, unit: str) -> list[int]:
        """Ids of a unit by a heap: best score first, then the leftmost."""
        n = len(unit)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            piece = unit[a : end[b]]
            if piece in self.scores:
                heapq.heappush(heap, (-self.scores[piece], a, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, e = heapq.heappop(heap)
            b = end[a] if alive[a] else n
            if b >= n or not alive[a] or end[b] != e:
                continue
            end[a], alive[b] = e, False
            if e < n:
                before[e] = a
                offer(a, e)
            if a:
                offer(before[a], a)
        return [x for i in range(n) if alive[i] for x in self.of(unit[i : end[i]])]

    def of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in (piece if piece != " " else SPACE).encode()]

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id sequence: pieces joined, the space that encoding puts in front taken off."""
        data = self.bytes_of(ids.tolist())
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    """The piece table of a file, made once a worker."""
    return Pieces(path)


def _words(text: str, pieces: Pieces) -> list[str]:
    """Runs of spaces with the word after them, cut around the characters that stand beside others in no piece."""
    return pieces.words.findall(" " + text) if text else []


def _part(unit: str, parts: int) -> int:
    return zlib.crc32(unit.encode()) % parts


def _block(pieces: Pieces, rows: list[tuple[int | None, str]], own: int, seq: int, parts: int, fan: int) -> pd.DataFrame:
    """What a block asks the parts, and its note to itself: its texts as numbers of words, its words as numbers of units."""
    numbers: dict[str, int] = defaultdict(count().__next__)
    texts = []
    for _, t in rows:
        words = _words(t, pieces)
        texts.append(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)))
    several: dict[int, list[str]] = {}  # words that are not a unit as they stand
    words_of = list(numbers)
    for k, w in enumerate(words_of):
        if not (w[1:] if w[0] == " " else w).isalpha() or len(w) > 24:
            units = pieces.units(w)
            if units != [w]:
                several[k] = units
    every = {w for k, w in enumerate(words_of) if k not in several}.union(*several.values())
    asked: dict[int, list[str]] = defaultdict(list)
    for u in sorted(every):
        asked[_part(u, parts)].append(u)
    z = zstandard.ZstdCompressor(level=1)
    order = sorted(asked)
    place = {u: k for k, u in enumerate(u for p in order for u in asked[p])}
    # a text is its words in a row; a word that is not its units in a row will not come back from decoding
    strange = [k for k, units in several.items() if "".join(units) != words_of[k]]
    sizes, of_words = [1] * len(words_of), []
    for k, w in enumerate(words_of):
        units = several.get(k)
        if units is None:
            of_words.append(place[w])
        else:
            sizes[k] = len(units)
            of_words += [place[u] for u in units]
    arrays = [[len(t) for t in texts], np.concatenate(texts), sizes, of_words]
    note = pickle.dumps((seq, order, [i for i, _ in rows], strange, [squeeze(np.array(x, np.uint64)) for x in arrays]))
    sent = bundled([(p, (seq, z.compress("\0".join(u.replace("\0", "\1\1") for u in us).encode()))) for p, us in asked.items()], own, parts, fan)
    return pd.concat([pd.DataFrame({"at": [-1 - own], "source": own, "data": [note]}), sent])


def _read(path: str, parts: int, block_bytes: int, fan: int):
    """Blocks of the rows as they are read; a block is known by its partition and its place there."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, own, seq, size, rows = pieces_of(path), TaskContext.get().partitionId(), 0, 0, []
        for pdf in it:
            for row in zip(known_ids(pdf), pdf["text"], strict=True):
                rows.append(row)
                size += len(row[1])
                if size >= block_bytes:
                    with uncollected():
                        made = _block(pieces, rows, own, seq, parts, fan)
                    yield made
                    seq, size, rows = seq + 1, 0, []
        if rows:
            with uncollected():
                made = _block(pieces, rows, own, seq, parts, fan)
            yield made
        del rows
        let_go()

    return run


def _list(data: bytes) -> list[str]:
    return [u.replace("\1\1", "\0") for u in zstandard.ZstdDecompressor().decompress(data).decode().split("\0")]


def _union(lists: list[list[str]]) -> list[str]:
    """The different units of a part, in the order that numbers them."""
    return sorted(set().union(*lists))


def _different(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["at"].iloc[0] < 0:
        return pd.DataFrame({"uid": pd.Series(dtype="int64"), "unit": pd.Series(dtype=object)})
    part = int(pdf["at"].iloc[0]) << PLACE_BITS + LENGTH_BITS
    every = _union([_list(data) for _, (_, data) in opened(pdf)])
    found = [(part | k << LENGTH_BITS | len(u), u) for k, u in enumerate(every) if 2 <= len(u) <= BITS]
    return pd.DataFrame(found, columns=["uid", "unit"])


def lattice(units: DataFrame, pieces: DataFrame, longest: int, key: str = "uid") -> DataFrame:
    """``units`` (a key and ``unit``) to ``key, edges``: pieces of two or more characters, best rank first, then by place.

    ``pieces``: ``piece, rank``. An edge is a long: rank, start and end, so that edges sort as numbers.
    """
    n = F.char_length("unit")
    starts = units.select(key, "unit", F.explode(F.sequence(F.lit(0), n - 2)).alias("a"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(2), F.least(n - F.col("a"), F.lit(longest)))).alias("n"))
    strings = spans.select(key, "a", (F.col("a") + F.col("n")).alias("b"), F.expr("substring(unit, a + 1, n)").alias("piece"))
    edge = F.shiftleft("rank", 2 * LENGTH_BITS) + F.shiftleft(F.col("a").cast("long"), LENGTH_BITS) + F.col("b")
    return strings.join(F.broadcast(pieces), "piece").groupBy(key).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _ends(edge: Column) -> tuple[Column, Column]:
    mask = (1 << LENGTH_BITS) - 1
    return F.shiftright(edge, LENGTH_BITS).bitwiseAND(F.lit(mask)).cast("int"), edge.bitwiseAND(F.lit(mask)).cast("int")


def best_merges(n: Column, edges: Column) -> Column:
    """The borders left of a unit of ``n`` characters, as bits, after each step has removed the one inside the best
    edge of two neighbours. A step that finds no edge changes nothing."""
    bit = lambda one, c: F.call_function("shiftleft", F.lit(one).cast("long"), c)

    def masks(e: Column) -> Column:
        a, b = _ends(e)
        return F.struct((bit(1, a) + bit(1, b)).alias("ends"), (bit(1, b) - bit(2, a)).alias("inner"))

    def step(borders: Column, _: Column, masked: Column) -> Column:
        fits = lambda e: ((borders.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(borders.bitwiseAND(e["inner"])) == 1))
        return borders - F.coalesce(borders.bitwiseAND(F.get(F.filter(masked, fits), F.lit(0))["inner"]), F.lit(0))

    # the outer fold, over one element, makes the masks once and not once a step
    fold = lambda masked: F.aggregate(F.sequence(F.lit(1), F.least(n - 1, F.size(edges))), bit(1, n + 1) - 1, lambda s, i: step(s, i, masked))
    return F.aggregate(F.array(F.transform(edges, masks)), F.lit(0).cast("long"), lambda _, masked: fold(masked))


def best_path(n: Column, edges: Column, scores: Column, single: Column) -> Column:
    """Viterbi: the borders of the path with the highest sum of scores, as bits; of equals the one with the later last cut.

    ``scores``: by rank, the score of a piece; ``single``: by place, the score of the character there alone.
    The fold carries the best path to each place: its score and its borders.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: _ends(e)[1] == end)
        path = lambda start, score: F.struct((F.get(best, start)["score"] + score).alias("score"), F.bit_count(bit(start) - 1).alias("last"), F.get(best, start)["borders"].bitwiseOR(bit(end)).alias("borders"))
        long = F.transform(here, lambda e: path(_ends(e)[0], F.get(scores, F.shiftright(e, 2 * LENGTH_BITS).cast("int"))))
        return F.concat(best, F.array(F.array_max(F.concat(long, F.array(path(end - 1, F.get(single, end - 1)))))))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("last"), F.lit(1).cast("long").alias("borders")))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), zero, step), -1)["borders"]


def _answer(path: str, blocks: int, fan: int):
    def run(asked: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or asked["at"].iloc[0] < 0:
            return bundled([], 0, blocks, fan)
        with uncollected():
            pieces, part = pieces_of(path), int(asked["at"].iloc[0])
            questions = [(own, seq, _list(data)) for own, (seq, data) in opened(asked)]
            units = _union([us for _, _, us in questions])
            place = encoded["uid"].to_numpy(np.int64) >> LENGTH_BITS & (1 << PLACE_BITS) - 1
            borders = dict(zip(place.tolist(), encoded["borders"].tolist(), strict=True))
            ids: dict[str, bytes] = {}
            same: dict[str, bool] = {}
            for k, unit in enumerate(units):
                n = len(unit)
                if n > BITS:
                    got = pieces.merged(unit)
                elif (bits := borders.get(k)) is None:
                    got = [x for c in unit for x in pieces.of(c)]
                elif bits == 1 | 1 << n:
                    got = pieces.of(unit)
                else:
                    at = [i for i, c in enumerate(bin(bits)[:1:-1]) if c == "1"]
                    got = [x for a, b in zip(at, at[1:], strict=False) for x in pieces.of(unit[a:b])]
                ids[unit] = np.array(got, "<u4").tobytes()
                same[unit] = pieces.bytes_of(got) == unit.encode()
            z = zstandard.ZstdCompressor(level=1)
            answers = []
            for own, seq, us in questions:
                got = [ids[u] for u in us]
                sizes = np.array([len(g) // 4 for g in got], "<u4").tobytes()
                flat = np.frombuffer(b"".join(got), "<u4")
                # two byte planes: ids below 65,536 have nothing in the third and fourth
                planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
                strange = [k for k, u in enumerate(us) if not same[u]]
                answers.append((own, (seq, z.compress(pickle.dumps((sizes, planes, strange))))))
        return bundled(answers, part, blocks, fan)

    return run


def _encoded(give_ids: bool):
    def run(notes: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(notes) and notes["at"].iloc[0] < 0:
            got = {(p, seq): data for p, (seq, data) in opened(answers)}
            with uncollected():
                for data in notes["data"]:
                    out += _texts(*pickle.loads(data), got, give_ids)
            del got
            let_go()
        columns = list(zip(*out, strict=True)) or [()] * (4 + give_ids)
        made = {"id": exact_ids(list(columns[0])), "n_pieces": pd.Series(columns[1], dtype="int64"), "ids_crc32": pd.Series(columns[2], dtype="int64"), "decoded_equal": pd.Series(columns[3], dtype=bool)}
        return pd.DataFrame(made | ({"ids": pd.Series(columns[4], dtype=object)} if give_ids else {}))

    return run


def _texts(seq: int, order: list[int], ids: list[int | None], strange: list[int], arrays: list[bytes], got: dict, give_ids: bool) -> Iterator[tuple]:
    """The ids of the texts of a block, from its note and the answers to what it asked."""
    z = zstandard.ZstdDecompressor()
    units: list[bytes] = []
    lost: set[int] = set()  # units that decoding does not give back
    for p in order:
        sizes, planes, odd = pickle.loads(z.decompress(got[p, seq]))
        flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).tobytes()
        lost.update(len(units) + k for k in odd)
        at = 0
        for e in (np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)) * 4).tolist():
            units.append(flat[at:e])
            at = e
    lengths, words, counts, parts = (expand(x).astype(np.int64).tolist() for x in arrays)
    whole, at, bad = [], 0, set(strange)
    for n in counts:
        whole.append(units[parts[at]] if n == 1 else b"".join([units[u] for u in parts[at : at + n]]))
        if lost and not lost.isdisjoint(parts[at : at + n]):
            bad.add(len(whole) - 1)
        at += n
    at = 0
    for i, n in zip(ids, lengths, strict=True):
        mine = words[at : at + n]
        at += n
        data = b"".join([whole[w] for w in mine])
        yield (i, len(data) // 4, zlib.crc32(data), not bad or bad.isdisjoint(mine), *([np.frombuffer(data, "<u4").astype(np.int32)] if give_ids else []))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", give_ids: bool = True, block_bytes: int = 8_000_000, fan: int = WIDE) -> DataFrame:
    """Ids of each whole text: id, ``n_pieces``, ``ids_crc32`` (of unsigned 32-bit ids), ``decoded_equal`` and, if asked for, ``ids``."""
    spark = docs.sparkSession
    blocks = block_count(docs, text, block_bytes)
    pieces = Pieces(path)
    best_first = sorted((p for p in pieces.scores if len(p) > 1), key=lambda p: -pieces.scores[p])
    table = spark.createDataFrame([(p, i) for i, p in enumerate(best_first)], "piece string, rank long")
    rows = docs.select(*id_columns(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # one exchange for questions and notes; answers go back to where the note is
    asked = delivered(rows.mapInPandas(_read(path, blocks, block_bytes, fan), BUNDLE), blocks, fan)
    units = asked.groupBy("at").applyInPandas(_different, "uid long, unit string")
    # dealt before their substrings are exploded: the edges are not shuffled
    edges = lattice(units.repartition(max(parallelism(spark), 2 * blocks), "uid"), table, pieces.longest)
    merged = edges.select("uid", best_merges(F.col("uid").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int"), F.col("edges")).alias("borders"))
    merged = merged.withColumn("part", F.shiftright("uid", PLACE_BITS + LENGTH_BITS))
    answers = delivered(asked.groupBy("at").cogroup(merged.groupBy("part")).applyInPandas(_answer(path, blocks, fan), BUNDLE), blocks, fan)
    kind = "id long, n_pieces long, ids_crc32 long, decoded_equal boolean" + (", ids array<int>" if give_ids else "")
    answers = answers.withColumn("at", -1 - F.col("at"))
    out = asked.groupBy("at").cogroup(answers.groupBy("at")).applyInPandas(_encoded(give_ids), kind)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of each id sequence; null stays null."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for pdf in it:
            yield pdf.assign(**{out: [None if x is None else pieces.decode(np.asarray(x)) for x in pdf[ids]]})

    return df.mapInPandas(run, kind)

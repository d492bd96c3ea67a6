"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraph pieces: each line, cut from its start into runs of at most eight
words (so a text without line breaks has pieces too), white space between words as it stands, none
at the ends. Every piece is hashed to a wide vector of 256 signs and to 128 uniform bits; a text's
fingerprint is the sum over its pieces, lane by lane, modulo 2^24 (signs) or 2^32 (uniform words and
the number of pieces). Sums do not depend on order, and pieces can be added or taken away later
(``combine``). The sign lanes make the scalar product of two fingerprints an unbiased estimate of
the product of the two multisets, hence ``likeness``.

Defined cases: null text counts as empty; an empty text has the all-zero fingerprint; two empty
texts have likeness 1, an empty and a non-empty text 0; equal texts have equal fingerprints; rows
with the same id are ordered by their text; rows without id come last in the descending order.
Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm.common import parallelism

PIECE = r"\S++(?:[^\S\n]++\S++){0,7}"
HASHES, LANES, SUMS = 4, 256, 128
LANE_MOD, WORD_MOD = 1 << 24, 1 << 32
PAIR = 0x0000000100000001


def pieces(text: Column) -> Column:
    """The multiset of paragraph pieces of a text, as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def _sums(piece: Column) -> list[Column]:
    """Two sign counters a long: 32 bits apart, so no sum over one text overflows."""
    hashes = [F.xxhash64(piece, F.lit(k)) for k in range(HASHES)]
    out = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR))) for h in hashes for j in range(32)]
    for k in (101, 102):
        h = F.xxhash64(piece, F.lit(k))
        out += [F.sum(h.bitwiseAND(F.lit(WORD_MOD - 1))), F.sum(F.shiftrightunsigned(h, 32))]
    return out


def fingerprint(df: DataFrame, keys: list[str], piece: str) -> DataFrame:
    """One row for each key with ``pieces`` (array of 5 words: count, 128 uniform bits) and ``lanes``.

    ``df`` has one row for each piece; a null piece adds nothing.
    """
    p = F.col(piece)
    known = [F.coalesce(F.when(p.isNotNull(), F.lit(1)), F.lit(0))]
    summed = [s.alias(f"s{i}") for i, s in enumerate(_sums(p))]
    g = df.groupBy(*keys).agg(F.sum(known[0]).alias("n"), F.count(p).alias("present"), *summed)
    none = F.col("present") == 0
    col = lambda i: F.when(none, F.lit(0)).otherwise(F.col(f"s{i}"))
    low = [F.pmod(col(i).bitwiseAND(F.lit(WORD_MOD - 1)), F.lit(LANE_MOD)).cast("int") for i in range(SUMS)]
    high = [F.pmod(F.shiftrightunsigned(col(i), 32), F.lit(LANE_MOD)).cast("int") for i in range(SUMS)]
    words = [F.pmod(F.col("n"), F.lit(WORD_MOD)), *(F.pmod(col(SUMS + i), F.lit(WORD_MOD)) for i in range(4))]
    return g.select(*keys, F.array(*words).alias("words"), F.array(*low, *high).alias("lanes"))


def combine(a_words: Column, a_lanes: Column, b_words: Column, b_lanes: Column, sign: int = 1) -> tuple[Column, Column]:
    """The fingerprint of the union (sign 1) or of what is left after deletion (sign -1)."""
    one = lambda m: lambda x, y: F.pmod(x.cast("long") + F.lit(sign) * y.cast("long"), F.lit(m))
    lanes = F.transform(F.zip_with(a_lanes, b_lanes, one(LANE_MOD)), lambda x: x.cast("int"))
    return F.zip_with(a_words, b_words, one(WORD_MOD)), lanes


def as_text(words: Column, lanes: Column) -> Column:
    """Lowercase hex: five words of 8 digits, then 256 lanes of 6."""
    put = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(put(words, 8), put(lanes, 6))


def signs(words: Column, lanes: Column) -> Column:
    """Each lane as the sum of its signs, in (-2^23, 2^23]."""
    half = LANE_MOD // 2
    return F.transform(lanes, lambda c: (F.pmod(2 * c.cast("long") - words[0] + half, F.lit(LANE_MOD)) - half).cast("double"))


def likeness(a_words: Column, a: Column, b_words: Column, b: Column) -> Column:
    """2<a,b> / (<a,a> + <b,b>) of two sign vectors, held to 0..1; 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) + dot(b, b)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / norm))
    return F.when((a_words == b_words) & (a == b), 1.0).when(norm == 0, 0.0).otherwise(near)


def _buckets(df: DataFrame, key: str, count: int) -> Column:
    """A number that falls as ``key`` rises, in about ``count`` even ranges; a function of the key alone.

    The driver holds at most 256 quantiles; ranges beyond that many are cut evenly.
    """
    leaves = min(count, 256)
    cuts = df.approxQuantile(key, [i / leaves for i in range(leaves + 1)], 0.001) if count > 1 else []
    cuts = sorted({int(c) for c in cuts})
    k, parts = F.col(key), -(-count // leaves)

    def leaf(lo: int, hi: int, at: int) -> Column:
        share = (k - F.lit(lo)).cast("double") / F.lit(float(max(1, hi - lo))) * parts
        return F.lit(at * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share))).cast("int")

    def tree(a: int, b: int) -> Column:
        if b - a <= 1:
            return leaf(cuts[a], cuts[b], a)
        m = (a + b) // 2
        return F.when(k < F.lit(cuts[m]), tree(a, m)).otherwise(tree(m, b))

    found = tree(0, len(cuts) - 1) if len(cuts) > 1 else F.lit(0)
    return F.when(k.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, rn, id, text, next_text``: the text of the next row by descending id, cyclic.

    One shuffle by id range; only the first row of each range crosses ranges.
    """
    # about 8 MB of text a bucket, so that one bucket's rows sort in memory
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    count = max(min(parallelism(docs.sparkSession), 1 + size // 100_000), 1 + size // 16_000_000)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("bucket", _buckets(d, "id", int(count)))
    w = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), F.col("text"))
    inside = d.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("inner_next"))
    # which range comes after which is told from their numbers alone; no text is in that window
    order = Window.orderBy(F.col("b").desc())
    ranges = d.select(F.col("bucket").alias("b")).distinct()
    ranges = ranges.select("b", F.coalesce(F.lead("b").over(order), F.first("b").over(order)).alias("then"))
    heads = inside.filter("rn = 1").select(F.col("bucket").alias("then"), F.col("text").alias("head"))
    after = ranges.join(heads, "then")
    joined = inside.join(after, (inside.bucket == after.b) & inside.inner_next.isNull(), "left")
    return joined.select("bucket", "rn", "id", "text", F.coalesce("inner_next", "head").alias("next_text"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``with_next`` and ``edited``, the text with its last half replaced by the start of the next document."""
    d = with_next(docs, id_col, text)
    kept, put = F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr("substring(next_text, 1, cast(char_length(text) div 2 as int))")
    return d.withColumn("edited", F.concat(kept, put))


def _facts() -> tuple[Column, Column]:
    return F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")


def edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``n_chars`` and ``edited_sha256`` alone."""
    return with_edits(docs, id_col, text).select(F.col("id").alias(id_col), *_facts())


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (its last half replaced by the start of the next
    document) and the likeness to the edited text and to the next document."""
    d = with_edits(docs, id_col, text).select("bucket", "rn", "id", *_facts(), F.array("text", "edited", "next_text").alias("texts"))
    keys = ["bucket", "rn", "id", "n_chars", "edited_sha256"]
    d = d.select(*keys, F.posexplode("texts").alias("which", "one"))
    d = d.select(*keys, "which", F.explode_outer(pieces(F.col("one"))).alias("piece"))
    f = fingerprint(d, [*keys, "which"], "piece")
    pick = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    g = f.groupBy(*keys).agg(*(pick(k, c).alias(f"{c}{k}") for k in range(3) for c in ("words", "lanes")))
    g = g.select("*", *(signs(F.col(f"words{k}"), F.col(f"lanes{k}")).alias(f"v{k}") for k in range(3)))
    near = lambda k: likeness(F.col("words0"), F.col("v0"), F.col(f"words{k}"), F.col(f"v{k}"))
    return g.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        as_text(F.col("words0"), F.col("lanes0")).alias("fingerprint"), as_text(F.col("words1"), F.col("lanes1")).alias("edited_fingerprint"),
        near(1).alias("near_edited"), near(2).alias("near_next"),
    )

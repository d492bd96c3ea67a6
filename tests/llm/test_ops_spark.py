"""The operators over DataFrames: edge rows, brute force, exact results."""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from recordlake.llm import common, components, embeddings, fingerprint, lm, minhash, packing, pii, queries, sentencepieces, suffixes, tokencount, toxicity
from recordlake.llm.common import tokenizer_path
from test_ops_pure import insulted

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, block string"
PASSAGE = "the quick brown fox jumps over the lazy dog and then it runs far away from here"
LONG = " ".join(f"word{i % 7919}" for i in range(30000))
ROWS = [
    (1, f"one {PASSAGE} end"), (2, f"two {PASSAGE}\nlast line of text"), (3, None), (4, ""), (5, " \n\t"), (6, "tiny"), (7, f"one {PASSAGE} end"), (8, LONG), (9, LONG + " tail"),
    (10, "é漢字 🙂 <|endoftext|> don't\x00stop"), (11, "mail bob.01@mail6.example.com or +1 (446) 555-8962"), (12, "a" * 5000), (13, "mail Bob.01@mail6.example.com"), (13, "mail Bob.01@mail6.example.com"), (None, f"no id {PASSAGE}"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, "src", None, "x", "y", "z") for i, t in rows], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_tables_go_with_the_scope_that_needs_them(spark):
    there = lambda df: os.path.isdir(df._recordlake_path.removeprefix("file://"))
    with common.scratch():
        a = common.written(spark.range(3), "a")
        with common.scratch():
            b, c = common.written(a, "b"), common.written(a, "c", keep=True)
            assert there(b) and there(c)
        assert there(a) and there(c) and not there(b) and c.count() == 3
        d = common.written(c, "d", keep=True)
    assert there(d) and not there(a) and not there(c)
    common.forget(d)
    assert not there(d)


def test_messages_reach_their_receivers_over_several_shuffles(spark):
    blocks, fan = 70, 4  # four digits
    send = lambda pdf: common.bundled([(p, (int(b), p)) for b in pdf["id"] for p in range(int(b) % 3, blocks, 3)], int(pdf["id"].iloc[0]), blocks, fan)
    sent = spark.range(blocks).groupBy("id").applyInPandas(send, common.BUNDLE)
    read = lambda pdf: pd.DataFrame([(int(pdf["at"].iloc[0]), b, p) for _, (b, p) in common.opened(pdf)], columns=["at", "b", "p"])
    got = common.delivered(sent, blocks, fan).groupBy("at").applyInPandas(read, "at long, b long, p long").collect()
    assert common.hops(blocks, fan) == 4 and all(r["at"] == r.p for r in got)
    assert sorted((r.b, r.p) for r in got) == [(b, p) for b in range(blocks) for p in range(b % 3, blocks, 3)]


def test_results_do_not_depend_on_the_number_of_blocks(docs):
    """So many blocks that messages take two shuffles."""
    many = 1000  # bytes a block
    assert common.hops(common.block_count(docs, "text", many)) == 2
    path = tokenizer_path("piece_bpe_32k.model")
    ops = [lambda **a: lm.score_texts(docs, toxicity.held_out("doc_id", 1), **a), lambda **a: suffixes.remove_repeats(docs, **a), lambda **a: sentencepieces.encode(docs, path, give_ids=False, **a)]
    for op in ops:
        rows = lambda **a: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in op(**a).collect()), key=repr)  # noqa: B023, E731
        assert rows(block_bytes=many) == rows()


def test_language_model(docs, none):
    held = toxicity.held_out("doc_id", 1)
    got = lm.score_texts(docs, held, block_bytes=100_000).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, pairs = Counter(), Counter()
    for i, t in ROWS:
        if not is_held(i):
            w = tokens(t)
            counts.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(counts.values()), len(counts)
    once = sum(c == 1 for c in counts.values())
    unseen = (once + 0.5) / (n + 1)
    p1 = lambda w: (1 - unseen) * counts[w] / n if counts[w] else unseen
    firsts = sum(not is_held(i) for i, _ in ROWS)
    want = []
    for i, t in ROWS:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10((pairs[h, x] + 4 * p1(x)) / ((firsts if h is None else counts[h]) + 4)) for h, x in zip([None, *w], w, strict=False))
        want.append((i, is_held(i), len(w), sum(counts[x] > 0 for x in w), n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert lm.score_texts(none, held).collect() == []


FAR = [(2**60 + 1, "far one"), (2**60 + 2, "far two"), (None, "far none")]


def test_large_ids_beside_null_ids_stay_exact(spark):
    far = frame(spark, FAR).repartition(1)
    want = {i for i, _ in FAR}
    path = tokenizer_path
    for got in (
        lm.score_texts(far, toxicity.held_out("doc_id", 1)), minhash.near_duplicates(far), suffixes.remove_repeats(far), tokencount.count_tokens(far, path("byte_bpe_50k.tiktoken")),
        sentencepieces.encode(far, path("piece_bpe_32k.model")), pii.surrogate_texts(far, b"k"), packing.pack(far, path("word_bpe_49k.json")), fingerprint.compare_with_next(far),
    ):
        assert {r.doc_id for r in got.collect()} == want
    mails = frame(spark, [(i, f"x.y@mail{k}.org") for k, (i, _) in enumerate(FAR)]).repartition(1)
    assert {r.id for r in pii.entities(mails).collect()} == want


def test_trigram_model(docs):
    got = lm.score_texts(docs, F.lit(False), order=3, k=1.0, block_bytes=50_000).collect()
    again = lm.score_texts(docs, F.lit(False), order=3, k=1.0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    assert [r.score for r in sorted(got, key=key)] == pytest.approx([r.score for r in sorted(again, key=key)])
    assert sum(r.score for r in got) > sum(r.score for r in lm.score_texts(docs, F.lit(False), order=1).collect())


def test_embedding_links(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 6))
    rows = [(int(k), (base[k % 12] + r.normal(size=6) * (0.15 if k % 3 else 0)).tolist(), int(k % 2)) for k in range(240)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * 6, 0), (2002, [float("nan")] + [1.0] * 5, 0), (2003, rows[0][1], None), (2004, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2005, [1.0] * 5, 0), (2006, [2.0] * 5, 0), (None, rows[0][1], 0), (2007, [float("inf")] * 6, 1)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<double>, label int, grp string").repartition(4)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.embedding_links(df, block=40).collect()}
    fine = [(i, np.array(v), k) for i, v, k in rows if i is not None and v is not None and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    near = defaultdict(set)
    for i, a, k in fine:
        for j, b, m in fine:
            if i != j and k == m and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                near[i].add(j)
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        if i is None:
            assert got[i] == (0, None, False)
        else:
            assert got[i] == (len(near[i]), min(reach), i == min(reach))
    assert embeddings.embedding_links(df.limit(0)).collect() == []


def test_embeddings_of_one_cell(spark):
    """All vectors in one cell of the grid and one label: nothing can be skipped, several tiles meet."""
    r = np.random.default_rng(9)
    x = np.ones(8) + r.normal(size=(300, 8)) * 0.2
    got = {v.vec_id: (v.n_links, v.component_id) for v in embeddings.embedding_links(spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ~np.eye(300, dtype=bool)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(near, label[None, :], 300).min(axis=1))
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(300)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 300), (300, 200), (7, 7), (200, 100), (None, 4)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {500 + i: 500 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark, docs, none):
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    by = dict((i, (c, k)) for i, c, k in got)
    assert len(got) == len(ROWS)
    assert by[7] == (1, False) and by[1] == (1, True) and by[4] == (3, False) and by[5] == (3, False) and by[9] == (8, False) and by[None] == (None, True) and by[2] == (2, True)
    assert minhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [4, 64])
def test_near_duplicates_lose_no_link(spark, block):
    """Chains in which the smallest document of a bucket is not similar enough to all others."""
    words = [f"w{i}" for i in range(130)]
    rows = [(k, " ".join([f"x{k}y{j}" if j < 2 * k else w for j, w in enumerate(words)])) for k in range(12)]
    rows += [(100 + k, " ".join(words[:100] + [f"z{k}"])) for k in range(15)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == label


def test_large_buckets_are_divided_by_further_bands(spark):
    """Many texts that share most words but few of which are similar enough, with buckets of more than two as large."""
    r = np.random.default_rng(3)
    common = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(common + [f"p{k // 2}w{i}" for i in range(20)] + [f"own{k}x{i}" for i in range(2)])) for k in range(80)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = {i: min(j for j in sets if similar(i, j)) for i in sets}
    assert len(set(label.values())) == 40 and not similar(0, 2)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2, chunks=1).collect()}
    assert got == label


@pytest.mark.parametrize("weighted", [False, True])
def test_large_buckets_lose_no_similar_pair(spark, weighted):
    """With one band there is no further one that could divide a bucket: similar texts meet by rare shingles."""
    common = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join([*common, *([] if k % 3 else ["again"] * 8), *(f"p{k // 2}w{i}" for i in range(20)), *(f"own{k}x{i}" for i in range(2))])) for k in range(120)]
    sets = {i: Counter(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows}
    sets = sets if weighted else {i: Counter(set(s)) for i, s in sets.items()}
    similar = lambda i, j: (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lambda **a: {x.doc_id: x.class_id for x in minhash.near_duplicates(df, weighted=weighted, bands=1, rows=1, block=2, **a).collect()}
    whole, divided = classes(chunks=1000), classes(chunks=1)
    pairs = [i for i in range(0, 120, 2) if whole[i] == whole[i + 1]]
    assert len(pairs) > 10 and all(divided[i] == divided[i + 1] for i in pairs)
    assert all(c == i or similar(i, c) for i, c in divided.items())


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_sets_share_a_shingle_of_their_prefixes(spark, threshold):
    r = np.random.default_rng(5)
    sets = {}
    for i in range(120):
        near = sets[i - 1] if i % 2 else {}
        sets[i] = {g: near.get(g, float(r.integers(1, 4))) for g in {*list(near)[: int(r.integers(0, 30))], *r.zipf(1.3, 12).clip(0, 999).tolist()}}
    as_bytes = lambda s: (np.array(sorted(s), np.uint64).tobytes(), np.array([s[g] for g in sorted(s)], np.float32).tobytes())
    df = spark.createDataFrame([(i, *as_bytes(s)) for i, s in sets.items()], "id long, s binary, w binary")
    first = defaultdict(set)
    for x in minhash._prefixes(df, threshold).collect():
        first[x.id].add(x.g)
    near = [(i, j) for i in sets for j in range(i) if minhash.jaccard(*as_bytes(sets[i]), *as_bytes(sets[j])) >= threshold]
    assert near and all(first[i] & first[j] for i, j in near)
    assert sum(map(len, first.values())) < sum(map(len, sets.values()))


def test_repeats(docs, none):
    got = {(r.doc_id, r.n_bytes): r for r in suffixes.remove_repeats(docs, give_text=True, block_bytes=100_000).collect()}
    assert len(got) == len(ROWS) - 1
    assert got[7, len(ROWS[0][1])].kept == "" and got[7, len(ROWS[0][1])].n_spans == 1
    # the space before "tail" ends a passage that LONG has, too
    assert got[9, len(LONG) + 5].n_removed == len(LONG) + 1 and got[9, len(LONG) + 5].kept == "tail"
    two = got[2, len(ROWS[1][1])]
    assert two.kept == "two\nlast line of text" or two.kept == "two" + "\nlast line of text"
    assert two.kept_sha256 == hashlib.sha256(two.kept.encode()).hexdigest()
    assert got[None, len(ROWS[-1][1])].n_removed == 0 and got[12, 5000].n_removed == 0 and got[3, 0].n_bytes == 0
    assert suffixes.remove_repeats(none).collect() == []


def test_hundreds_of_blocks_take_one_shuffle(docs, none):
    """A second shuffle writes every message once more; results are the same over several."""
    path = tokenizer_path("piece_bpe_32k.model")
    ops = [lambda **a: lm.score_texts(docs, toxicity.held_out("doc_id", 1), **a), lambda **a: suffixes.remove_repeats(docs, **a), lambda **a: sentencepieces.encode(docs, path, give_ids=False, **a)]
    assert common.block_count(docs, "text", 1000) > 256
    for op in ops:
        carried = lambda **a: "floor" in op(**a)._jdf.queryExecution().executedPlan().toString().lower()  # noqa: B023, E731
        assert carried(block_bytes=1000, fan=256) and not carried(block_bytes=1000)
        rows = lambda **a: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in op(**a).collect()), key=repr)  # noqa: B023, E731
        assert rows(block_bytes=60_000, fan=3) == rows()


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(docs, none, rule):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoding, _ = tokencount.load_encoding(path)
    rows = tokencount.count_tokens(docs, path, rule=rule).collect()
    sums, totals = defaultdict(float), {}
    for r in rows:
        sums[r.doc_id] += r.n_tokens
        totals[r.doc_id] = r.doc_tokens
    want = {i: len(encoding.encode_ordinary(t or "")) for i, t in ROWS}
    assert totals == want and all(sums[i] == pytest.approx(n * (2 if i == 13 else 1)) for i, n in want.items())
    both = tokencount.count_tokens(docs.filter("doc_id = 6"), path, fields=["text", "source"]).collect()
    assert [(r.field, r.end_char) for r in both] == [("text", 4), ("source", 3)]
    assert tokencount.count_tokens(none, path).collect() == []
    with pytest.raises(ValueError):
        tokencount.count_tokens(none, path, rule="other")


def test_sentencepieces(docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepieces.encode(docs, path, block_bytes=100_000)
    got = encoded.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, library.encode(t or "")) for i, t in ROWS]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.decoded_equal and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    texts = {r.doc_id: r.text for r in sentencepieces.decode(encoded.select("doc_id", "ids"), path).collect()}
    assert all(texts[i] == (t or "") for i, t in ROWS)
    assert sentencepieces.encode(none, path).collect() == []
    # the sign that stands for a space does not come back
    odd = frame(docs.sparkSession, [(1, "a\u2581b"), (2, "a b"), (3, "x \u2581"), (4, "\u2581")])
    for r in sentencepieces.encode(odd, path).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == library.encode(r.text) and r.decoded_equal == (library.decode(r.ids) == r.text)


def test_viterbi_on_the_lattice_equals_brute_force(spark):
    """The fold for models of unigram type: the path with the highest sum of scores."""
    r = np.random.default_rng(7)
    pieces = {"".join(r.choice(list("abc"), k)): float(r.normal() - 3) for k in (2, 2, 2, 3, 3, 3, 4, 4) for _ in range(4)}
    alone = {c: float(r.normal() - 4) for c in "abc"}
    ranks = sorted(pieces)
    texts = sorted({"".join(r.choice(list("abc"), n)) for n in range(2, 11) for _ in range(6)})

    def best(text):
        if not text:
            return 0.0
        return max(s + best(text[len(p) :]) for p, s in (pieces | alone).items() if text.startswith(p))

    units = spark.createDataFrame(list(enumerate(texts)), "uid long, unit string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(ranks)], "piece string, rank long")
    edges = units.join(sentencepieces.lattice(units, table, 4), "uid", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<bigint>")))
    single = F.transform(F.split("unit", ""), lambda c: F.element_at(F.create_map(*(F.lit(x) for pair in alone.items() for x in pair)), c))
    scores = F.array(*(F.lit(pieces[p]) for p in ranks))
    for row in edges.select("unit", sentencepieces.best_path(F.char_length("unit"), F.col("edges"), scores, single).alias("borders")).collect():
        at = [i for i in range(len(row.unit) + 1) if row.borders >> i & 1]
        assert at[0] == 0 and at[-1] == len(row.unit)
        assert sum((pieces | alone)[row.unit[a:b]] for a, b in zip(at, at[1:], strict=False)) == pytest.approx(best(row.unit))


def test_surrogates(spark, docs, none):
    got = pii.surrogate_texts(docs, b"key")
    assert got.columns == [*docs.columns, "n_entities"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text is None and by[4].text == "" and by[8].text == LONG and by[8].n_chars is None and by[6].block == "z"
    assert by[11].n_entities == 2 and "bob.01" not in by[11].text and "555-8962" not in by[11].text
    assert by[13].text.lower().split()[1] == by[11].text.split()[1]  # one entity, one surrogate
    assert pii.surrogate_texts(none, b"key").collect() == []


def test_surrogates_of_many_names_stay_apart(spark):
    names = [f"Mr {a}{b}son" for a in "Abcdefghij".upper() for b in ("ar", "el", "in", "or", "un", "yr")]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "doc_id long, text string")
    made = [r.text for r in pii.surrogate_texts(df, b"key").collect()]
    assert len(set(made)) == len(names) and not set(made) & set(names)


def test_surrogates_without_ids_stay_apart(spark):
    names = [f"Mr {a}{b}son" for a in "ABCDEFGHIJ" for b in ("ar", "el", "in", "or", "un", "yr")]
    df = spark.createDataFrame([(None, n) for n in names], "doc_id long, text string")
    made = [r.text for r in pii.surrogate_texts(df, b"key").collect()]
    assert len(set(made)) == len(names) == 60 and not set(made) & set(names)


def test_one_person_under_several_titles(spark):
    rows = [(1, "Dr Kim Lee met Ms Kim Lee", 5, "x"), (2, "Prof Kim Lee", 6, "y"), (2, "Prof Kim Lee", 6, "y"), (None, "Kim. Frau Kim Lee", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, changes string")
    got = pii.surrogate_texts(df, b"key")
    assert got.columns == ["doc_id", "text", "changes", "n_entities"]
    texts = sorted(r.text for r in got.collect())
    assert len(texts) == 4
    dr = next(t for t in texts if t.startswith("Dr")).split()
    assert dr[1:3] == dr[5:7] and pii.TOLD[dr[1].lower()] == "f"
    assert f"Prof {dr[1]} {dr[2]}" in texts and f"{dr[1]}. Frau {dr[1]} {dr[2]}" in texts
    with pytest.raises(ValueError):
        pii.surrogate_texts(df, b"")


def test_assignments_equal_a_plain_version(spark):
    """Attempts one round after the other over all entities, in plain Python."""
    mails = [f"{a}{b}@x.org" for a in "abc" for b in "0123456789"] + [f"{c}@x.org" for c in "abcdefghijklm"]
    people = [("given-latin", n, g) for n, g in [("kim", "f"), ("lee", "m"), ("sam", "u"), ("anna", "f"), ("adam", "m")]] + [("family-latin", f"nm{k}", "u") for k in range(40)]
    every = [("email", m, "u") for m in mails] + people
    got = {(r.kind, r.norm): (r.made, r.attempt) for r in pii.assignments(spark.createDataFrame(every + every, "kind string, norm string, gender string"), b"key").collect()}
    s, settled, todo = pii.Surrogates(b"key"), {}, {(k, n): (g, 0) for k, n, g in every}
    while todo:
        taken = {(k, m) for (k, _), (m, _) in settled.items()} | {(k, n) for k, n, _ in every}
        owner = {}
        for (k, n), (g, a) in sorted(todo.items()):
            made = s.of(k, n, a)
            if (k, made) not in taken and ("u" in (g, s.gender(k, made)) or g == s.gender(k, made)):
                owner.setdefault((k, made), n)
        for (k, made), n in owner.items():
            settled[k, n] = made, todo.pop((k, n))[1]
        todo = {x: (g, a + 1) for x, (g, a) in todo.items()}
    assert got == settled


def test_surrogates_of_a_full_shape_stay_apart(spark):
    names = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(k, f"to {n}") for k, n in enumerate(names)], "doc_id long, text string")
    made = [r.text.split()[1] for r in pii.surrogate_texts(df, b"key").collect()]
    assert len(set(made)) == len(names) and not set(made) & set(names)
    assert all(len(pii.detect(m)) == 1 for m in made)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in ROWS:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(by[i], key=lambda r: (r.start, r.sequence_id))[:: 2 if i == 13 else 1]
        assert [r.start for r in mine] == list(range(0, len(ids), 64)) and all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(none, path).collect() == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (6, 1, 0), (8, 0, 1), (11, None, 0), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ROWS}
    assert toxicity.toxicity(none, labels).collect() == []
    assert [r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()] == [0.0] * len(ROWS)


def test_toxicity_trains_on_whole_texts(spark):
    plain = "plain words " * 1500
    df = spark.createDataFrame([(k, f"{plain}{'vulgarity' if k % 2 else 'quiet'} {k}") for k in range(100)], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int"))
    assert all(b"vulgarity" in d for d in model.toxic) and b"vulgarity" not in model.ordinary


def test_toxicity_of_rows_held_out(spark):
    bad, clean = insulted(700, 5, 0.5)
    texts = [(k, t, k < len(bad)) for k, t in enumerate(bad + clean)]
    df = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in texts] + [(100_000 + k, k % 2) for k in range(50)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).filter("held_out").collect()}
    a, b = (np.array([r.score for r in got.values() if texts[r.doc_id][2] == y]) for y in (True, False))
    assert len(a) + len(b) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k, _, _ in texts)
    assert (a[:, None] > b[None, :]).mean() > 0.95


def test_fingerprints(spark, docs, none):
    rows = [(i, t) for i, t in ROWS if i != 13]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(docs.filter("doc_id IS NULL OR doc_id <> 13")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[7].fingerprint != got[2].fingerprint and got[3].fingerprint == got[4].fingerprint
    assert got[9].near_next > 0.95 and got[8].near_edited > 0.4 > got[8].near_next
    assert fingerprint.compare_with_next(none).collect() == []


def plain_fingerprint(text):
    """Word by word and lane by lane."""
    pieces = re.findall(fingerprint.PIECE, text, re.ASCII)
    hashed = lambda p, k: xxhash.xxh64_intdigest(struct.pack("<i", k), seed=xxhash.xxh64_intdigest(p.encode(), seed=42))
    low, high, words = [0] * 128, [0] * 128, [len(pieces) % 2**32, 0, 0, 0, 0]
    for p in pieces:
        for k in range(4):
            h = hashed(p, k)
            for j in range(32):
                low[32 * k + j] += h >> j & 1
                high[32 * k + j] += h >> (32 + j) & 1
        for n, k in enumerate((101, 102)):
            words[1 + 2 * n] += hashed(p, k) & 2**32 - 1
            words[2 + 2 * n] += hashed(p, k) >> 32
    lanes = [x % 2**24 for x in low + high]
    signs = [2 * x - len(pieces) for x in low + high]
    return "".join(f"{x % 2**32:08x}" for x in words) + "".join(f"{x:06x}" for x in lanes), signs


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y = np.array(a[1], float), np.array(b[1], float)
    norm = x @ x + y @ y
    return max(0.0, min(1.0, 2 * (x @ y) / norm)) if norm else 0.0


def test_fingerprints_equal_a_plain_version(spark):
    texts = {1: "one two three\nfour  five\tsix seven eight nine ten eleven", 2: "one two three\nfour", 3: "", 4: " \n ", 5: "é漢 🙂\n" * 40, 6: PASSAGE, 7: PASSAGE + "\nmore", 8: None, 9: LONG}
    got = {r.doc_id: r for r in fingerprint.compare_with_next(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = map(plain_fingerprint, (t, edited, after))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], changed[0])
        assert r.near_edited == pytest.approx(plain_likeness(own, changed)) and r.near_next == pytest.approx(plain_likeness(own, following))


def test_queries_equal_their_sql(spark):
    """Whole registered queries that SQL can express, on the small tables."""
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("lm_token_counts", "fingerprint_edits", "op2_embedding_links"):
        df = queries.QUERIES[name](spark, data)
        want = c.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_fingerprints_add_up(spark):
    one = lambda t, k: spark.createDataFrame([(k, t)], "k int, t string").select("k", F.explode(fingerprint.pieces(F.col("t"))).alias("p"))
    a, b, both = "first line\nsecond line", "third\nfourth", "fourth\nsecond line\nthird\nfirst line"
    f = lambda t: fingerprint.fingerprint(one(t, 1), ["k"], "p")
    x, y, z = f(a).toDF("k", "xw", "xl"), f(b).toDF("k", "yw", "yl"), f(both).toDF("k", "zw", "zl")
    joined = x.join(y, "k").join(z, "k")
    plus = fingerprint.combine(F.col("xw"), F.col("xl"), F.col("yw"), F.col("yl"))
    minus = fingerprint.combine(F.col("zw"), F.col("zl"), F.col("yw"), F.col("yl"), -1)
    r = joined.select((plus[0] == F.col("zw")).alias("a"), (plus[1] == F.col("zl")).alias("b"), (minus[0] == F.col("xw")).alias("c"), (minus[1] == F.col("xl")).alias("d")).first()
    assert tuple(r) == (True,) * 4

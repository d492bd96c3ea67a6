"""The pipeline against a plain version of each stage."""

from __future__ import annotations

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline goes with the training-data package")

from recordlake.llm import minhash, pii, suffixes, toxicity  # noqa: E402
from recordlake.llm.common import tokenizer_path  # noqa: E402
from recordlake.llm.queries import PUBLIC_KEY  # noqa: E402


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choices(["ti", "on", "er", "an", "re", "st", "th", "in", "ou", "ea"], k=r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    docs, labels = [], []
    for i in range(160):
        t = text(r.randrange(30, 120))
        if i % 4 == 0:
            words = t.split()
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["vulgar", "swine", "crook"])
            t = " ".join(words)
        labels.append((i, 1, int(i % 4 == 0)))
        docs.append((i, t))
    docs += [(200, passage + " " + text(30)), (201, text(30) + " " + passage), (202, docs[1][1]), (203, docs[2][1] + " tail"), (204, "mail ab.12@mail3.example.com " + text(20)), (205, None), (206, "")]
    return docs, labels


def plain(docs, labels):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    text = dict(docs)
    train = [[(text[i] or "") for i, _, y in labels if y == k and not held(i)] for k in (1, 0)]
    score = toxicity.Scorer(toxicity.fit(*train))
    docs = [(i, t) for i, t in docs if score(t or "") < 0.5]
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])]
    for _ in links:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = [(i, t) for i, t in docs if label[i] == i]
    seen: dict[bytes, int] = {}
    kept = []
    for i, t in sorted(docs):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 49):
            gone[j : j + 50] |= data[j : j + 50] in seen
        for j in range(len(data) - 49):
            seen.setdefault(data[j : j + 50], i)
        kept.append((i, np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    s = pii.Surrogates(PUBLIC_KEY.encode())
    return [(i, pii.replace(t, pii.detect(t), s, {})) for i, t in kept]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = corpus()
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = plain(docs, labels)
    assert len(want) < len(docs)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == {i for i, _ in want}
    for i, t in want:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)


def test_run_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS


def test_repeats_of_hundreds_of_blocks_take_one_shuffle(spark, monkeypatch):
    """What the third stage writes to disk does not double from 257 blocks on."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in corpus()[0][:20]], "doc_id long, text string, lang string, source string, n_chars long")
    exchanges = lambda: corpus_pipeline.cut_repeats(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    few = exchanges()
    monkeypatch.setattr(suffixes, "block_count", lambda *_: 1700)
    assert exchanges() == few > 0


def test_near_duplicates_of_large_buckets_go(spark, monkeypatch):
    """All texts in few buckets, which no further band divides."""
    common = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(common + [f"p{k // 2}w{i}" for i in range(20)] + [f"own{k}x{i}" for i in range(2)])) for k in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found, near_duplicates = {}, minhash.near_duplicates
    for chunks in (1000, 1):
        monkeypatch.setattr(minhash, "near_duplicates", functools.partial(near_duplicates, bands=1, rows=1, block=2, chunks=chunks))
        found[chunks] = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert len(found[1000]) < 95 and found[1] <= found[1000] and found[1] >= set(range(0, 100, 2))

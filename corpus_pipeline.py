"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Toxic documents go; one document of each near-duplicate group stays; repeated passages go from all but
the first document; personal data get surrogates; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlake.llm import minhash, packing, pii, suffixes, toxicity
from recordlake.llm.common import forget, modest_batches, scratch, table, tokenizer_path, written
from recordlake.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold, as they are."""
    modest_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; repeated rows once; documents without id stay."""
    modest_batches(spark)
    keep = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")
    found = docs.join(keep, "doc_id", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return found.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start in a document with a smaller id."""
    modest_batches(spark)
    found = suffixes.remove_repeats(docs, give_text=True, carry=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    modest_batches(spark)
    found = pii.surrogate_texts(docs.select(*COLUMNS), pii_key(spark))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    modest_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again, what it needed on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            later = written(stage(spark, docs, sf_dir), name, keep=True)
        forget(docs)
        docs = later
    return docs


#: models and surrogates are beyond SQL; tests hold run() against a plain version
ORACLE_SQL = None

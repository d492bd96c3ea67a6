"""Token counts by section, from one encoding of the whole document.

The fields of a document are joined to one text, encoded once; the lengths of the tokens' bytes give each
token's span. Sections are the lines of each field (with their line break).
Tokens meet sections in an interval join on sorted borders. A token inside one section counts there; one
that crosses borders is allocated by an explicit rule: ``"most"`` (the section with most of its bytes, the
earlier one if equal), ``"start"`` (where its first byte is) or ``"split"`` (each section gets its share of
bytes). Whatever the rule, a document's counts add up to its tokens.

Defined cases: null fields count as empty; an empty document has one empty section with no tokens; rows
with equal ids and null ids are counted each for itself; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import exact_ids, known_ids

RULES = ("most", "start", "split")


def load_encoding(path: str):
    """The byte-level BPE of a rank file, and the byte length of each token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("whole documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(borders: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and border-crossing tokens for each section.

    ``borders``: bytes where sections begin, and the end of the last; ``ends``: bytes where tokens end.
    """
    n = len(borders) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
    # empty sections hold no byte: the last section that begins at or before a byte has it
    first = np.searchsorted(borders[:-1], starts, side="right") - 1
    last = np.searchsorted(borders[:-1], ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    if rule == "start" or not len(crossing):
        count = np.bincount(first, minlength=n).astype(float)
        return count, np.bincount(first[crossing], minlength=n)
    count = np.bincount(np.delete(first, crossing), minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    for t in crossing:
        at = np.arange(first[t], last[t] + 1)
        share = np.minimum(borders[at + 1], ends[t]) - np.maximum(borders[at], starts[t])
        if rule == "split":
            count[at] += share / share.sum()
            crossed[at] += share > 0
        else:
            count[at[share.argmax()]] += 1
            crossed[at[share.argmax()]] += 1
    return count, crossed


def _lines(field: str) -> list[str]:
    """Lines with their line feed; an empty field is one empty line."""
    parts = field.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", fields: list[str] | None = None, rule: str = "most") -> DataFrame:
    """One row a section: id, ``field``, ``section``, ``start_char``, ``end_char`` in the field, ``n_tokens``, ``n_crossing``, ``doc_tokens``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = fields or ["text"]
    kind = dict(docs.select(id_col).dtypes)[id_col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")  # pandas keeps whole numbers exact only where none is null
    taken = docs.select(F.col(id_col).isNotNull().alias("known"), (F.coalesce(F.col(id_col), F.lit(0)) if whole else F.col(id_col)).alias("id"), *(F.coalesce(F.col(f), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = load_encoding(path)
        for pdf in it:
            out = []
            ids = known_ids(pdf)
            for doc, row in zip(ids, pdf.drop(columns="known").itertuples(index=False), strict=True):
                pieces = [(name, k, line) for name, text in zip(fields, row[1:], strict=True) for k, line in enumerate(_lines(text))]
                whole = "\n".join(row[1:])
                sizes = np.array([len(line.encode()) for _, _, line in pieces], np.int64)
                if len(fields) > 1:  # the line feed between fields belongs to the field before it
                    for i in range(len(pieces) - 1):
                        sizes[i] += pieces[i + 1][1] == 0
                tokens = encoding.encode_ordinary(whole)
                ends = np.cumsum(lengths[np.array(tokens, np.int64)])
                count, crossed = attribute(np.concatenate([[0], np.cumsum(sizes)]), ends, rule)
                at = 0
                for (name, k, line), n, c in zip(pieces, count.tolist(), crossed.tolist(), strict=True):
                    at = 0 if k == 0 else at
                    out.append((doc, name, k, at, at + len(line), n, c, len(tokens)))
                    at += len(line)
            made = pd.DataFrame(out, columns=["id", "field", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"], dtype=object)
            yield made.assign(id=exact_ids(made["id"].tolist())) if whole else made

    got = taken.mapInPandas(run, f"id {kind}, field string, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")
    return got.withColumnRenamed("id", id_col) if rule == "split" else got.withColumn("n_tokens", F.col("n_tokens").cast("long")).withColumnRenamed("id", id_col)

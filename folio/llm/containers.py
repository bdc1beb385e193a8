"""Problem 8: filling containers of fixed capacity with texts, balanced by attention cost.

Texts are measured in tokens of a public tokenizer (files outside the repository; their folder is a
parameter). A text above the capacity is cut into full parts and a rest; every other one stays
whole. An item's cost is linear plus quadratic in its length. Items go in falling order, each to
the sequence of lowest cost that has room for it; as many sequences are opened as the tokens need,
and one more whenever an item fits nowhere.

At scale, items are dealt by hash into groups of about GROUP items, each packed on its own: a task
holds one group, never the collection, and what a group leaves open is at most its last few
containers.

Defined cases: a null text is left out; an empty one is an item of no tokens; ties go by key and
part; repeated rows count once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import written

CAPACITY = 2048
GROUP = 20_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
TOKENIZERS = os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE of this kind splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_held: dict[str, object] = {}


def encoder(folder: str, name: str):
    """The tokenizer of a file, loaded once per process."""
    path = os.path.join(folder, name)
    if path not in _held:
        if name.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _held[path] = lambda t: len(e.encode_ordinary(t))
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _held[path] = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _held[path] = lambda t: len(sp.encode(t, num_threads=1))
    return _held[path]


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, tokens) of every text that is not null."""
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = encoder(folder, name)
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": [size(t) for t in b[text]]})

    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(count, f"{key} {kind}, tokens long")


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The container of each size (sizes fall): the one of lowest cost with room."""
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = np.full(n, capacity, "i8"), np.zeros(n)
    out = np.empty(len(sizes), "i8")
    for i, s in enumerate(sizes):
        c = np.where(room >= s, cost, np.inf)
        at = int(c.argmin())
        if c[at] == np.inf:
            room, cost, at = np.append(room, capacity), np.append(cost, 0.0), len(room)
        room[at] -= s
        cost[at] += linear * s + quadratic * s * s
        out[i] = at
    return out


def pack_texts(
    df: DataFrame, key: str, text: str, capacity: int = CAPACITY, folder: str = TOKENIZERS, name: str = VOCABULARY, group: int = GROUP
) -> DataFrame:
    """(key, parte, inicio, tokens, recipiente, custo): where each text, or each part of one above the
    capacity (its tokens from `inicio` on), goes; custo is its share of the sequence's cost."""
    sizes = written(token_counts(df, key, text, folder, name).distinct(), "tokens")
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("long")
    items = sizes.select(key, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("parte")).select(
        key, "parte", F.least(F.col("tokens") - F.col("parte") * capacity, F.lit(capacity)).alias("tokens")
    )
    total = sizes.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, round(total / group))
    kind = dict(df.dtypes)[key]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", key, "parte"], ascending=[False, True, True], kind="stable")
        t = pdf.tokens.to_numpy("i8")
        at = pack(t, capacity)
        return pd.DataFrame(
            {
                key: pdf[key],
                "parte": pdf.parte,
                "inicio": pdf.parte * capacity,
                "tokens": t,
                "recipiente": pdf.g.iloc[0].astype(str) + "-" + pd.Series(at, index=pdf.index).astype(str),
                "custo": LINEAR * t + QUADRATIC * t * t,
            }
        )

    dealt = items.withColumn("g", F.pmod(F.xxhash64(key, "parte"), F.lit(groups)).cast("int"))
    # a stated number of partitions, so that small groups are not put into one task
    return dealt.repartition(groups, "g").groupBy("g").applyInPandas(fill, f"{key} {kind}, parte long, inicio long, tokens long, recipiente string, custo double")

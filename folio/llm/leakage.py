"""Problem 9: passages of evaluation items inside corpus documents, by windowed MinHash containment.

A passage is `words` consecutive words. Both sides are cut into all their windows of that many
words, so that the sets compared have one size (a whole-text signature loses a passage of 13 words
in a document of 5,000). A window's MinHash is the least hash among its word n-grams (n = GRAM);
equal windows have equal MinHashes, so a window of a document can only equal a window of an item
under the same MinHash: no leak is missed. Texts with fewer words than a passage form the one size
class that cannot leak and are left out. Hits are then verified by exact containment of the
passage, word by word.

The items (held-out tests: small beside the corpus) are indexed in blocks of at most BLOCK_WORDS
words, each of which is broadcast; more items mean more passes over the corpus, not a larger
broadcast. Documents are read once per block and nothing of them is shuffled but the pairs found.

Defined cases: null, empty or short texts leak nothing; repeated rows count once; a document that
repeats a passage gives one row per item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 13
GRAM = 8
BLOCK_WORDS = 4_000_000  # of items indexed at a time: about 40 MB in each Python worker
WORD = re.compile("[a-z0-9]+")
MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0670\u06d6-\u06dc\u093c\u094d\u0e31\u0e34-\u0e3a\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of a-z and 0-9 after NFKD, without combining marks, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = MARK.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 500)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive values."""
    out = np.zeros(max(0, len(h) - n + 1), "u8")
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def window_minima(h: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of the least n-gram, its hash), once for each distinct place that is the MinHash of some window."""
    g = rolling(h, gram)
    span = passage - gram + 1
    if len(g) < span:
        return np.zeros(0, int), np.zeros(0, "u8")
    windows = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.unique(windows.argmin(1) + np.arange(len(windows)))
    return at, g[at]


def build_index(items: pd.DataFrame, passage: int, gram: int) -> tuple:
    """(item ids, their words as numbers, MinHashes sorted, item of each, place of each, number of each word)."""
    ids, texts, keys, who, where, numbers = [], [], [], [], [], {}
    for i, text in zip(items.iloc[:, 0], items.iloc[:, 1]):
        w = words_of(text)
        if len(w) < passage:
            continue
        at, g = window_minima(word_hashes(w), passage, gram)
        keys.append(g)
        who.append(np.full(len(at), len(ids), "i4"))
        where.append(at.astype("i4"))
        ids.append(i)
        texts.append(np.array([numbers.setdefault(x, len(numbers)) for x in w], "i4"))
    if not ids:
        return [], [], np.zeros(0, "u8"), np.zeros(0, "i4"), np.zeros(0, "i4"), {}
    k, a, b = np.concatenate(keys), np.concatenate(who), np.concatenate(where)
    order = k.argsort(kind="stable")
    return ids, texts, k[order], a[order], b[order], numbers


def contains(doc: np.ndarray, i: int, item: np.ndarray, j: int, passage: int, gram: int) -> bool:
    """Whether a run of `passage` equal words holds the n-grams at i and j: the exact check."""
    if (doc[i : i + gram] != item[j : j + gram]).any():
        return False
    left, most = 0, passage - gram
    while left < most and i > left and j > left and doc[i - left - 1] == item[j - left - 1]:
        left += 1
    right = gram
    while right + left < passage and i + right < len(doc) and j + right < len(item) and doc[i + right] == item[j + right]:
        right += 1
    return left + right >= passage


def leaked_in(text: str | None, index: tuple, passage: int, gram: int) -> list:
    """The items with a passage in the text."""
    ids, texts, keys, who, where, numbers = index
    w = words_of(text)
    if len(w) < passage or not len(keys):
        return []
    at, g = window_minima(word_hashes(w), passage, gram)
    lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
    found: set[int] = set()
    hit = np.flatnonzero(hi > lo)
    if len(hit):
        w = np.array([numbers.get(x, -1) for x in w], "i4")
    for x in hit:
        for y in range(lo[x], hi[x]):
            i = int(who[y])
            if i not in found and contains(w, int(at[x]), texts[i], int(where[y]), passage, gram):
                found.add(i)
    return [ids[i] for i in found]


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", passage: int = PASSAGE, gram: int = GRAM
) -> DataFrame:
    """(doc, item): every document that holds a passage of the item."""
    spark = documents.sparkSession
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t")).distinct()
    # runs of letters and digits, and one more word for each character outside ASCII that may cut one
    bound = F.size(F.split("t", r"[^\p{L}\p{N}]+")) + F.length(F.regexp_replace("t", r"[\x00-\x7f]", ""))
    size = rows.agg(F.sum(bound)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    kinds = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
    texts = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def one(block: int) -> DataFrame:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(build_index(part.toPandas(), passage, gram))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = held.value
            for b in batches:
                hits = [(d, i) for d, t in zip(b.d, b.t) for i in leaked_in(t, index, passage, gram)]
                if hits:
                    yield pd.DataFrame(hits, columns=["d", "i"])

        return texts.mapInPandas(scan, f"d {kinds[0]}, i {kinds[1]}")

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    return found.distinct().withColumnsRenamed({"d": doc, "i": item})

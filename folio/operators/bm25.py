"""Inverted index, its statistics and BM25 with statistics that no filter changes.

All functions take postings (term, doc_ord, tf). A batch of queries is (q, pos, term), one row per
query token, so that a repeated token counts again. Shares are summed as whole multiples of 1e-12:
such a sum is the same in any order, so equal pieces tie exactly and sums combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.config import B, DEPTH, K1
from folio.functions.tokens import tokens
from folio.operators.best import CELLS, Best
from folio.session import written

FIXED = 1e12
TIE = 1000  # of those units: scores that agree to 9 digits tie
BROADCAST_ROWS = 200_000  # query terms up to which the query side is broadcast
SENT = 1 << 18  # scores that go to Spark in one batch
FEW = 64  # products of a term (queries by pieces) up to which terms are worked off together
VALID = "term is not null and term <> '' and doc_ord is not null and tf > 0"


def build_postings(pieces: DataFrame, key: str = "ord", text: str = "texto") -> DataFrame:
    """(term, doc_ord, tf) of every piece; a null or empty text gives none."""
    words = pieces.select(F.col(key).alias("doc_ord"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "doc_ord").agg(F.count("*").cast("int").alias("tf"))


def valid_postings(postings: DataFrame) -> DataFrame:
    """The rows that count, once each; they lie by piece, so that what follows per piece needs no further shuffle."""
    return postings.where(VALID).select("term", "doc_ord", "tf").repartition("doc_ord").distinct()


def doc_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_ord").agg(F.sum("tf").cast("long").alias("dl"))


def doc_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("occurrences"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl); avgdl is 1 where there is nothing to average."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def idf_value(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); stats is the single row of corpus_stats."""
    return frequencies.join(F.broadcast(stats)).select("term", "df", idf_value(F.col("n"), F.col("df")).alias("idf"))


def filed(postings: DataFrame, names: DataFrame | None = None, by: str = "doc_ord") -> DataFrame:
    """(doc_ord, dl, t, f, keys): the pieces with their terms and frequencies as lists, and what they are returned as.

    The postings are shuffled once, and the result is written: statistics and scores then come from it without a shuffle.
    names: (doc_ord, by) of the pieces that may be returned; the others have null keys.
    """
    docs = postings.groupBy("doc_ord").agg(F.sum("tf").cast("double").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("x"))
    if names is None:
        docs = docs.withColumn("keys", F.array("doc_ord"))
    else:
        docs = docs.join(names.groupBy("doc_ord").agg(F.collect_set(by).alias("keys")), "doc_ord", "left")
    return written(docs.select("doc_ord", "dl", F.col("x.term").alias("t"), F.col("x.tf").alias("f"), "keys"), "docs")


def returned(docs: DataFrame) -> DataFrame:
    """(key, dl, t, f) of the filed pieces that may be returned."""
    return docs.select(F.explode("keys").alias("key"), "dl", "t", "f").where("key is not null")


def _block(docs: DataFrame, asked: DataFrame, n: int) -> tuple:
    """What a task needs of a block of queries: ids, terms, their idf, and (code of term, place of id, times) sorted by term."""
    rows = asked.toArrow()
    q, t = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("q", "term"))
    terms = t.dictionary
    found = docs.select(F.explode("t").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df")).toPandas().set_index("term").df
    df = df.reindex(terms.to_pylist()).fillna(0).to_numpy("f8")
    code, at, times = t.indices.to_numpy(), q.indices.to_numpy(), rows["times"].to_numpy().astype("i8")
    order = np.argsort(code, kind="stable")
    return q.dictionary, terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), code[order].astype("i4"), at[order].astype("i4"), times[order]


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("term is not null").groupBy("q", "term").agg(F.count("*").alias("times"))


def _parts(d: pa.RecordBatch, terms: pa.Array, idf: np.ndarray, avgdl: float, k1: float, b: float) -> tuple:
    """(code of term, place of piece, part) of the postings of known terms in a batch of filed pieces, sorted by term."""
    dt = pc.fill_null(pc.index_in(d.column("t").flatten(), value_set=terms), -1).to_numpy()
    known = np.flatnonzero(dt >= 0)
    known = known[np.argsort(dt[known], kind="stable")]
    di = np.repeat(np.arange(d.num_rows), pc.list_value_length(d.column("t")).to_numpy())[known]
    dt, tf, dl = dt[known], d.column("f").flatten().to_numpy()[known].astype("f8"), d.column("dl").to_numpy()[di]
    return dt, di, half_away(idf[dt] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) * FIXED).astype("i8")


def half_away(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero: as round() of SQL."""
    whole = np.trunc(x)
    return whole + np.copysign(np.abs(x - whole) >= 0.5, x)


def bm25_scores(
    postings: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, mask: DataFrame | None = None, digits: int | None = None
) -> DataFrame:
    """(q, doc_ord, score) of every matching piece; unmatched pieces score 0 and are not listed.

    mask: a DataFrame of doc_ord that may be returned. It is applied after scoring and changes no score.
    digits: those that scores are rounded to, as SQL rounds them.
    The result has about a row for each query and piece; a join makes one for each of their common terms, and its
    sums spill. Here a task adds up a matrix of queries by pieces (CELLS at a time) and passes its cells on: what
    is shuffled is the postings, once. Queries are sent out in blocks of about BROADCAST_ROWS terms.
    """
    docs, asked = filed(postings, mask), _asked(queries)
    n, avgdl = corpus_stats(docs).first()
    kinds = dict(queries.dtypes)["q"], dict(postings.dtypes)["doc_ord"]
    blocks = max(1, -(-asked.count() // BROADCAST_ROWS))

    def one(block: int) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(_block(docs, asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block), n))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, terms, idf, *q = held.value
            step = max(1, CELLS // max(1, len(ids)))
            for whole in batches:
                for i in range(0, whole.num_rows if len(ids) else 0, step):
                    d = whole.slice(i, step)
                    dt, di, dv = _parts(d, terms, idf, avgdl, k1, b)
                    out = np.zeros((len(ids), d.num_rows), "i8")
                    _add_up(out, q, (dt, di, dv))
                    hit = out
                    if (dv <= 0).any():  # then a sum of 0 may be that of a match
                        hit = np.zeros(out.shape, "i8")
                        _add_up(hit, (q[0], q[1], np.ones_like(q[2])), (dt, di, np.ones_like(dv)))
                    rows = max(1, SENT // d.num_rows)
                    for a in range(0, len(ids), rows):
                        at, col = np.nonzero(hit[a : a + rows])
                        score = out[a + at, col] / FIXED
                        if digits is not None:
                            score = half_away(score * 10.0**digits) / 10.0**digits
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + at)), d.column("key").take(pa.array(col)), pa.array(score)], ["q", "doc_ord", "score"])

        return returned(docs).mapInArrow(scan, f"q {kinds[0]}, doc_ord {kinds[1]}, score double")

    return reduce(DataFrame.unionByName, [one(i) for i in range(blocks)])


def top_k(scores: DataFrame, k: int = DEPTH, by: str = "doc_ord") -> DataFrame:
    """(…, rank): the k best of every query, score falling, then key; needs a positive score."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), by)
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _add_up(out: np.ndarray, q: tuple, d: tuple) -> None:
    """out[query, piece] += times * part over equal terms; q and d are (term, query or piece, value), sorted by term."""
    (qt, qi, qv), (dt, di, dv) = q, d
    terms, start, n = np.unique(dt, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(qt, terms, "left"), np.searchsorted(qt, terms, "right")
    size = (hi - lo) * n
    for j in np.flatnonzero(size > FEW):
        a, z = slice(lo[j], hi[j]), slice(start[j], start[j] + n[j])
        out[np.ix_(qi[a], di[z])] += qv[a, None] * dv[z]
    few = np.flatnonzero((size > 0) & (size <= FEW))
    if len(few):
        of = np.repeat(few, size[few])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        a, z = lo[of] + nth // n[of], start[of] + nth % n[of]
        np.add.at(out, (qi[a], di[z]), qv[a] * dv[z])


def bm25_top_k(
    postings: DataFrame,
    queries: DataFrame,
    k: int = DEPTH,
    names: DataFrame | None = None,
    by: str = "doc_ord",
    pairs: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(q, by, score, rank): the k best pieces of each query, score (to 9 digits) falling, then `by`.

    names: (doc_ord, by) of the pieces that may be returned, all if it is left out; it changes no score.
    pairs: (q, by) whose scores are wanted whatever their place; such rows come besides, without a rank.
    A join would make a row for every query, term and piece; here the postings are shuffled once, to one
    list a piece, and a task adds up a matrix of queries by pieces (at most CELLS at a time), of which only
    its k best per query travel on. Queries are sent out in blocks of about BROADCAST_ROWS terms and pairs.
    """
    docs, asked = filed(postings, names, by), _asked(queries)
    n, avgdl = corpus_stats(docs).first()
    ready = returned(docs)
    kinds = dict(ready.dtypes)["key"], dict(queries.dtypes)["q"]
    blocks = max(1, -(-(asked.count() + (pairs.count() if pairs is not None else 0)) // BROADCAST_ROWS))

    def one(block: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("q"), F.lit(blocks)) == block
        ids, *sent = _block(docs, asked.where(mine), n)
        more = pairs.where(mine).select("q", F.col(by).alias("key")).toPandas().sort_values("key") if pairs is not None else None
        if more is not None:
            at = pd.Index(ids.to_pandas()).get_indexer(more.q)
            more, at = more[at >= 0], at[at >= 0]
            keys, start = np.unique(more.key.to_numpy(), return_index=True)
            more = (keys, np.append(start, len(more)), at)
        held = docs.sparkSession.sparkContext.broadcast((ids, more, *sent))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, more, terms, idf, *q = held.value

            def rows(qs: np.ndarray, keys: pa.Array, score: np.ndarray, top: bool) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(qs)), keys, pa.array(score * (TIE / FIXED)), pa.array(np.full(len(qs), top))], ["q", "key", "score", "top"])

            best, kind = Best(len(ids), k), None
            wanted = pd.Index(more[0]) if more else None
            step = max(1, CELLS // max(1, len(ids)))
            for whole in batches:
                kind = whole.schema.field("key").type
                for i in range(0, whole.num_rows if len(ids) else 0, step):
                    d = whole.slice(i, step)
                    keys = d.column("key").to_numpy(zero_copy_only=False)
                    out = np.zeros((len(ids), len(keys)), "i8")
                    _add_up(out, q, _parts(d, terms, idf, avgdl, k1, b))
                    out = ((out + TIE // 2) // TIE).astype("f8")
                    best.offer(out, keys, least=1.0)
                    if more:
                        at = wanted.get_indexer(keys)
                        col = np.flatnonzero(at >= 0)
                        lo, m = more[1][at[col]], more[1][at[col] + 1] - more[1][at[col]]
                        col, qs = np.repeat(col, m), more[2][np.arange(m.sum()) + np.repeat(lo - np.cumsum(m) + m, m)]
                        yield rows(qs, d.column("key").take(pa.array(col)), out[qs, col], False)
            got = best.result()
            if got:
                yield rows(got[0], pa.array(got[1], kind), got[2], True)

        return ready.mapInArrow(scan, f"q {kinds[1]}, key {kinds[0]}, score double, top boolean")

    found = reduce(DataFrame.unionByName, [one(i) for i in range(blocks)])
    place = F.row_number().over(Window.partitionBy("q", "top").orderBy(F.desc("score"), "key"))
    found = found.withColumn("rank", F.when(F.col("top"), place)).where((F.col("rank") <= k) | ~F.col("top"))
    return found.drop("top").withColumnRenamed("key", by)

"""Filters and the hybrid search of a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.config import DELIVERED, DEPTH, GUARANTEED
from folio.functions.vectors import dot, norm
from folio.operators.bm25 import bm25_top_k
from folio.operators.dense import dense_top_k
from folio.operators.fusion import delivery, rrf
from folio.session import written


@dataclass(frozen=True)
class Filter:
    """What a piece must meet; an empty tuple sets no condition. Areas match by intersection."""

    areas: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    with_discardable: bool = False

    def column(self) -> Column:
        c = F.lit(True)
        if not self.with_discardable:
            c = c & ~F.coalesce(F.col("descartavel"), F.lit(False))
        if self.areas:
            c = c & F.coalesce(F.arrays_overlap("areas", F.array(*map(F.lit, self.areas))), F.lit(False))
        for name, values in (("ano", self.years), ("fonte_id", self.sources), ("tipo", self.kinds)):
            if values:
                c = c & F.coalesce(F.col(name).isin(*values), F.lit(False))
        return c


def hybrid_search(
    pieces: DataFrame,
    postings: DataFrame,
    vectors: DataFrame,
    query_tokens: DataFrame,
    query_vectors: DataFrame,
    where: Filter = Filter(),
    n: int = DELIVERED,
    depth: int = DEPTH,
    guaranteed: int = GUARANTEED,
    dims: int = 64,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All candidates of each query with both ranks and raw scores; entregue marks the delivered ones.

    pieces: (ord, id, …); query_tokens: (q, pos, term); query_vectors: (q, qvec). The filter is a mask:
    statistics and scores are those of all pieces. rerank may reorder candidates (a new `ordem`) before the cut.
    """
    allowed = pieces.where(where.column()).select("ord", "id").distinct()
    query_tokens = written(query_tokens.select("q", "term"), "asked")
    # ties go by id in the dense arm, too: the cut at `depth` and the ranks need one order
    named = vectors.select("ord", "vec").join(allowed, "ord").select("id", "vec")
    dense = written(dense_top_k(named, query_vectors, depth, key="id", dims=dims), "dense")
    # the lexical arm also gives the raw scores of what the dense one found
    lexical = bm25_top_k(postings, query_tokens, depth, allowed.withColumnRenamed("ord", "doc_ord"), "id", dense.select("q", "id"))
    arms = [
        dense.select("q", "id", "rank", F.col("rank").alias("posicao_densa"), F.col("cosine").alias("cosseno")),
        lexical.select("q", "id", "rank", F.col("rank").alias("posicao_lexica"), F.col("score").alias("bm25")),
    ]
    fused = rrf(arms, keep=("posicao_densa", "cosseno", "posicao_lexica", "bm25"))
    # and what only the lexical arm found gets its cosine: no candidate lacks a raw score
    v, w = F.col("vec"), F.col("qvec")
    lack = fused.join(allowed, "id").join(vectors.select("ord", "vec"), "ord", "left").join(query_vectors.select("q", "qvec"), "q", "left")
    out = lack.withColumn("cosseno", F.coalesce("cosseno", dot(v, w) / (norm(v) * norm(w)))).withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    out = delivery(out.drop("ord", "vec", "qvec"), n, guaranteed)
    # delivered first in their order, then the other candidates by fused place
    order = Window.partitionBy("q").orderBy(F.col("posicao").isNull(), "posicao", "fused")
    out = out.withColumn("ordem", F.row_number().over(order)).drop("best", "fused", "posicao")
    if rerank:
        out = rerank(out)
    return out.withColumn("entregue", F.col("ordem") <= n)

"""Reciprocal rank fusion of ranked lists and the guarantee for each list's head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.config import DELIVERED, GUARANTEED, RRF_K


def rrf(lists: list[DataFrame], key: str = "id", k: int = RRF_K, keep: tuple[str, ...] = ()) -> DataFrame:
    """(q, key, rrf, best, fused, *keep): lists are (q, key, rank, …); a list without the item adds nothing,
    nor does a row without a rank.

    best is the item's best rank in any list; fused its place by score, then key; keep names columns of
    the lists of which the value that is not null comes along.
    """
    every = reduce(lambda a, b: a.unionByName(b, True), [d.select("q", key, "rank", *(c for c in keep if c in d.columns)) for d in lists])
    # the shares of an item are added in rank order, so that equal ranks give equal sums
    shares = F.array_sort(F.collect_list("rank"))
    fused = every.groupBy("q", key).agg(
        F.aggregate(shares, F.lit(0.0), lambda s, r: s + 1.0 / (k + r)).alias("rrf"), F.min("rank").alias("best"),
        *(F.max(c).alias(c) for c in keep),
    )
    return fused.withColumn("fused", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), key)))


def delivery(fused: DataFrame, n: int = DELIVERED, guaranteed: int = GUARANTEED, key: str = "id") -> DataFrame:
    """(…, garantido, posicao): posicao is the place in the delivered list, null for what is not delivered.

    The first `guaranteed` of each arm are always in; the rest is filled from the fused top n; garantido
    marks those that are in only because of their arm."""
    head = F.col("best") <= guaranteed
    by_score = [F.desc("rrf"), key]
    marked = (
        fused.withColumn("head", head)
        .withColumn("place", F.row_number().over(Window.partitionBy("q", "head").orderBy(*by_score)))
        .withColumn("heads", F.sum(F.col("head").cast("int")).over(Window.partitionBy("q")))
        .withColumn("in", F.col("head") | ((F.col("fused") <= n) & (F.col("place") <= n - F.col("heads"))))
    )
    before = Window.partitionBy("q").orderBy(*by_score).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("in"), F.sum(F.col("in").cast("int")).over(before))
    out = marked.withColumn("posicao", F.when(place <= n, place.cast("int"))).withColumn("garantido", F.col("posicao").isNotNull() & (F.col("fused") > n))
    return out.drop("head", "place", "heads", "in")


def guarantee(fused: DataFrame, n: int = DELIVERED, guaranteed: int = GUARANTEED, key: str = "id") -> DataFrame:
    """The delivered rows of `delivery`."""
    return delivery(fused, n, guaranteed, key).where("posicao is not null")

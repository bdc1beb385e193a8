"""Exact dense arm: a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.config import DEPTH
from folio.functions.vectors import is_valid
from folio.operators.best import CELLS, Best

QUERY_BLOCK = 4096  # query vectors sent out at a time: 2 MB at 64 dimensions
DIGITS = 12  # cosines that agree to so many digits tie


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = DEPTH, key: str = "ord", vec: str = "vec", dims: int = 64, mask: DataFrame | None = None) -> DataFrame:
    """(q, key, cosine, rank): the k rows of greatest cosine, ties (to 12 digits) by key.

    queries: (q, qvec). Each block of at most QUERY_BLOCK query vectors is broadcast; every task keeps
    its own k best per query, so that what is shuffled is k rows a task and query, not all pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & is_valid(F.col(vec), dims)).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    if mask is not None:
        rows = rows.join(mask.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    asked = queries.where(is_valid(F.col("qvec"), dims)).select("q", "qvec")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = dict(rows.dtypes)["key"], dict(asked.dtypes)["q"]

    def one(block: int) -> DataFrame:
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        pdf = part.toPandas()
        q = np.stack(pdf.qvec.to_list()).astype("f8") if len(pdf) else np.zeros((0, dims))
        held = spark.sparkContext.broadcast((pdf.q.to_numpy(), q / np.sqrt((q * q).sum(1, keepdims=True))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            best = Best(len(ids), k)
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                v = np.stack(b.vec.values).astype("f8")
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                step = max(1, CELLS // len(v))
                for i in range(0, len(ids), step):
                    best.offer(q[i : i + step] @ v.T, b.key.to_numpy(), i, DIGITS)
            got = best.result()
            if got:
                yield pd.DataFrame({"q": ids[got[0]], "key": got[1], "cosine": got[2]})

        return rows.mapInPandas(scan, f"q {kinds[1]}, key {kinds[0]}, cosine double")

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)

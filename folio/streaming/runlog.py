"""The log of searches: one JSON line per query with all candidates, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio import config

CANDIDATE = ["id", "sha256_texto", "posicao_densa", "posicao_lexica", "cosseno", "bm25", "rrf", "garantido"]


def run_log(candidates: DataFrame, query: str = "q", order: str = "ordem") -> DataFrame:
    """(query, n, profundidade, k, garantidos, candidatos): a search's candidates in order, without text.

    A search has at most two arms' depth of candidates, so a row is bounded."""
    names = [c for c in CANDIDATE if c in candidates.columns]
    lists = candidates.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("candidatos"))
    return lists.select(
        query,
        F.lit(config.DELIVERED).alias("n"),
        F.lit(config.DEPTH).alias("profundidade"),
        F.lit(config.RRF_K).alias("k"),
        F.lit(config.GUARANTEED).alias("garantidos"),
        "candidatos",
    )


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def stream_log(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the logs of searches that land as Parquet files in a folder; each file once."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def append(batch: DataFrame, _: int) -> None:
        append_log(run_log(batch), out)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searches_per_window(stream: DataFrame, time: str = "registrado_em", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(inicio, candidatos, garantidos) of the logged candidates per time window; rows later than `late` are dropped."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"))
        .agg(F.count("*").alias("candidatos"), F.sum(F.coalesce("garantido", F.lit(False)).cast("long")).alias("garantidos"))
        .select(F.col("w.start").alias("inicio"), "candidatos", "garantidos")
    )

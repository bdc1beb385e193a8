"""Embeddings by content: a text is embedded once per model, whatever piece it is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.config import EMBEDDING_BATCH
from folio.session import written


class Refused(Exception):
    """The server will not take a text (too long); other errors abort."""


def cache_key(text: Column, model: str, model_digest: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), F.lit(model_digest), text).cast("binary"), 256)


def split_by_cache(texts: DataFrame, cache: DataFrame, model: str, model_digest: str, text: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(hits with vetor, misses): texts joined with the cache (chave, vetor) and those it lacks."""
    keyed = texts.withColumn("chave", cache_key(F.col(text), model, model_digest))
    held = cache.select("chave", "vetor").dropDuplicates(["chave"])
    return keyed.join(held, "chave"), keyed.join(held, "chave", "left_anti")


def embed(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], key: str = "ord", text: str = "texto", batch: int = EMBEDDING_BATCH) -> DataFrame:
    """(key, vetor, estado): batches go to `call`; a refused batch is retried one by one and the refused texts
    come back with estado 'recusado' and no vector."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                try:
                    vectors = list(call(part[text].tolist()))
                except Refused:
                    vectors = []
                    for t in part[text]:
                        try:
                            vectors.append(call([t])[0])
                        except Refused:
                            vectors.append(None)
                out += [(k, None if v is None else list(map(float, v)), "recusado" if v is None else "aceito") for k, v in zip(part[key], vectors)]
            yield pd.DataFrame(out, columns=[key, "vetor", "estado"])

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vetor array<float>, estado string")


def cached_embed(texts: DataFrame, cache: DataFrame, call, model: str, model_digest: str, key: str = "ord", text: str = "texto") -> tuple[DataFrame, DataFrame]:
    """((key, vetor, estado) of all texts, new cache rows (chave, vetor)): only misses reach `call`, each text once.

    What `call` gives is written before anything is derived from it, so that nothing asks for it again."""
    hits, misses = split_by_cache(texts, cache, model, model_digest, text)
    asked = misses.select("chave", text).dropDuplicates(["chave"])
    got = written(embed(asked.select(F.col("chave"), text), call, "chave", text), "embedded")
    new = misses.select(key, "chave").join(got, "chave")
    every = hits.select(key, "vetor", F.lit("aceito").alias("estado")).unionByName(new.select(key, "vetor", "estado"))
    return every, got.where("estado = 'aceito'").select("chave", "vetor")

"""Building, signing, loading and checking an index in a folder.

The folder holds Parquet tables (pieces, vectors, postings), a public registry without text and a
one-row signature; what the model refused is a table, too. Content is hashed, not files: rows are
hashed in buckets of consecutive places, then the bucket hashes in buckets, so that no task holds all.
"""

from __future__ import annotations

import datetime
import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import config
from folio.functions.text import dense_text, digest, lexical_text
from folio.functions.vectors import l2_normalize_strict
from folio.operators.bm25 import build_postings, corpus_stats, doc_lengths
from folio.operators.caption import with_captions
from folio.operators.select import exclusion_reasons, indexable, indexed_sources
from folio.session import written
from folio.sources.cache import cached_embed

BUCKET = 4096
# The fields of a piece that the public registry shows.
LABELS = ["id", "fonte_id", "parte", "secao", "titulo_secao", "pagina_inicial", "pagina_final", "tipo", "areas", "ano"]


class Misaligned(ValueError):
    pass


class OtherModel(ValueError):
    pass


def _joined_hash(order: str, value: str) -> Column:
    """The hash of a group's values in order, one a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def content_hash(rows: DataFrame, value: Column, order: str = "ord") -> DataFrame:
    """(hash, linhas), one row: the hash of the values in order, by buckets of BUCKET places and buckets of these."""
    rows = rows.select(F.col(order).alias("o"), F.coalesce(value.cast("string"), F.lit("\0")).alias("v"))
    buckets = rows.groupBy(F.floor(F.col("o") / BUCKET).alias("b")).agg(_joined_hash("o", "v").alias("h"), F.count("*").alias("n"))
    above = buckets.groupBy(F.floor(F.col("b") / BUCKET).alias("c")).agg(_joined_hash("b", "h").alias("h"), F.sum("n").alias("n"))
    return above.agg(_joined_hash("c", "h").alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"))


def registry_rows(pieces: DataFrame) -> DataFrame:
    """What the public registry shows of each piece: labels, digest and length, no text."""
    return pieces.select(*[c for c in LABELS if c in pieces.columns], digest(F.col("texto")).alias("sha256_texto"), F.length("texto").alias("caracteres"))


def commit_name(folder: str = ".") -> str:
    try:
        return subprocess.run(["git", "describe", "--always", "--dirty"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "desconhecido"


@dataclass
class Shelf:
    """A loaded index."""

    pieces: DataFrame
    vectors: DataFrame
    postings: DataFrame
    refused: DataFrame
    signature: dict


SIGNED = ["sha_ids", "sha_pedacos", "sha_vetores", "sha_postings", "sha_recusados", "indexados", "vetores", "recusados"]


def signature_of(pieces: DataFrame, vectors: DataFrame, postings: DataFrame, refused: DataFrame) -> dict:
    ids = content_hash(pieces, F.col("id")).first()
    texts = content_hash(pieces, F.concat_ws("\0", "id", "texto", "legenda")).first()
    # nine digits tell any two numbers of single precision apart
    vecs = content_hash(vectors, F.array_join(F.transform("vec", lambda x: F.format_string("%.8e", x.cast("double"))), ",")).first()
    lists = postings.groupBy("doc_ord").agg(F.array_sort(F.collect_list(F.concat_ws("\0", "term", F.col("tf").cast("string")))).alias("x"))
    terms = content_hash(lists, F.array_join("x", "\n"), "doc_ord").first()
    out = content_hash(refused, F.concat_ws("\0", "id", "sha256_texto", F.col("caracteres").cast("string"))).first()
    return {
        "sha_ids": ids.hash, "sha_pedacos": texts.hash, "sha_vetores": vecs.hash, "sha_postings": terms.hash, "sha_recusados": out.hash,
        "indexados": ids.linhas, "vetores": vecs.linhas, "recusados": out.linhas,
    }


def build(
    spark: SparkSession,
    folder: str,
    sources: DataFrame,
    blocks: DataFrame,
    pieces: DataFrame,
    call,
    model_digest: str,
    model: str = config.EMBEDDING_MODEL,
    dims: int = 1024,
    with_superseded: bool = False,
    cache: DataFrame | None = None,
    now: Callable[[], str] = lambda: datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"),
    commit: Callable[[], str] = commit_name,
    server: str = "",
) -> Shelf:
    """A full rebuild: selection, captions, texts, vectors (only of texts the cache lacks), postings, signature."""
    if not model_digest:
        raise ValueError("an index without the model's digest cannot be checked later")
    name = commit()
    useful = pieces.where(~F.coalesce("descartavel", F.lit(False)))
    chosen = with_captions(indexable(useful, sources, with_superseded))
    chosen = written(chosen.withColumn("denso", dense_text(F.col("legenda"))), "chosen")
    cache = cache if cache is not None else spark.createDataFrame([], "chave string, vetor array<float>")
    try:
        every, new = cached_embed(chosen.select("ord", "denso"), cache, call, model, model_digest, "ord", "denso")
    finally:
        getattr(call, "unload", lambda: None)()
    new.write.mode("append").parquet(f"{folder}/cache")
    accepted, refused = every.where("estado = 'aceito'"), every.where("estado = 'recusado'")
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    accepted.select("ord", l2_normalize_strict(F.col("vetor"), dims).cast("array<float>").alias("vec")).write.mode("overwrite").parquet(f"{folder}/vectors")
    out = chosen.join(refused.select("ord"), "ord").select("ord", "id", digest(F.col("texto")).alias("sha256_texto"), F.length("denso").alias("caracteres"))
    out.write.mode("overwrite").parquet(f"{folder}/refused")
    kept = chosen.join(table("vectors").select("ord"), "ord", "left_semi")
    kept.drop("denso").repartitionByRange("ord").sortWithinPartitions("ord").write.mode("overwrite").parquet(f"{folder}/pieces")
    stored = table("pieces")
    build_postings(stored.withColumn("lexico", lexical_text(F.col("legenda"))), "ord", "lexico").write.mode("overwrite").parquet(f"{folder}/postings")
    registry_rows(stored).write.mode("overwrite").json(f"{folder}/registry")
    stats = corpus_stats(doc_lengths(table("postings"))).first()
    signature = {
        "modelo": model, "digest": model_digest, "servidor": server, "dimensao": dims, "tokenizador": config.TOKENIZER_VERSION, "commit": name, "construido_em": now(),
        "bm25": {"k1": config.K1, "b": config.B, "n": stats.n, "avgdl": stats.avgdl, "vocabulario": table("postings").select("term").distinct().count()},
        "fusao": {"k": config.RRF_K, "garantidos": config.GUARANTEED, "profundidade": config.DEPTH, "n": config.DELIVERED},
        "incluir_superadas": with_superseded,
        # sources are the entries of a manifest: few, whatever the size of the corpus
        "fontes": [r.fonte_id for r in indexed_sources(stored).collect()],
        "fontes_de_fora": {r.id: r.motivo for r in exclusion_reasons(sources, blocks, pieces).collect() if not (with_superseded and r.motivo == "superada")},
    } | signature_of(stored, table("vectors"), table("postings"), table("refused"))
    spark.createDataFrame([(json.dumps(signature, sort_keys=True, ensure_ascii=False, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/signature")
    return Shelf(stored, table("vectors"), table("postings"), table("refused"), signature)


def load(spark: SparkSession, folder: str, model_digest: str) -> Shelf:
    """The index of a folder, refused if the model is another one or anything differs from the signature."""
    signature = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/signature", wholetext=True).collect()))
    if signature["digest"] != model_digest:
        raise OtherModel(f"built with {signature['digest']}, running {model_digest}")
    if signature["tokenizador"] != config.TOKENIZER_VERSION:
        raise Misaligned(f"tokenizer {signature['tokenizador']}, running {config.TOKENIZER_VERSION}")
    tables = [spark.read.parquet(f"{folder}/{n}") for n in ("pieces", "vectors", "postings", "refused")]
    found = signature_of(*tables)
    for what in SIGNED:
        if found[what] != signature[what]:
            raise Misaligned(f"{what} differs from the signature")
    if tables[0].select("ord").join(tables[1].select("ord"), "ord", "left_anti").limit(1).count():
        raise Misaligned("a piece has no vector")
    return Shelf(*tables, signature)

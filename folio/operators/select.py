"""Which pieces are indexed, and why sources are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.config import OPENING

# The parts that may be left out, and what marks them.
APPENDIX = r"(?iu)\A\s*(?:AP[ÊE]NDICE|ANEXO)(?U:\b)"
METHODOLOGY = r"(?iu)METODOLOGIA\s+DE\s+BUSCA|EQUIPE\s+DE\s+ELABORA[ÇC][ÃA]O|PARTES\s+INTERESSADAS"


def superseded(sources: DataFrame) -> DataFrame:
    """(fonte_id) of the sources that another one replaces."""
    return sources.where("substitui is not null").select(F.col("substitui").alias("fonte_id")).distinct()


def is_methodology() -> Column:
    """Of a piece: by its part, its section title or its opening."""
    tests = [F.coalesce(F.col(c), F.lit("")).rlike(METHODOLOGY) for c in ("parte", "titulo_secao")]
    return tests[0] | tests[1] | F.substring(F.coalesce("texto", F.lit("")), 1, OPENING).rlike(METHODOLOGY)


def indexable(pieces: DataFrame, sources: DataFrame, with_superseded: bool = False) -> DataFrame:
    """Pieces without those of superseded sources and without whole appendices or annexes of which one piece
    is about methodology. Both sides of each anti-join are keys, not pieces."""
    rows = pieces if with_superseded else pieces.join(superseded(sources), "fonte_id", "left_anti")
    condemned = rows.where(F.col("parte").rlike(APPENDIX) & is_methodology()).select("fonte_id", "parte").distinct()
    return rows.join(condemned, ["fonte_id", "parte"], "left_anti")


def exclusion_reasons(sources: DataFrame, blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """(id, motivo): 'superada', 'sem_pdf' (no block at all) or 'espinha_ausente' (no useful piece)."""
    ids = sources.where("id is not null").select("id").distinct()
    old = superseded(sources).select(F.col("fonte_id").alias("id"), F.lit(True).alias("velha"))
    read = blocks.select(F.col("fonte_id").alias("id")).distinct().withColumn("lida", F.lit(True))
    useful = pieces.where(~F.coalesce("descartavel", F.lit(False))).select(F.col("fonte_id").alias("id")).distinct().withColumn("util", F.lit(True))
    rows = ids.join(old, "id", "left").join(read, "id", "left").join(useful, "id", "left")
    why = F.when(F.col("velha"), "superada").when(F.col("lida").isNull(), "sem_pdf").when(F.col("util").isNull(), "espinha_ausente")
    return rows.select("id", why.alias("motivo")).where("motivo is not null")


def indexed_sources(pieces: DataFrame) -> DataFrame:
    """(fonte_id, primeiro) by first appearance."""
    return pieces.groupBy("fonte_id").agg(F.min("ord").alias("primeiro")).orderBy("primeiro")

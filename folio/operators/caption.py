"""The caption of a table: the last one before it in text of the same source, part and section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import strip

# Fixed value: a caption line.
CAPTION = r"(?m)^[ \t]*((?:Quadro|Tabela)\s*\d{1,2}[ \t]*[.:–-][^\n]*)"


def last_caption(text: Column) -> Column:
    """The last caption in a text, stripped; null if none."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1)), F.lit(-1)))


def with_captions(pieces: DataFrame, order: str = "ord") -> DataFrame:
    """pieces with `legenda`, empty where there is none. Captions and tables, not all pieces, are sorted:
    a piece of text without a caption goes around the window."""
    caption = F.when(F.col("tipo") == "texto", last_caption(F.coalesce("texto", F.lit(""))))
    rows = pieces.withColumn("_c", caption)
    key = ["fonte_id", "parte", "secao"]
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tables = rows.where((F.col("tipo") == "tabela") | F.col("_c").isNotNull()).withColumn("legenda", F.last("_c", ignorenulls=True).over(w))
    found = tables.where(F.col("tipo") == "tabela")
    others = rows.where(F.coalesce(F.col("tipo") != "tabela", F.lit(True))).withColumn("legenda", F.lit(None).cast("string"))
    return found.unionByName(others).drop("_c").withColumn("legenda", F.coalesce("legenda", F.lit("")))

"""Line blocks from plain documents, and tables from cell rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import clean


def document_blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, texto): one block per line that is not blank, cleaned (glued reference calls included); ord is the line's place."""
    lines = documents.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("ord", "linha"))
    return lines.select(key, F.col("ord").cast("long").alias("ord"), clean(F.col("linha")).alias("texto")).where("texto <> ''")

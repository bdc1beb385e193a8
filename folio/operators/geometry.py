"""Objects of a page that lie outside all of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outside_boxes(objects: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """objects (page keys, x0, x1, top, bottom) whose centre is in no box of the same page; edges count as inside.

    The page keys make it a hashed anti-join: only objects and boxes of one page meet.
    """
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in [*page, "x0", "x1", "top", "bottom"]])
    same = F.lit(True)
    for c in page:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return objects.join(b, same & x.between(F.col("b_x0"), F.col("b_x1")) & y.between(F.col("b_top"), F.col("b_bottom")), "left_anti")

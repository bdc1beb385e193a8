"""Problem 5: cutting oversized text at natural boundaries, by one bounded-quantifier expression.

The expression's alternatives stand in order of boundary strength and each consumes as much as the
limit allows: up to a line end or the end of the text, else up to a sentence end before white
space, else up to white space, else the limit itself. Matching it over and over therefore cuts
the whole text; where the pieces start follows from the lengths of the matches, and the overlap is
taken back from there. All of it is SQL array functions: no Python, no shuffle.

The first piece may take the whole limit; the later ones leave room for the overlap.

Defined cases: a null text gives no pieces; an empty or blank one none either; a text within the
limit is one piece; characters are code points; other columns (those asked for) are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 200
CLASSES = ["paragrafo", "frase", "espaco", "nenhum"]  # by falling strength


def boundary_pattern(first: int, limit: int) -> str:
    """Group 1 is the piece, of at most `first` characters where the text begins; what follows it up to the next piece is consumed as well."""
    some = rf"(?s:.{{1,{limit}}})" if first == limit else rf"(?s:\A.{{1,{first}}}|(?!\A).{{1,{limit}}})"
    core = rf"({some}(?=\n|\z)|{some}(?<=[.!?])(?=(?U:\s))|{some}(?=(?U:\s))|{some})"
    return core + r"(?U:[\s&&[^\n]]*)\n?"


def cut(text: Column, first: int, limit: int) -> Column:
    """array<struct<inicio, texto, corte>>: the pieces of a text, corte being 0..3 for the kind of cut that ends it."""
    pattern = F.lit(boundary_pattern(first, limit))
    whole, core = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
    ends = F.aggregate(
        F.transform(whole, F.length),
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    # what follows the piece tells which alternative took it, because the stronger ones come first
    kind = lambda piece, rest: (
        F.when(rest.isNull() | (rest == "") | rest.startswith("\n"), 0)
        .when(piece.rlike(r"[.!?]\z") & rest.rlike(r"(?U)\A\s"), 1)
        .when(rest.rlike(r"(?U)\A\s"), 2)
        .otherwise(3)
    )
    pieces = F.arrays_zip(core.alias("p"), whole.alias("w"), ends.alias("e"))
    return F.transform(
        pieces,
        lambda x: F.struct(
            (x["e"] - F.length(x["w"])).alias("inicio"),
            x["p"].alias("texto"),
            kind(
                x["p"],
                # the consumed separator, or else the character after the match
                F.when(F.length(x["w"]) > F.length(x["p"]), F.substr(x["w"], F.length(x["p"]) + 1, F.lit(1))).otherwise(
                    F.substr(text, x["e"] + 1, F.lit(1))
                ),
            ).alias("corte"),
        ),
    )


def split_pieces(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keep + (n, inicio, texto, corte): pieces of at most `limit` characters, each opening with about
    the last `overlap` characters before it (fewer where a word would be cut; none in the first)."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    t = F.col("_text")
    got = (
        df.where(F.col(text).isNotNull())
        .select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
        .withColumn("_p", cut(t, limit, limit - overlap))
        .select(*keep, "_text", F.posexplode("_p").alias("n", "_x"))
        .where(F.trim(F.regexp_replace("_x.texto", r"(?U)\s+", " ")) != "")
    )
    start = F.col("_x.inicio")
    before = F.when(start > 0, F.substr(t, F.greatest(start - overlap, F.lit(0)) + 1, F.least(start, F.lit(overlap)))).otherwise("")
    if overlap:
        # drop the word that the look-back cuts in two, unless it is all there is
        cut_word = (start > overlap) & ~F.substr(t, start - overlap, F.lit(1)).rlike(r"(?U)\s")
        trimmed = F.regexp_replace(before, r"\A(?U:\S+\s)", "")
        before = F.when(cut_word, trimmed).otherwise(before)
    else:
        before = F.lit("")
    return got.select(
        *keep,
        F.col("n").cast("int").alias("n"),
        (start - F.length(before)).cast("int").alias("inicio"),
        F.concat(before, F.col("_x.texto")).alias("texto"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("_x.corte") + 1).alias("corte"),
    )


def weakest_cut(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key, corte) of every text above the limit: the weakest kind of boundary that cutting it needs."""
    return (
        df.where(F.length(text) > limit)
        .select(key, text)
        .distinct()
        .select(key, F.array_max(F.transform(cut(F.col(text), limit, limit), lambda x: x["corte"])).alias("_k"))
        .select(key, F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("_k") + 1).alias("corte"))
    )

"""Cleaning, digests, slugs, citation headers and the texts of the two search arms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.config import DIGEST_HEX, SLUG_MOST

# A reference call glued to a word (several numbers; a single one), and what marks an address.
SEVERAL_CALLS = r"(?U)(?<=[A-Za-zÀ-ÿ)])\d+(?:–\d+)?(?:,\d+(?:–\d+)?)+(?!\w)"
SINGLE_CALL = r"(?U)(?<=[A-Za-zÀ-ÿ]{4}[a-zà-ÿ])\d+(?![\w.,]\d)(?!\w)"
ADDRESS = r"(?i)https?://|www\.|\.[A-Za-z]{2,5}(?:/|\?|$)|\.(?:com|org|net|gov|edu|int|br|pdf|html?)\b"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def drop_calls(c: Column) -> Column:
    """Without numbers of reference calls glued to words; tokens that look like an address stay as they are."""
    one = lambda t: F.when(t.rlike(ADDRESS), t).otherwise(
        F.regexp_replace(F.regexp_replace(t, SEVERAL_CALLS, ""), SINGLE_CALL, "")
    )
    # the split costs an array per text: only where some letter is followed by a digit
    return F.when(c.rlike(r"[A-Za-zÀ-ÿ)]\d"), F.array_join(F.transform(F.split(c, " "), one), " ")).otherwise(c)


def clean(c: Column) -> Column:
    """A line of extracted text as it is indexed (null gives an empty text)."""
    c = F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{E000}-\x{F8FF}]", "-"), F.lit(" "), F.lit(" "))
    return strip(F.regexp_replace(drop_calls(c), r"[ \t]+", " "))


def table_text(rows: Column) -> Column:
    """array<array<string>> of cells to text: cells by ' | ', rows by line feed, rows without any content dropped."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(clean(c), F.lit("\n"), F.lit(" "))))
    return F.array_join(F.transform(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")


def digest(c: Column) -> Column:
    """The first hexadecimal digits of the SHA-256 of the UTF-8 text; null stays null."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, DIGEST_HEX)


def slug(c: Column) -> Column:
    """ASCII letters and digits joined by hyphens, lower case, cut last (so it may end in a hyphen)."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "-"), r"\A-+|-+\z", "")), 1, SLUG_MOST)


def _none(c: Column) -> Column:
    return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))


def section_label(number: Column, title: Column) -> Column:
    """'number. title', or whichever of the two there is; null if neither."""
    return F.concat_ws(". ", _none(number), _none(title))


def header(p: str = "") -> Column:
    """The citation line of a piece (columns under their own names, with an optional prefix)."""
    c = lambda n: F.col(p + n)
    where = F.coalesce(_none(section_label(c("secao"), c("titulo_secao"))), F.lit("(sem seção)"))
    pages = F.concat(
        F.lit("p. "),
        c("pagina_inicial").cast("string"),
        F.when(c("pagina_final") != c("pagina_inicial"), F.concat(F.lit("-"), c("pagina_final").cast("string"))).otherwise(""),
    )
    title = F.concat(c("titulo_fonte"), F.lit(" ("), c("orgao"), F.lit(", "), c("ano").cast("string"), F.lit(")"))
    return F.concat_ws(" — ", title, _none(c("parte")), where, pages)


def anchored(p: str = "") -> Column:
    return F.concat(header(p), F.lit("\n\n"), F.col(p + "texto"))


def frame(p: str = "") -> Column:
    """Title, year, part and section: empty ones vanish with their separators."""
    c = lambda n: F.col(p + n)
    title = F.concat(c("titulo_fonte"), F.lit(" ("), c("ano").cast("string"), F.lit(")"))
    return F.concat_ws(" — ", title, _none(c("parte")), _none(section_label(c("secao"), c("titulo_secao"))))


def dense_text(caption: Column, p: str = "") -> Column:
    """What the dense arm embeds: frame, caption and text on lines of their own."""
    return F.concat_ws("\n", _none(frame(p)), _none(caption), _none(strip(F.coalesce(F.col(p + "texto"), F.lit("")))))


def lexical_text(caption: Column, p: str = "") -> Column:
    """What the lexical arm tokenises: caption and text, without the frame."""
    return strip(F.concat(F.coalesce(caption, F.lit("")), F.lit("\n"), F.coalesce(F.col(p + "texto"), F.lit(""))))

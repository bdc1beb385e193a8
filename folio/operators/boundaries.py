"""What a line of text is: predicates over columns, with neighbours where a rule looks at them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.config import HEADING_MOST
from folio.functions.text import strip

# The forms of titles, markers and bibliography headings.
DOTTED = r"\A(\d+(?:\.\d+)*)\.\s+([A-Za-zÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç][^\n]*)\z"
CAPITAL = r"\A(\d+(?:\.\d+)*)\s+([A-ZÀ-ÖØ-Þ][^a-zà-ÿ.]{3,88})\z"
NUMBERED_REFERENCES = r"(?iu)\A\d+(?:\.\d+)*\.?\s+(?:REFER[EÊ]NCIAS(?:\s+BIBLIOGR[ÁA]FICAS)?|BIBLIOGRAFIA)\s*:?\z"
BARE_REFERENCES = r"\A(?:REFER[EÊ]NCIAS(?:\s+BIBLIOGR[ÁA]FICAS)?|BIBLIOGRAFIA)\z"
DISCARDABLE = r"(?iu)\A\s*(?:REFER[EÊ]NCIAS|BIBLIOGRAFIA)(?U:\b)"
MARKER = r"(?iu)\A\s*(?:ANEXO|AP[EÊ]NDICE|TERMO DE ESCLARECIMENTO|FICHA FARMACOTERAP[EÊ]UTICA)(?U:\b)[^\n]*\z"
PART_DIVIDER = r"\APARTE\s+[IVXL]+\z"
DISEASE_CODE = r"(?i)CID[\s-]?10\s*:"
CONTINUES = r"\A(?:E|OU)\s+"
BRACE = r"\A\}\s*([^\n]+)\z"
LOWER, UPPER = r"[a-zà-ÿ]", r"[A-ZÀ-ÖØ-Þ]"


def is_title(line: Column) -> Column:
    """Short, with an upper-case letter and no lower-case one."""
    return (line != "") & (F.length(line) <= HEADING_MOST) & ~line.rlike(LOWER) & line.rlike(UPPER)


def candidate(line: Column) -> Column:
    """struct<numero, titulo> of a numbered title, null for any other line."""
    s = strip(line)
    of = lambda p: F.struct(F.regexp_extract(s, p, 1).alias("numero"), strip(F.regexp_extract(s, p, 2)).alias("titulo"))
    return F.when(s.rlike(DOTTED), of(DOTTED)).when(s.rlike(CAPITAL), of(CAPITAL))


def level(number: Column) -> Column:
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))


def follows(before: Column, after: Column) -> Column:
    """Whether a level continues the numbering: one level down to 1, or the next sibling of itself or an ancestor.

    No level before (null): only 1 starts.
    """
    n = F.size(before)
    down = after == F.concat(before, F.array(F.lit(1)))
    m = F.size(after)
    sibling = (m >= 1) & (m <= n) & (F.slice(after, 1, m - 1) == F.slice(before, 1, m - 1)) & (F.element_at(after, m) == F.try_element_at(before, m) + 1)
    return F.when(before.isNull(), after == F.array(F.lit(1))).otherwise(down | sibling)


def is_discardable_title(title: Column) -> Column:
    return title.rlike(DISCARDABLE)


def starts_numbered_references(line: Column) -> Column:
    return strip(line).rlike(NUMBERED_REFERENCES)


def opens_bare_references(line: Column) -> Column:
    return strip(line).rlike(BARE_REFERENCES)


def marker(line: Column) -> Column:
    """The name of a part (annex, appendix, …), or null."""
    s = strip(line)
    return F.when(s.rlike(PART_DIVIDER) | ((F.length(s) <= HEADING_MOST) & s.rlike(MARKER)), s)


def chapter(line: Column, after: Column, before: Column) -> Column:
    """The name of a chapter that the next line's disease code confirms, joined with the line before where it
    continues it; null for any other line."""
    s, prior = strip(line), strip(F.coalesce(before, F.lit("")))
    ok = (s != "") & (F.length(s) <= HEADING_MOST) & ~s.rlike(LOWER) & strip(F.coalesce(after, F.lit(""))).rlike(DISEASE_CODE)
    joined = s.rlike(CONTINUES) & is_title(prior) & (F.length(prior) + F.length(s) <= HEADING_MOST)
    return F.when(ok, F.when(joined, F.concat(prior, F.lit(" "), s)).otherwise(s))


def subtitle(line: Column) -> Column:
    """The upper-case title after a brace, or null."""
    t = strip(F.regexp_extract(strip(line), BRACE, 1))
    return F.when(is_title(t), t)


def unmarked_title(line: Column) -> Column:
    s = strip(line)
    return F.when((F.length(s) >= 4) & ~s.endswith(".") & is_title(s), s)

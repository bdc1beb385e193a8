"""Problem 7: one form for text that looks the same, by DuckDB inside Arrow partitions.

Every Arrow batch is registered with an in-process DuckDB connection and rewritten by one embedded
SQL expression: invisible characters go, look-alike letters and hyphens are translated, nfc_normalize
composes, compatibility characters of the batch are mapped by translate (one to one) and replace
(one to many), every kind of space becomes a plain one, and the result is composed once more.

Defined cases: a null text stays null, an empty one empty; line feeds are kept; other columns are
untouched; equal texts get equal forms whatever batch they are in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import written

# Cyrillic and Greek letters drawn like Latin ones, and the Latin letters they look like.
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
}
# Characters drawn like a hyphen.
HYPHENS = "\u2010\u2011\u2012\u2013\u2043\u2212\u02d7\ufe63\uff0d"
# Spaces other than U+0020 and the line breaks.
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], str]:
    """(letters, one-to-one forms, one-to-many forms, invisible characters), built from the Unicode database.

    letters also has the accented forms of the look-alikes, each mapped to the accented Latin letter.
    """
    letters, one, many, hidden = dict(LETTERS), {}, {}, []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        kind = unicodedata.category(c)
        if kind == "Cn" or kind == "Co":
            continue
        if kind == "Cf" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0":
            hidden.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in LETTERS:
            letters[c] = unicodedata.normalize("NFC", LETTERS[parts[0]] + parts[1:])
        form = unicodedata.normalize("NFKC", c)
        if form != unicodedata.normalize("NFC", c):
            (one if len(form) == 1 else many)[c] = form
    return letters, one, many, "".join(hidden)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expression(column: str, present: set[str]) -> str:
    """The SQL that rewrites a column whose special characters are `present` (all others are unaffected)."""
    letters, one, many, hidden = tables()
    sql = column

    def translate(sql: str, pairs: dict[str, str]) -> str:
        pairs = {a: b for a, b in pairs.items() if a in present}
        single = {a: b for a, b in pairs.items() if len(b) == 1}
        for a, b in pairs.items():
            if len(b) != 1:
                sql = f"replace({sql}, {quoted(a)}, {quoted(b)})"
        return f"translate({sql}, {quoted(''.join(single))}, {quoted(''.join(single.values()))})" if single else sql

    gone = "".join(c for c in hidden if c in present)
    if gone:
        sql = f"translate({sql}, {quoted(gone)}, '')"
    sql = translate(sql, {**many, **one})
    sql = translate(sql, letters)  # forms of look-alikes are look-alikes: letters come second
    sql = translate(sql, {**dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(SPACES, " ")})
    sql = f"regexp_replace({sql}, '\\r\\n?|\\x{{2028}}|\\x{{2029}}|\\x{{85}}', chr(10), 'g')"
    return f"nfc_normalize({sql})"


def rewrite(text: pa.Array, con=None) -> pa.Array:
    """The one form of each text of an Arrow array."""
    import duckdb

    con = con or duckdb.connect()
    con.register("batch", pa.table({"t": text}))
    special = con.execute("select distinct unnest(string_split(regexp_replace(t, '[\\x01-\\x7f]+', '', 'g'), '')) from batch where t is not null").fetchall()
    present = {r[0] for r in special if r[0]} | {"\t"}
    # forms may bring up characters that are mapped in turn
    _, one, many, _ = tables()
    present |= set("".join(one.get(c) or many.get(c, "") for c in present))
    out = con.sql(f"select {expression('t', present)} as t from batch").to_arrow_table().column("t")
    con.unregister("batch")
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def one_form(df: DataFrame, text: str, out: str = "forma") -> DataFrame:
    """df with the column `out`: the form in which look-alike texts are equal."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        for b in batches:
            names = [n for n in b.schema.names if n != out]
            form = rewrite(b.column(text), con)
            form = form.combine_chunks() if isinstance(form, pa.ChunkedArray) else form
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pc.cast(form, pa.string())], [*names, out])

    return df.mapInArrow(run, schema)


def form_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, classe, grafia): the class of texts that look the same, and which spelling of it the row has."""
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).distinct()
    return one_form(rows, text).select(
        key,
        F.sha2(F.col("forma").cast("binary"), 256).alias("classe"),
        F.sha2(F.col(text).cast("binary"), 256).alias("grafia"),
    )


def lookalike_pairs(df: DataFrame, key: str, text: str, parts: int = 8) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts differ but look the same.

    A class with a single spelling drops out before any pair is made; the pairs of a class are made
    in parts x parts blocks, so that no task gets a whole class.
    """
    classes = written(form_classes(df, key, text), "forms")  # read three times
    rows = classes.withColumn("parte", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    several = rows.groupBy("classe").agg(F.min("grafia").alias("a"), F.max("grafia").alias("b")).where("a <> b")
    several = several.select("classe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("parte"))
    rows = rows.join(several, ["classe", "parte"])
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = rows.select("classe", F.col("grafia").alias("ga"), F.col(key).alias("ka"), F.col("parte").alias("pa"), every.alias("pb"))
    b = rows.select("classe", F.col("grafia").alias("gb"), F.col(key).alias("kb"), F.col("parte").alias("pb"), every.alias("pa"))
    return a.join(b, ["classe", "pa", "pb"]).where("ka < kb and ga <> gb").select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))

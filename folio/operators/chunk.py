"""Blocks to citable pieces.

Three steps. (1) Every block gets the events it may stand for, as columns; neighbours come from
windows over stretches of the reading order, not over whole sources. (2) A fold over events alone
decides which hold and labels each block. It runs per stretch between names in capitals, at which
all of its state starts afresh, so a long source with parts or chapters is folded in parallel.
(3) Packing, joining of short pieces, the floor and ids work on labelled blocks and pieces.

Defined cases: blocks without source, place or kind are dropped; a null text counts as empty and is
dropped; of repeated rows one counts; a null page takes the page before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.config import CEILING, EMPTY_TITLES, FLOOR, PARTS_ON_PAGE
from folio.functions.text import slug, strip
from folio.operators import boundaries as at

STRETCH = 1024  # places of the reading order that share a window for neighbours


def with_neighbours(blocks: DataFrame, text: str = "texto") -> DataFrame:
    """blocks with `antes` and `depois`, the texts of the neighbours in reading order within each source.

    Windows cover one stretch and one block on either side (found by place, then trimmed)."""
    part = F.floor(F.col("ord") / STRETCH)
    ends = blocks.groupBy("fonte_id", part.alias("s")).agg(
        F.min_by(text, "ord").alias("primeiro"), F.max_by(text, "ord").alias("ultimo")
    )
    by_source = Window.partitionBy("fonte_id").orderBy("s")
    ends = ends.select("fonte_id", "s", F.lag("ultimo").over(by_source).alias("a"), F.lead("primeiro").over(by_source).alias("d"))
    w = Window.partitionBy("fonte_id", "s").orderBy("ord")
    return (
        blocks.withColumn("s", part)
        .join(ends, ["fonte_id", "s"])
        .withColumn("antes", F.coalesce(F.lag(text).over(w), "a"))
        .withColumn("depois", F.coalesce(F.lead(text).over(w), "d"))
        .drop("a", "d")
    )


def carried(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (with fonte_id, s, ord) with `out`: the last non-null value up to each row, by stretches."""
    ends = rows.groupBy("fonte_id", "s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ord"))).alias("u"))
    before = Window.partitionBy("fonte_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("fonte_id", "s", F.last("u", ignorenulls=True).over(before).alias("u"))
    w = Window.partitionBy("fonte_id", "s").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ends, ["fonte_id", "s"]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), "u")).drop("u")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """One row per (fonte_id, ord) with a text; repeated rows and nulls are gone."""
    return (
        blocks.where("fonte_id is not null and ord is not null and tipo in ('texto', 'tabela') and trim(coalesce(texto, '')) <> ''")
        .groupBy("fonte_id", "ord")
        .agg(F.max(F.struct("pagina", "tipo", "texto")).alias("b"))
        .select("fonte_id", "ord", "b.*")
    )


def events(blocks: DataFrame) -> DataFrame:
    """Clean blocks with what each may be and whether its source is a book of chapters."""
    text_only = with_neighbours(blocks.where("tipo = 'texto'"))
    books = text_only.groupBy("fonte_id").agg(F.max(at.chapter(F.col("texto"), F.col("depois"), F.col("antes")).isNotNull()).alias("livro"))
    rows = with_neighbours(blocks)
    t = F.col("texto")
    is_text = F.col("tipo") == "texto"
    name = F.coalesce(at.chapter(t, F.col("depois"), F.col("antes")), at.marker(t))
    rows = rows.select(
        "fonte_id", "s", "ord", "pagina", "tipo", "texto",
        F.when(is_text, name).alias("nome"),
        strip(F.coalesce("antes", F.lit(""))).alias("atras"),
        F.when(is_text, at.candidate(t)).alias("c"),
        (is_text & at.starts_numbered_references(t)).alias("ref_num"),
        (is_text & at.opens_bare_references(t)).alias("ref"),
        F.when(is_text, at.subtitle(t)).alias("sub"),
        (is_text & at.unmarked_title(t).isNotNull()).alias("solto"),
    )
    rows = carried(rows, "pagina", "pg").withColumn("pagina", F.coalesce("pg", F.lit(1))).drop("pg")
    return rows.join(books, "fonte_id", "left").withColumn("livro", F.coalesce("livro", F.lit(False)))


@dataclass
class Fold:
    """The state of the fold: what is open, and what closes or suspends it."""

    book: bool
    number: str = ""
    title: str = ""
    level: tuple | None = None
    part: str = ""
    suspended: bool = False
    discard: bool = False
    opened: int | None = None  # page of the open numbered title
    row_of_titles: int = 0
    index: bool = False
    names_page: int | None = None
    names: int = 0
    run: int = 0
    held: list[int] = field(default_factory=list)  # rows of the run that is open
    labels: list[tuple] = field(default_factory=list)

    def close(self) -> None:
        """Labels what is held and starts a new run."""
        for i in self.held:
            self.labels.append((i, self.run, self.part, self.number, self.title, self.suspended or self.discard))
        self.held, self.run = [], self.run + 1

    def section(self, number: str = "", title: str = "", level: tuple | None = None, discard: bool = False) -> None:
        self.close()
        self.number, self.title, self.level, self.discard = number, title, level, discard

    def name(self, name: str, page: int, behind: str) -> None:
        if self.held and name.startswith(behind) and name != behind:
            self.held.pop()  # the first half of a name that took two lines
        if page != self.names_page:
            self.names_page, self.names = page, 0
        self.names += 1
        self.section()
        self.part = "" if self.names >= PARTS_ON_PAGE else name
        self.suspended, self.row_of_titles, self.index = False, 0, False

    def in_book(self, i: int, e) -> None:
        if e.sub is not None:
            self.section(title=e.sub, level=())
            self.suspended = False
        elif e.ref:
            self.section()
            self.suspended = True
        elif self.suspended and e.solto:
            self.section()
            self.suspended, self.held = False, [i]
        else:
            self.held.append(i)

    def in_spine(self, i: int, e) -> None:
        level = None
        if e.c is not None and not self.suspended:
            level = tuple(map(int, e.c["numero"].split(".")))
            level = level if continues(self.level, level) else None
        if level is not None:
            empty = not self.held and self.level is not None and self.opened == e.pagina
            self.row_of_titles = self.row_of_titles + 1 if empty else 1
            self.index = self.index or self.row_of_titles >= EMPTY_TITLES
            self.section(e.c["numero"], e.c["titulo"], level, e.c["descartavel"])
            self.opened = e.pagina
            self.suspended = self.suspended or e.c["descartavel"]
            return
        if e.ref_num and not self.suspended:
            self.section()
            self.suspended = True
            return
        if self.index:
            self.section()
            self.row_of_titles, self.index = 0, False
        self.held.append(i)

    def take(self, i: int, e) -> None:
        named = e.nome is not None and not (self.suspended and e.nome != e.nome.upper())
        if named:
            self.name(e.nome, e.pagina, e.atras)
        elif self.book:
            self.in_book(i, e)
        else:
            self.in_spine(i, e)


def continues(before: tuple | None, after: tuple) -> bool:
    if before is None:
        return after == (1,)
    k = len(after)
    return after == (*before, 1) or 1 <= k <= len(before) and after[:-1] == before[: k - 1] and after[-1] == before[k - 1] + 1


def label_blocks(blocks: DataFrame) -> DataFrame:
    """(fonte_id, ord, pagina, tipo, texto, trecho, corrida, parte, secao, titulo_secao, descartavel): blocks that
    are content, with the section they belong to; titles and dropped lines are gone."""
    e = events(blocks)
    e = e.withColumn("c", F.when(F.col("c").isNotNull(), F.struct("c.numero", "c.titulo", at.is_discardable_title(F.col("c.titulo")).alias("descartavel"))))
    # a name in capitals is accepted in any state and resets all of it but the count of names on a page:
    # it may open a stretch of its own if no name stands on the page shortly before
    hard = F.col("nome").isNotNull() & (F.col("nome") == F.upper("nome"))
    e = carried(e.withColumn("np", F.when(F.col("nome").isNotNull(), F.struct("ord", "pagina"))), "np", "np_ate")
    prior = F.lag("np_ate").over(Window.partitionBy("fonte_id", "s").orderBy("ord"))
    alone = F.coalesce(prior["pagina"] != F.col("pagina"), F.lit(False))
    e = carried(e.withColumn("h", F.when(hard & alone & ~F.col("nome").startswith(F.col("atras")), F.col("ord"))), "h", "trecho")
    e = e.withColumn("trecho", F.coalesce("trecho", F.lit(-1).cast("long"))).drop("np", "np_ate", "h", "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        fold = Fold(book=bool(pdf.livro.iloc[0]))
        for i, row in enumerate(pdf.itertuples(index=False)):
            fold.take(i, row)
        fold.close()
        got = pd.DataFrame(fold.labels, columns=["i", "corrida", "parte", "secao", "titulo_secao", "descartavel"])
        kept = pdf.iloc[got.i.to_numpy(int)][["fonte_id", "ord", "pagina", "tipo", "texto", "trecho"]].reset_index(drop=True)
        return pd.concat([kept, got.drop(columns="i")], axis=1)

    schema = "fonte_id string, ord long, pagina int, tipo string, texto string, trecho long, corrida long, parte string, secao string, titulo_secao string, descartavel boolean"
    return e.groupBy("fonte_id", "trecho").applyInPandas(run, schema)


def pack(sizes: list[int], ceiling: int = CEILING, floor: int = FLOOR) -> list[int]:
    """Group of each paragraph: filled while there is room (one more each for the joint), then a short last
    group takes the fewest paragraphs before it that lift it to the floor."""
    groups, used = [], 0
    for i, n in enumerate(sizes):
        new = not i or used + n + 1 > ceiling
        groups.append((groups[-1] if groups else -1) + new)
        used = n + 1 if new else used + n + 1
    joined = lambda k: sum(sizes[k:]) + len(sizes) - k - 1
    if groups and groups[-1] > 0:
        start = groups.index(groups[-1])
        first = groups.index(groups[-1] - 1)
        if joined(start) < floor:
            fits = next((k for k in range(start - 1, first, -1) if joined(k) >= floor or joined(k) > ceiling), None)
            if fits is not None and joined(fits) <= ceiling:
                groups[fits:] = [groups[-1]] * (len(groups) - fits)
    return groups


def pack_column(sizes, ceiling: int = CEILING):
    """The same greedy groups (without the lift of the last) as an array expression over array<int> sizes."""
    zero = F.struct(F.array().cast("array<int>").alias("g"), F.lit(-1).alias("k"), F.lit(0).alias("n"))

    def step(acc, size):
        new = (acc["k"] < 0) | (acc["n"] + size + 1 > ceiling)
        k = F.when(new, acc["k"] + 1).otherwise(acc["k"])
        return F.struct(F.concat(acc["g"], F.array(k)).alias("g"), k.alias("k"), F.when(new, size + 1).otherwise(acc["n"] + size + 1).alias("n"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["g"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pack_lifted(sizes: pd.Series) -> pd.Series:
    """The groups of `pack` for each array of sizes."""
    return sizes.map(lambda s: pack([int(n) for n in s]))


def emit(labelled: DataFrame) -> DataFrame:
    """Packed pieces in order: of each run first its text, then each table on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                paras = list(r.x)
                sizes = [len(p["texto"]) for p in paras]
                groups = pack(sizes) if r.tipo == "texto" else list(range(len(paras)))
                for g in dict.fromkeys(groups):
                    own = [p for p, k in zip(paras, groups) if k == g]
                    pages = [p["pagina"] for p in own]
                    out.append((r.fonte_id, r.trecho, r.corrida, int(r.tipo == "tabela"), own[0]["ord"], r.parte, r.secao, r.titulo_secao, min(pages), max(pages), r.tipo, "\n".join(p["texto"] for p in own), r.descartavel))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "fonte_id string, trecho long, corrida long, k int, ord long, parte string, secao string, titulo_secao string, pagina_inicial int, pagina_final int, tipo string, texto string, descartavel boolean"
    keys = ["fonte_id", "trecho", "corrida", "tipo", "parte", "secao", "titulo_secao", "descartavel"]
    runs = labelled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "pagina", "texto"))).alias("x"))
    return runs.mapInPandas(run, schema)


def join_short(pieces: DataFrame, ceiling: int = CEILING, floor: int = FLOOR) -> DataFrame:
    """Short pieces joined to the next of the same kind and section (juntados says how many became one); only
    stretches of equal labels meet."""
    order = ["trecho", "corrida", "k", "ord"]
    same = ["tipo", "descartavel", "parte", "secao", "titulo_secao"]
    w = Window.partitionBy("fonte_id").orderBy(*order)
    change = F.lag(F.struct(*same)).over(w)
    rows = pieces.withColumn("novo", (change.isNull() | (change != F.struct(*same))).cast("long")).withColumn("ilha", F.sum("novo").over(w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                open_piece = None
                for p in r.x:
                    p = dict(p.asDict() if hasattr(p, "asDict") else p)
                    if open_piece and len(open_piece["texto"]) < floor and len(open_piece["texto"]) + len(p["texto"]) + 1 <= ceiling:
                        open_piece["texto"] += "\n" + p["texto"]
                        open_piece["pagina_final"] = max(open_piece["pagina_final"], p["pagina_final"])
                        open_piece["juntados"] += 1
                        continue
                    open_piece = p | {"juntados": 1}
                    p = open_piece
                    out.append((r.fonte_id, r.ilha, p, r.parte, r.secao, r.titulo_secao, r.tipo, r.descartavel))
            yield pd.DataFrame(
                [(f, i, *(p[c] for c in [*order, "pagina_inicial", "pagina_final", "texto", "juntados"]), *rest) for f, i, p, *rest in out],
                columns=["fonte_id", "ilha", *order, "pagina_inicial", "pagina_final", "texto", "juntados", "parte", "secao", "titulo_secao", "tipo", "descartavel"],
            )

    lists = rows.groupBy("fonte_id", "ilha", *same).agg(
        F.sort_array(F.collect_list(F.struct(*order, "pagina_inicial", "pagina_final", "texto"))).alias("x")
    )
    schema = (
        "fonte_id string, ilha long, trecho long, corrida long, k int, ord long, pagina_inicial int, pagina_final int, texto string, juntados int, "
        "parte string, secao string, titulo_secao string, tipo string, descartavel boolean"
    )
    return lists.mapInPandas(run, schema)


def keep_floor(pieces: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Pieces that are long enough, tables, or open their section (compared with the piece before, kept or not)."""
    w = Window.partitionBy("fonte_id").orderBy("trecho", "corrida", "k", "ord")
    label = F.struct("parte", "secao", "titulo_secao")
    before = F.lag(label).over(w)
    opens = (before.isNull() | (before != label)) & ((F.col("secao") != "") | (F.col("titulo_secao") != ""))
    return pieces.withColumn("abre", opens).where((F.length("texto") >= floor) | (F.col("tipo") == "tabela") | F.col("abre")).drop("abre")


def piece_key(source: str = "fonte_id"):
    part, section = slug(F.col("parte")), F.coalesce(F.nullif(F.col("secao"), F.lit("")), slug(F.col("titulo_secao")))
    lead = F.when(part != "", F.concat(part, F.lit("/"))).otherwise("")
    return F.concat(F.col(source), F.lit("#"), lead, F.when(section != "", section).otherwise("preambulo"))


def with_ids(pieces: DataFrame, order: list[str]) -> DataFrame:
    """pieces with `id`: source, part, section and a running number per key."""
    w = Window.partitionBy("chave").orderBy(*order)
    rows = pieces.withColumn("chave", piece_key())
    return rows.withColumn("id", F.concat("chave", F.lit("."), F.row_number().over(w).cast("string"))).drop("chave")


def chunk(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Pieces (id, fonte_id, titulo_fonte, orgao, ano, areas, parte, secao, titulo_secao, pagina_inicial,
    pagina_final, tipo, texto, descartavel, trecho, corrida, k, ord) of all sources; the last four give their order."""
    order = ["trecho", "corrida", "k", "ord"]
    pieces = with_ids(keep_floor(join_short(emit(label_blocks(clean_blocks(blocks))))), order)
    names = sources.where("id is not null").groupBy(F.col("id").alias("fonte_id")).agg(
        F.max(F.struct(F.col("titulo").alias("titulo_fonte"), "orgao", "ano", "areas")).alias("f")
    )
    return pieces.join(names.select("fonte_id", "f.*"), "fonte_id", "left").select(
        "id", "fonte_id", "titulo_fonte", "orgao", "ano", "areas", "parte", "secao", "titulo_secao", "pagina_inicial", "pagina_final", "tipo", "texto", "descartavel", *order
    )

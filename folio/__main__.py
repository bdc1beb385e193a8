"""Command line: fetch sources, chunk and inspect pieces, build, check and search an index, run a named query."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import config
from folio.functions.text import digest, header
from folio.functions.tokens import is_function_word, tokenize
from folio.operators import chunk, search
from folio.plans import index
from folio.session import exists, local_session, ship, written
from folio.sources import acquire, manifest
from folio.sources.embedding import EmbeddingClient, Http
from folio.sources.tables import read_table
from folio.streaming import runlog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, what: str, *places: str, server: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        for x in places:
            c.add_argument(x)
        if server:
            c.add_argument("--server", default="http://localhost:11434", help="address of the embedding server")
            c.add_argument("--model", default=config.EMBEDDING_MODEL)
            c.add_argument("--dims", type=int, default=1024)
        return c

    add("sources", "fetch and check the sources of a manifest", "manifest", "folder", "provenance")
    c = add("chunk", "pieces of a source in a folder of tables: counts, lengths and a sample by stride", "folder", "fonte")
    c.add_argument("--secao", help="prefix of the section number")
    c.add_argument("--sample", type=int, default=20)
    c.add_argument("--all", action="store_true")
    c = add("build", "chunk the blocks of a folder of tables, select, embed, index and sign", "folder", "index", server=True)
    c.add_argument("--with-superseded", action="store_true")
    add("check", "load an index and refuse it if anything differs from its signature", "index", server=True)
    c = add("search", "search an index by both arms", "index", "question", server=True)
    c.add_argument("--n", type=int, default=config.DELIVERED)
    c.add_argument("--area", action="append", default=[])
    c.add_argument("--fonte", action="append", default=[])
    c.add_argument("--json", action="store_true", help="without texts")
    c.add_argument("--log", help="folder of JSON lines that the search is appended to")
    c = add("query", "a named query over a folder of tables", "name", "folder")
    c.add_argument("--out")
    return p


def run_sources(spark, a, fetch=None) -> int:
    sources = [r.asDict() for r in manifest.load_manifest(spark, a.manifest).orderBy("posicao").collect()]
    failed = acquire.acquire_all(sources, a.folder, a.provenance, fetch or acquire.http_fetch, print)
    return 1 if failed else 0


def run_chunk(spark, a) -> int:
    sources = read_table(spark, a.folder, "fonte")
    if not sources.where(F.col("id") == a.fonte).limit(1).count():
        print(f"unknown source: {a.fonte}", file=sys.stderr)
        return 2
    blocks = read_table(spark, a.folder, "bloco").where(F.col("fonte_id") == a.fonte)
    if not blocks.limit(1).count():
        print(f"no blocks of {a.fonte}", file=sys.stderr)
        return 2
    pieces = written(chunk.chunk(blocks, sources).withColumn("n", F.length("texto")), "pieces")
    useful = pieces.where(~F.col("descartavel"))
    every, kept = pieces.count(), useful.count()
    print(f"fonte      {a.fonte}\npedaços    {every}  ({kept} úteis, {every - kept} descartáveis)\ntabelas    {useful.where('tipo = \'tabela\'').count()}")
    if kept:
        # lengths are at most the ceiling but for lone paragraphs: counts per length are few
        per = useful.groupBy("n").count().orderBy("n").collect()
        upto, middle = 0, None
        for r in per:
            upto += r["count"]
            middle = r.n if middle is None and upto > kept // 2 else middle
        print(f"tamanho    mín {per[0].n}  mediana {middle}  máx {per[-1].n} caracteres")
    shown = useful.where(F.col("secao").startswith(a.secao)) if a.secao is not None else useful
    order = ["trecho", "corrida", "k", "ord"]
    if not a.all:
        # by stride over the order of one source's pieces
        step = max(1, shown.count() // a.sample) if a.sample else 1
        shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("fonte_id").orderBy(*order)) - 1).where(F.col("place") % step == 0)
    for r in shown.select("id", "tipo", header().alias("cabecalho"), "texto").orderBy(*order).limit(2**31 - 1 if a.all else a.sample).toLocalIterator():
        print(f"\n{'-' * 78}\n[{r.id}] {r.tipo}\n{r.cabecalho}\n\n{r.texto}")
    return 0


def show_signature(shelf: index.Shelf) -> None:
    s = shelf.signature
    print(f"pedaços      {s['indexados']}\nfontes       {', '.join(s['fontes'])}")
    for name, why in s["fontes_de_fora"].items():
        print(f"de fora      {name}  ({why})")
    print(f"recusados    {s['recusados']}")
    for r in shelf.refused.orderBy("ord").toLocalIterator():
        print(f"             {r.id}  {r.caracteres} caracteres")
    print(f"modelo       {s['modelo']}  {s['digest'][:12]}  servidor {s['servidor']}")
    print(f"léxico       {s['bm25']['vocabulario']} termos, comprimento médio {s['bm25']['avgdl']:.1f}\nfatiador     {s['commit']}  {s['construido_em']}")


def run_build(spark, a, client: EmbeddingClient) -> int:
    model, digest, version = client.running()
    sources, blocks = read_table(spark, a.folder, "fonte"), read_table(spark, a.folder, "bloco")
    pieces = numbered(chunk.chunk(blocks, sources))
    cache = spark.read.parquet(f"{a.index}/cache") if exists(spark, f"{a.index}/cache") else None
    show_signature(index.build(spark, a.index, sources, blocks, pieces, client, digest, model, a.dims, a.with_superseded, cache, server=version))
    return 0


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with `ord`, their place: by source, then in order. Places come from counts, not from a window over all texts."""
    order, part = ["trecho", "corrida", "k", "ord"], ["fonte_id", "trecho", "corrida", "k", "_part"]
    pieces = written(pieces.withColumn("_part", F.floor(F.col("ord") / 4096)), "pieces")
    runs = pieces.groupBy(*part).agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = runs.groupBy("fonte_id").agg(F.sum("_n").alias("_n")).select("fonte_id", before(Window.orderBy("fonte_id")).alias("_from"))
    runs = runs.withColumn("_before", before(Window.partitionBy("fonte_id").orderBy(*part[1:]))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    placed = pieces.withColumn("_within", within).join(runs, part).join(sources, "fonte_id")
    return placed.withColumn("ord", (F.col("_from") + F.col("_before") + F.col("_within")).cast("long")).drop("trecho", "corrida", "k", "_part", "_from", "_before", "_within")


def run_search(spark, a, client: EmbeddingClient) -> int:
    shelf = index.load(spark, a.index, client.running()[1])
    words = [t for t in tokenize(a.question) if not is_function_word(t)]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(words)], "q long, pos int, term string")
    vector = spark.createDataFrame([(0, client.query(a.question))], "q long, qvec array<float>")
    where = search.Filter(areas=tuple(a.area), sources=tuple(a.fonte))
    got = search.hybrid_search(shelf.pieces, shelf.postings, shelf.vectors, asked, vector, where, n=a.n, dims=a.dims)
    got = written(got.join(shelf.pieces.select("id", digest(F.col("texto")).alias("sha256_texto"), header().alias("cabecalho"), F.substring("texto", 1, 400).alias("texto")), "id"), "found")
    if a.log:
        runlog.append_log(runlog.run_log(got.withColumn("consulta", F.lit(a.question)), "consulta"), a.log)
    rows = got.where("entregue").orderBy("ordem").collect()
    if a.json:
        print(json.dumps([{c: r[c] for c in runlog.CANDIDATE} for r in rows], ensure_ascii=False, indent=1))
        return 0
    for r in rows:
        print(f"{r.ordem:>2}. {r.id}\n    L{r.posicao_lexica or '-':<3}D{r.posicao_densa or '-':<3} cosseno {r.cosseno:.3f}  bm25 {r.bm25:6.2f}  rrf {r.rrf:.4f}  {'garantido' if r.garantido else ''}")
        print(f"    {r.cabecalho}\n    {' '.join(r.texto.split())[:160]}")
    return 0


def run_query(spark, a) -> int:
    from folio.plans.queries import queries

    df = queries()[a.name](spark, a.folder)
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, False)
    return 0


def main(argv: list[str] | None = None, send=None) -> int:
    a = parser().parse_args(argv)
    spark = local_session("folio")
    ship(spark)
    if a.command in ("build", "check", "search"):
        client = EmbeddingClient(a.model, a.dims, send=send or Http(a.server))
    try:
        if a.command == "sources":
            return run_sources(spark, a, send)
        if a.command == "chunk":
            return run_chunk(spark, a)
        if a.command == "build":
            return run_build(spark, a, client)
        if a.command == "check":
            shelf = index.load(spark, a.index, client.running()[1])
            show_signature(shelf)
            print(f"\nmatriz       {shelf.signature['vetores']} x {shelf.signature['dimensao']}, alinhada com o registro")
            return 0
        if a.command == "search":
            return run_search(spark, a, client)
        return run_query(spark, a)
    except (index.Misaligned, index.OtherModel) as e:
        print(f"RECUSADO  {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

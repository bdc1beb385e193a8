import pytest
from pyspark.sql import functions as F

from folio.operators import boundaries as at
from folio.operators import caption, chunk, select

FONTE = "id string, titulo string, orgao string, ano int, areas array<string>"


def pieces_of(spark, blocks, order="ord"):
    rows = [("f", k, p, t, x) for k, (p, t, x) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "fonte_id string, ord long, pagina int, tipo string, texto string")
    sources = spark.createDataFrame([("f", "Guia", "MS", 2020, ["a"])], FONTE)
    return chunk.chunk(df, sources).orderBy("trecho", "corrida", "k", "ord").collect()


def T(page, text):
    return (page, "texto", text)


BODY = "Conteúdo de prosa clínica. " * 8


@pytest.mark.parametrize("before, after, want", [(None, "1", True), (None, "2", False), ("5", "5.1", True), ("5.1", "5.2", True), ("8.3.4.3", "8.4", True), ("8.3.4.3", "9", True), ("8.3", "8.5", False), ("8", "8.1.1", False), ("2", "1", False)])
def test_numbering(spark, before, after, want):
    lv = lambda s: None if s is None else tuple(map(int, s.split(".")))
    assert chunk.continues(lv(before), lv(after)) == want
    df = spark.createDataFrame([(before, after)], "b string, a string")
    b = F.when(F.col("b").isNotNull(), at.level(F.col("b")))
    assert df.select(at.follows(b, at.level(F.col("a"))).alias("x")).first().x == want


def test_line_predicates(spark):
    lines = ["ANEXO I", "anexo XXV", "PARTE IV", "PARTE IV • X", "1. Escopo", "1 INTRODUÇÃO", "23. SBD. Diretriz", "1 HC-UFMG. Centro", "} MODO DE TRANSMISSÃO", "} Coletar", "REFERÊNCIAS", "11. REFERÊNCIAS", "SIM", "CASOS GERAIS", "SMS, 2007."]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    x = F.col("x")
    got = {r[0]: r[1:] for r in df.select("x", at.marker(x).isNotNull(), at.candidate(x).isNotNull(), at.subtitle(x), at.opens_bare_references(x), at.starts_numbered_references(x), at.unmarked_title(x).isNotNull()).collect()}
    assert [k for k, v in got.items() if v[0]] == ["ANEXO I", "anexo XXV", "PARTE IV"]
    assert [k for k, v in got.items() if v[1]] == ["1. Escopo", "1 INTRODUÇÃO", "23. SBD. Diretriz", "11. REFERÊNCIAS"]
    assert got["} MODO DE TRANSMISSÃO"][2] == "MODO DE TRANSMISSÃO" and got["} Coletar"][2] is None
    assert got["REFERÊNCIAS"][3] and not got["11. REFERÊNCIAS"][3] and got["11. REFERÊNCIAS"][4]
    assert got["CASOS GERAIS"][5] and not got["SIM"][5] and not got["SMS, 2007."][5]


def test_sections_keep_pages(spark):
    got = pieces_of(spark, [T(3, "1. Escopo"), T(3, BODY), T(4, "2. Métodos"), T(4, BODY)])
    assert [(r.secao, r.titulo_secao, r.pagina_inicial) for r in got] == [("1", "Escopo", 3), ("2", "Métodos", 4)]
    assert [r.id for r in got] == ["f#1.1", "f#2.1"]


def test_ceiling_and_short_page_span(spark):
    got = pieces_of(spark, [T(9, "1. A"), *[T(p, "x" * 900) for p in (10, 11, 12, 13)]])
    assert len(got) > 1 and all(len(r.texto) <= 1800 and r.pagina_final - r.pagina_inicial <= 1 for r in got)


def test_tables_come_after_text_and_stay_alone(spark):
    got = pieces_of(spark, [T(1, "1. A"), (1, "tabela", "a | b" * 40), T(1, BODY)])
    assert [r.tipo for r in got] == ["texto", "tabela"]


def test_references_are_discardable_until_a_part(spark):
    got = pieces_of(spark, [T(1, "1. A"), T(1, BODY), T(2, "2. REFERÊNCIAS"), T(2, "1. Silva. " + BODY), T(2, "anexo XXV da portaria"), T(3, "APÊNDICE 1"), T(3, "1. Escopo"), T(3, BODY)])
    assert [(r.descartavel, r.parte, r.secao) for r in got] == [(False, "", "1"), (True, "", "2"), (False, "APÊNDICE 1", "1")]
    assert got[-1].id == "f#ap-ndice-1/1.1"


def test_fragment_goes_and_short_opening_section_stays(spark):
    got = pieces_of(spark, [T(1, "1. A"), T(1, "y" * 1795), T(1, "2017;"), T(1, "2. SIGLAS"), T(1, "DM2, HAS")])
    assert [r.texto[:4] for r in got] == ["yyyy", "DM2,"]


def test_index_page_gives_way_to_the_body(spark):
    index = [T(1, f"{k}. Título {k}") for k in range(1, 6)]
    got = pieces_of(spark, [*index, T(2, "texto solto"), T(3, "1. Corpo"), T(3, BODY)])
    assert got[-1].secao == "1" and got[-1].titulo_secao == "Corpo"


def test_list_of_parts_opens_none(spark):
    got = pieces_of(spark, [T(1, "ANEXO I"), T(1, "ANEXO II"), T(1, "ANEXO III"), T(2, BODY)])
    assert [r.parte for r in got] == [""]


def test_book_of_chapters(spark):
    got = pieces_of(
        spark,
        [T(1, "RAIVA"), T(1, "CID-10: A82"), T(1, "} DESCRIÇÃO"), T(1, BODY), T(2, "REFERÊNCIAS"), T(2, "Citação longa. " + BODY), T(2, "BIBLIOGRAFIA"), T(2, "Mais citação. " + BODY), T(3, "CASOS GERAIS"), T(3, BODY)],
    )
    assert [(r.parte, r.titulo_secao, r.descartavel) for r in got if len(r.texto) > 100] == [("RAIVA", "DESCRIÇÃO", False), ("RAIVA", "", True), ("RAIVA", "", True), ("RAIVA", "", False)]
    assert got[-1].texto.startswith("CASOS GERAIS")


def test_title_over_two_lines_leaves_the_piece_before(spark):
    got = pieces_of(spark, [T(1, "RAIVA"), T(1, "CID-10: A82"), T(1, BODY), T(2, "TOXOPLASMOSE NA GESTAÇÃO"), T(2, "E TOXOPLASMOSE CONGÊNITA"), T(2, "CID-10: P37"), T(2, BODY)])
    assert {r.parte for r in got} == {"RAIVA", "TOXOPLASMOSE NA GESTAÇÃO E TOXOPLASMOSE CONGÊNITA"}
    assert not any("TOXOPLASMOSE NA" in r.texto for r in got)


def test_pack_lifts_a_short_tail():
    assert chunk.pack([1000, 730, 24]) == [0, 0, 0]
    assert chunk.pack([1000, 790, 24]) == [0, 1, 1]
    assert chunk.pack([1799]) == [0] and chunk.pack([5000, 1]) == [0, 1] and chunk.pack([]) == []
    assert chunk.pack([900, 899]) == [0, 1] and chunk.pack([900, 898]) == [0, 0]


def test_chunk_of_nothing_and_of_dirt(spark):
    assert pieces_of(spark, [T(1, None), T(None, "   "), (1, None, "x")]) == []
    got = pieces_of(spark, [T(None, "1. A"), T(None, BODY), T(2, BODY)])
    assert len(got) == 1 and got[0].pagina_final == 2


PIECE = "ord long, fonte_id string, parte string, secao string, titulo_secao string, tipo string, texto string, descartavel boolean"


def test_captions(spark):
    rows = [
        (1, "f", "", "1", "", "texto", "Quadro 5. Avaliação.\nprosa", False), (2, "f", "", "1", "", "texto", "O Quadro 6 apresenta", False), (3, "f", "", "1", "", "tabela", "a|b", False),
        (4, "f", "", "1", "", "texto", "Tabela 2 – Doses", False), (5, "f", "", "1", "", "tabela", "c", False), (6, "f", "", "2", "", "tabela", "d", False), (7, "f", "", "2", "", "texto", "Quadro 634. x\nFigura 1. y", False), (8, "f", "", "2", "", "tabela", None, False),
    ]
    got = {r.ord: r.legenda for r in caption.with_captions(spark.createDataFrame(rows, PIECE)).collect()}
    assert got == {1: "", 2: "", 3: "Quadro 5. Avaliação.", 4: "", 5: "Tabela 2 – Doses", 6: "", 7: "", 8: ""}


def test_selection(spark):
    rows = [
        (1, "a", "APÊNDICE 1", "", "", "texto", "Metodologia de busca e avaliação", False), (2, "a", "APÊNDICE 1", "2", "", "texto", "outra", False), (3, "a", "", "1", "", "texto", "equipe multiprofissional", False),
        (4, "velha", "", "", "", "texto", "x", False), (5, "a", "CAPÍTULO", "", "equipe de elaboração", "texto", "x", False), (6, "b", None, None, None, "texto", None, True),
    ]
    p = spark.createDataFrame(rows, PIECE)
    s = spark.createDataFrame([("a", "velha"), ("b", None), ("velha", None), ("c", None)], "id string, substitui string")
    assert {r.ord for r in select.indexable(p, s).collect()} == {3, 5, 6}
    assert {r.ord for r in select.indexable(p, s, with_superseded=True).collect()} == {3, 4, 5, 6}
    why = {r.id: r.motivo for r in select.exclusion_reasons(s, p, p).collect()}
    assert why == {"velha": "superada", "b": "espinha_ausente", "c": "sem_pdf"}
    assert [r.fonte_id for r in select.indexed_sources(p).collect()] == ["a", "velha", "b"]

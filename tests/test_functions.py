import hashlib
import math

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import tokens as tk
from folio.functions import vectors as vx


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("4 U109,111,112. Quando a glicemia", "4 U. Quando a glicemia"),
        ("na retina73.", "na retina."),
        ("possível27,39 e mais", "possível e mais"),
        ("beta2 e alfa2", "beta2 e alfa2"),
        ("DM2, iSGLT2, HbA1c", "DM2, iSGLT2, HbA1c"),
        ("S73–85", "S73–85"),
        ("IMC 27,39 kg", "IMC 27,39 kg"),
        ("ver www.saude12.gov/retina73.", "ver www.saude12.gov/retina73."),
        (" item\xa0um \t dois ", "- item um dois"),
        ("", ""),
        (None, ""),
        ("     ", ""),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, tx.clean) == clean


def test_table_text_drops_empty_rows(spark):
    rows = [["a", " b\nc "], ["", None], [None, "d"]]
    assert one(spark, rows, tx.table_text, "array<array<string>>") == "a | b c\n | d"


def test_digest_and_slug(spark):
    assert one(spark, "a", tx.digest) == hashlib.sha256(b"a").hexdigest()[:16]
    assert one(spark, None, tx.digest) is None
    assert one(spark, "APÊNDICE 2", tx.slug) == "ap-ndice-2"
    assert one(spark, "Apêndice 1 – Metodologia de busca", tx.slug) == "ap-ndice-1-metodologia-d"
    assert one(spark, "--", tx.slug) == ""


def test_labels(spark):
    schema = "titulo_fonte string, orgao string, ano int, parte string, secao string, titulo_secao string, pagina_inicial int, pagina_final int, texto string"
    df = spark.createDataFrame(
        [("Guia", "MS", 2020, "ANEXO I", "2.1", "Doses", 3, 4, "t"), ("Guia", "MS", 2020, "", "", "", 3, 3, " t "), ("Guia", "MS", 2020, None, None, "Só título", 1, 1, None)], schema
    )
    got = [tuple(r) for r in df.select(tx.header(), tx.frame(), tx.dense_text(F.lit("")), tx.lexical_text(F.lit("Quadro 1. x"))).collect()]
    assert got[0][0] == "Guia (MS, 2020) — ANEXO I — 2.1. Doses — p. 3-4"
    assert got[1][0] == "Guia (MS, 2020) — (sem seção) — p. 3"
    assert got[0][1] == "Guia (2020) — ANEXO I — 2.1. Doses"
    assert got[1][1:] == ("Guia (2020)", "Guia (2020)\nt", "Quadro 1. x\n t")
    assert got[2][1] == "Guia (2020) — Só título" and got[2][2] == "Guia (2020) — Só título"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Lei nº 8.080/1990", ["lei", "Lei|C", "no", "8.080/1990", "8080/1990", "8.080", "8080", "1990"]),
        ("mg/dL", ["mg/dl", "mg", "dl", "mgdl", "mg/dL|C"]),
        ("dT e DT", ["dt", "dT|C", "e", "dt", "DT|C"]),
        ("DPP-4", ["dpp-4", "dpp", "4", "dpp4", "DPP-4|C"]),
        ("kg/m²", ["kg/m2", "kg", "m2", "kgm2"]),
        ("5 μg / 100 µg", ["5", "ug", "100", "ug"]),
        ("1ª dose, 1,73", ["1a", "dose", "1,73"]),
        ("Straße", ["strasse"]),
        ("Não", ["nao", "Não|C"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(text, want):
    assert tk.tokenize(text) == want


def test_query_tokens_drop_function_words(spark):
    got = one(spark, "Qual a dose em que Não se usa", tk.query_tokens)
    assert got == ["dose", "usa"]


def test_token_forms_column_agrees_with_python(spark):
    words = ["8.080/1990", "dpp-4", "mg/dl", "1.234.567.890", "ckd-epi", "1,73", "a", "anti-inflamatorio"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tk.token_forms(F.col("w")).alias("f"))
    assert {r.w: r.f for r in df.collect()} == {w: tk.forms(w) for w in words}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vx.norm(F.col("a")).alias("n"), vx.dot(F.col("a"), F.col("b")).alias("d"), vx.l2_normalize(F.col("a")).alias("u"), vx.is_valid(F.col("a"), 2).alias("v")).collect()
    assert rows[0].n == 5 and rows[0].d == 24 and rows[0].v and math.isclose(rows[0].u[0], 0.6)
    assert rows[1].u is None and not rows[1].v
    with pytest.raises(Exception, match="zero norm"):
        df.select(vx.l2_normalize_strict(F.col("a"), 2)).collect()

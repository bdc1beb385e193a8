import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.plans import index
from folio.sources import acquire, blocks, cache, manifest
from folio.sources.embedding import EmbeddingClient
from folio.streaming import runlog

GOOD = {"id": "a", "titulo": "t", "orgao": "o", "ano": 2020, "url": "http://x", "base_legal": "b", "redistribuivel": True, "areas": ["x"]}


def write(tmp_path, *entries):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"fontes": list(entries)}))
    return str(p)


def test_manifest(spark, tmp_path):
    df = manifest.load_manifest(spark, write(tmp_path, GOOD, GOOD | {"id": "b", "substitui": "a"}))
    assert [r.id for r in df.orderBy("posicao").collect()] == ["a", "b"]
    for bad, word in ((GOOD | {"id": "c", "titulo": None}, "titulo"), (GOOD, "repeated"), (GOOD | {"id": "d", "substitui": "zz"}, "zz"), (GOOD | {"id": "e", "outro": 1}, "outro")):
        with pytest.raises(manifest.InvalidManifest, match=word):
            manifest.load_manifest(spark, write(tmp_path, GOOD, bad))


def test_sources_command_says_what_failed(spark, tmp_path, capsys):
    from folio.__main__ import parser, run_sources

    pages = {"http://x": b"%PDF-1.7 x", "http://y": b"<html>"}
    path = write(tmp_path, GOOD, GOOD | {"id": "b", "url": "http://y"})
    args = ["sources", path, str(tmp_path / "pdf"), str(tmp_path / "p.json")]
    assert run_sources(spark, parser().parse_args(args), pages.__getitem__) == 1
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("ok      a ") and said[1].startswith("FALHOU  b:")
    assert run_sources(spark, parser().parse_args(["sources", write(tmp_path, GOOD), *args[2:]]), pages.__getitem__) == 0


def test_acquire(spark, tmp_path):
    data = b"%PDF-1.7 x"
    pages = {"http://x": data, "http://y": b"<html>"}
    out = tmp_path / "pdf"
    failed = acquire.acquire_all([GOOD, GOOD | {"id": "b", "url": "http://y"}, GOOD | {"id": "c", "sha256": "0"}], str(out), str(tmp_path / "p.json"), pages.__getitem__)
    assert [f.split(":")[0] for f in failed] == ["b", "c"] and [p.name for p in out.iterdir()] == ["a.pdf"]
    text = (tmp_path / "p.json").read_text()
    assert text.endswith("]\n") and json.loads(text)[0]["sha256"] == hashlib.sha256(data).hexdigest()
    (out / "d.pdf").write_bytes(b"nope")
    files = acquire.scan_files(spark, str(out))
    declared = spark.createDataFrame([("a", "0"), ("d", None), ("z", None)], "id string, sha256 string")
    assert {r.id: r.problema for r in acquire.diverging(declared, files).collect()} == {"a": "changed", "d": "not a PDF", "z": "absent"}


def test_document_blocks(spark):
    df = spark.createDataFrame([(1, "um\r\n\n  dois \t tratamento12,13 x"), (2, None), (3, "  "), (None, "x")], "doc_id long, text string")
    assert [tuple(r) for r in blocks.document_blocks(df).orderBy("ord").collect()] == [(1, 0, "um"), (1, 2, "dois tratamento x")]


def server():
    """A double of the embedding server, defined here so that it travels to the workers by value."""

    def call(texts):
        if any("longo" in t for t in texts):
            raise cache.Refused
        return [[float(len(t)), 1.0] for t in texts]

    return call


fake = server()


def test_cache_embeds_each_text_once_and_isolates_refusals(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "longo"), (3, "a"), (4, "bb")], "ord long, texto string")
    empty = spark.createDataFrame([], "chave string, vetor array<float>")
    every, new = cache.cached_embed(texts, empty, fake, "m", "d")
    got = {r.ord: (r.vetor, r.estado) for r in every.collect()}
    assert got == {1: ([1.0, 1.0], "aceito"), 2: (None, "recusado"), 3: ([1.0, 1.0], "aceito"), 4: ([2.0, 1.0], "aceito")}
    held = spark.createDataFrame(new.collect(), new.schema)
    hits, misses = cache.split_by_cache(texts, held, "m", "d")
    assert {r.ord for r in hits.collect()} == {1, 3, 4} and {r.ord for r in misses.collect()} == {2}
    assert cache.split_by_cache(texts, held, "m", "other")[0].count() == 0


def counting_server(path):
    def call(texts):
        out = fake(texts)  # a refused batch is tried again one by one: what is answered counts
        with open(path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return out

    return call


def test_a_rebuild_embeds_nothing_and_a_build_each_text_once(spark, tmp_path):
    log = tmp_path / "calls"
    folder, built = shelf(spark, tmp_path, counting_server(str(log)), extra=[("asma dose", False)])
    lines = [x for x in log.read_text().splitlines() if x in ("asma dose", "dose dose")]
    assert sorted(lines) == ["asma dose", "dose dose"]  # one text stands in two pieces
    held = spark.createDataFrame(spark.read.parquet(f"{folder}/cache").collect(), "chave string, vetor array<float>")
    before = len(log.read_text().splitlines())
    again = shelf(spark, tmp_path, counting_server(str(log)), extra=[("asma dose", False)], cache=held)[1]
    new = log.read_text().splitlines()[before:]
    assert new == []
    assert {k: v for k, v in again.signature.items() if k.startswith("sha_")} == {k: v for k, v in built.signature.items() if k.startswith("sha_")}


def embedding_server():
    class Server:
        """Answers like an embedding server."""

        def __call__(self, path, body=None):
            if path == "/api/tags":
                return 200, {"models": [{"name": "outro:1", "digest": "x"}, {"name": "bge-m3:latest", "digest": "d1"}]}
            if path == "/api/version":
                return 200, {"version": "9"}
            if any("longo" in t for t in body["input"]):
                return 400, {"error": "too long"}
            if "falha" in body["input"]:
                return 500, {}
            return 200, {"embeddings": [[float(len(t) % 7 + 1), float(t.count("a") + 1)] for t in body["input"]]}

    return Server


Server = embedding_server()  # defined inside, so that it travels to the workers by value


def test_embedding_client():
    client = EmbeddingClient(dims=2, send=Server())
    assert client.running() == ("bge-m3", "d1", "9") and EmbeddingClient("nada", send=Server()).running()[1] == ""
    assert client([]) == [] and client(["aa"]) == [[3.0, 3.0]] == [client.query("aa")]
    with pytest.raises(cache.Refused, match="muito longo"):
        client.query("muito longo")
    with pytest.raises(RuntimeError):
        client(["falha"])
    with pytest.raises(ValueError, match="dimensions"):
        EmbeddingClient(dims=3, send=Server())(["a"])
    client.unload()
    EmbeddingClient(send=lambda *_: 1 / 0).unload()  # raises nothing


def shelf(spark, tmp_path, call=None, extra=(), cache=None):
    schema = "ord long, id string, fonte_id string, titulo_fonte string, orgao string, ano int, areas array<string>, parte string, secao string, titulo_secao string, pagina_inicial int, pagina_final int, tipo string, texto string, descartavel boolean"
    rows = [(k, f"f#{k}", "f", "T", "O", 2020, ["x"], "", "1", "S", 1, 1, "texto", t, d) for k, (t, d) in enumerate([("asma dose", False), ("longo texto", False), ("lixo", True), ("dose dose", False), *extra])]
    pieces = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([("f", None), ("g", None)], "id string, substitui string")
    bl = spark.createDataFrame([("f",)], "fonte_id string")
    folder = str(tmp_path / "index")
    return folder, index.build(spark, folder, sources, bl, pieces, call or fake, "digest", dims=2, cache=cache, commit=lambda: "c", now=lambda: "n")


def test_index_build_load_and_tampering(spark, tmp_path):
    folder, built = shelf(spark, tmp_path)
    assert built.signature["indexados"] == 2 and built.signature["recusados"] == 1 and [r.id for r in built.refused.collect()] == ["f#1"]
    assert built.signature["fontes_de_fora"] == {"g": "sem_pdf"}
    loaded = index.load(spark, folder, "digest")
    assert loaded.signature == built.signature
    shown = spark.read.json(f"{folder}/registry").columns
    assert "areas" in shown and not {"texto", "titulo_fonte", "orgao"} & set(shown)
    with pytest.raises(index.OtherModel):
        index.load(spark, folder, "another")
    rows = spark.read.parquet(f"{folder}/pieces")
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    for change in (F.when(F.col("ord") == 0, "other").otherwise(F.col("id")).alias("id"), F.when(F.col("ord") == 0, "asma").otherwise(F.col("texto")).alias("texto")):
        name = change._jc.toString().split(" AS ")[-1].strip("`")
        kept.withColumn(name, change).write.mode("overwrite").parquet(f"{folder}/pieces")
        with pytest.raises(index.Misaligned):
            index.load(spark, folder, "digest")
    kept.write.mode("overwrite").parquet(f"{folder}/pieces")
    index.load(spark, folder, "digest")
    v = spark.read.parquet(f"{folder}/vectors")
    vectors = spark.createDataFrame(v.collect(), v.schema)
    vectors.where("ord = 0").write.mode("overwrite").parquet(f"{folder}/vectors")
    with pytest.raises(index.Misaligned):
        index.load(spark, folder, "digest")
    last_bit = [(r.ord, [float(np.nextafter(np.float32(r.vec[0]), np.float32(2))), *r.vec[1:]]) for r in vectors.collect()]
    spark.createDataFrame(last_bit, "ord long, vec array<float>").write.mode("overwrite").parquet(f"{folder}/vectors")
    with pytest.raises(index.Misaligned, match="sha_vetores"):
        index.load(spark, folder, "digest")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    index.load(spark, folder, "digest")
    terms = spark.createDataFrame(spark.read.parquet(f"{folder}/postings").collect(), "term string, doc_ord long, tf int")
    terms.withColumn("tf", F.when(F.col("term") == "asma", 2).otherwise(F.col("tf"))).write.mode("overwrite").parquet(f"{folder}/postings")
    with pytest.raises(index.Misaligned, match="sha_postings"):
        index.load(spark, folder, "digest")


def test_command_line_builds_checks_and_searches(spark, tmp_path, capsys):
    from folio.__main__ import main

    body = "Conteúdo de prosa clínica sobre asma e dose segura. " * 4
    rows = [("f", k, 1 + k // 3, "texto", t) for k, t in enumerate(["1. Escopo", body, "2. Doses", body.replace("asma", "vacina"), "3. Fim", "longo " + body])]
    spark.createDataFrame(rows, "fonte_id string, ord long, pagina int, tipo string, texto string").write.parquet(str(tmp_path / "in/bloco.parquet"))
    fonte = [("f", "Guia", "MS", 2020, ["a"], None), ("g", "Outro", "MS", 2020, ["a"], None)]
    spark.createDataFrame(fonte, "id string, titulo string, orgao string, ano int, areas array<string>, substitui string").write.parquet(str(tmp_path / "in/fonte.parquet"))
    src, dst, log = (str(tmp_path / x) for x in ("in", "shelf", "log"))
    more = ["--dims", "2"]
    assert main(["build", src, dst, *more], Server()) == 0
    assert "de fora      g  (sem_pdf)" in capsys.readouterr().out
    assert main(["check", dst, *more], Server()) == 0
    assert "matriz       2 x 2" in capsys.readouterr().out
    assert main(["search", dst, "dose de vacina", "--json", "--log", log, *more], Server()) == 0
    got = json.loads(capsys.readouterr().out)
    assert {r["id"] for r in got} == {"f#1.1", "f#2.1"} and got[0]["sha256_texto"]
    assert spark.read.json(log).first().consulta == "dose de vacina"
    assert main(["search", dst, "dose", *more], Server()) == 0 and "cosseno" in capsys.readouterr().out
    assert main(["chunk", src, "f"]) == 0 and "pedaços    3  (3 úteis" in capsys.readouterr().out
    assert main(["chunk", src, "nada"]) == 2
    spark.read.parquet(f"{dst}/pieces").limit(1).write.mode("overwrite").parquet(f"{dst}/vectors")
    assert main(["check", dst, *more], lambda path, body=None: (200, {"models": [], "version": "9"})) == 1


def test_index_needs_a_digest(spark, tmp_path):
    with pytest.raises(ValueError):
        index.build(spark, str(tmp_path), None, None, None, fake, "")


def test_run_log_streams_each_file_once(spark, tmp_path):
    schema = "q long, ordem int, id string, cosseno double, bm25 double, rrf double, garantido boolean"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for batch in ([(1, 2, "b", 0.1, 0.0, 0.1, False), (1, 1, "a", 0.2, 1.0, 0.2, True)], [(2, 1, "c", None, None, 0.1, False)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        runlog.stream_log(spark, src, schema, out, ck).awaitTermination()
    got = {r.q: [c.id for c in r.candidatos] for r in spark.read.json(out).collect()}
    assert got == {1: ["a", "b"], 2: ["c"]}


def test_searches_per_window_drop_late_rows(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1, 12)
    src = str(tmp_path / "s")
    schema = "registrado_em timestamp, garantido boolean"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for rows in ([(t, True), (t, None)], [(t + dt.timedelta(hours=3), False)], [(t, True)], [(t + dt.timedelta(hours=6), False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    q = runlog.searches_per_window(stream()).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.inicio.hour: (r.candidatos, r.garantidos) for r in spark.sql("select * from w").collect()}
    assert got[12][0] in (2, 3)  # the late row counts only if its file came before the watermark moved

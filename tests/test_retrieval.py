import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import bm25, dense, fusion, geometry, search
from folio.operators.best import Best

DOCS = ["de asma", "de dose dose", "de vacina dt", "de febre", "de tosse", "de dor", "de dose", "de nada", "de lei", "de fim"]


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(i, t) for i, d in enumerate(DOCS) for t in d.split()]
    df = spark.createDataFrame(rows, "doc_ord long, term string")
    return df.groupBy("term", "doc_ord").agg(F.count("*").cast("int").alias("tf")).cache()


def ask(spark, *terms):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(terms)], "q long, pos int, term string")


def scores(df):
    return {r.doc_ord: r.score for r in df.collect()}


def test_bm25_values(spark, postings):
    got = scores(bm25.bm25_scores(postings, ask(spark, "dose")))
    n, df, avg = 10, 2, sum(len(d.split()) for d in DOCS) / 10
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for i, tf, dl in ((1, 2, 3), (6, 1, 2))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_common_term_is_positive_and_unknown_scores_nothing(spark, postings):
    common = scores(bm25.bm25_scores(postings, ask(spark, "de")))
    assert len(common) == 10 and min(common.values()) > 0
    assert max(common.values()) < min(scores(bm25.bm25_scores(postings, ask(spark, "asma"))).values())
    assert scores(bm25.bm25_scores(postings, ask(spark, "ausente"))) == {}


def test_bm25_repeated_query_term_doubles_and_mask_keeps_scores(spark, postings):
    single, double = (scores(bm25.bm25_scores(postings, ask(spark, *t))) for t in (["dose"], ["dose", "dose"]))
    assert all(math.isclose(double[k], 2 * single[k], rel_tol=1e-9) for k in single)
    mask = spark.createDataFrame([(6,), (6,)], "doc_ord long")
    masked = scores(bm25.bm25_scores(postings, ask(spark, "dose"), mask=mask))
    assert masked == {6: single[6]}


def test_bm25_empty_corpus(spark, postings):
    none = postings.where("false")
    assert bm25.bm25_scores(none, ask(spark, "dose")).count() == 0
    assert tuple(bm25.corpus_stats(bm25.doc_lengths(none)).first()) == (0, 1.0)


def test_valid_postings_drop_dirt(spark):
    rows = [("a", 1, 2), ("a", 1, 2), ("", 1, 1), (None, 1, 1), ("a", None, 1), ("b", 1, 0), ("b", 2, None), ("c", 1, -9)]
    df = spark.createDataFrame(rows, "term string, doc_ord long, tf int")
    assert [tuple(r) for r in bm25.valid_postings(df).collect()] == [("a", 1, 2)]


def lists(spark, *ranked):
    return [spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "q long, id string, rank int") for ids in ranked]


def test_rrf_arithmetic_and_ties(spark):
    got = {r.id: (r.rrf, r.fused) for r in fusion.rrf(lists(spark, ["a", "b", "c"], ["c", "d"])).collect()}
    assert math.isclose(got["c"][0], 1 / 63 + 1 / 61) and got["c"][1] == 1
    assert got["a"] == (1 / 61, 2) and got["b"][1] < got["d"][1]  # equal scores go by id


def test_guarantee_brings_a_head_in(spark):
    a = [f"x{i}" for i in range(1, 10)]
    fused = fusion.rrf(lists(spark, a, ["solo", *a[:8]]))
    got = {r.id: r.garantido for r in fusion.guarantee(fused, 2).collect()}
    assert set(got) == {"x1", "solo"}
    assert fusion.guarantee(fusion.rrf(lists(spark, ["a"], ["a"])), 8).count() == 1


def slow_guarantee(arms, n, g):
    s = {}
    for arm in arms:
        for r, i in enumerate(arm, 1):
            s.setdefault(i, []).append(r)
    total = {i: sum(1 / (60 + r) for r in sorted(rs)) for i, rs in s.items()}
    fused = sorted(total, key=lambda i: (-total[i], i))
    heads = list(dict.fromkeys(i for arm in arms for i in arm[:g]))
    chosen = heads + [i for i in fused[:n] if i not in heads][: max(0, n - len(heads))]
    out = sorted(chosen, key=lambda i: (-total[i], i))[:n]
    return [(i, i not in fused[:n]) for i in out]


def test_guarantee_against_lists(spark):
    @settings(max_examples=12, deadline=None, derandomize=True)
    @given(st.permutations("abcdefghij"), st.permutations("abcdefghij"), st.integers(0, 10), st.integers(0, 10), st.integers(1, 8), st.integers(1, 3))
    def check(a, b, ka, kb, n, g):
        arms = a[:ka], b[:kb]
        got = fusion.guarantee(fusion.rrf(lists(spark, *arms)), n, g).orderBy("posicao").collect()
        assert [(r.id, r.garantido) for r in got] == slow_guarantee(arms, n, g)

    check()


def test_dense_top_k_orders_ties_by_key_and_skips_invalid(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0])], "ord long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "q long, qvec array<float>")
    got = dense.dense_top_k(v, q, 2, dims=2).orderBy("rank").collect()
    assert [(r.q, r.ord) for r in got] == [(0, 1), (0, 3)]
    assert dense.dense_top_k(v.where("false"), q, 2, dims=2).count() == 0
    assert dense.dense_top_k(v, q.where("false"), 2, dims=2).count() == 0


def test_dense_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)).round(1)
    x[100:400] = x[0]  # many ties across the cut
    ids = [f"p{n}" for n in rng.permutation(700)]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in zip(ids, x)], "id string, vec array<float>").repartition(5)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 700, 50)], "q long, qvec array<float>")
    u = x.astype("f4").astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {}
    for r in dense.dense_top_k(v, q, 20, key="id", dims=8).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    for k in got:
        cos = np.round(u @ u[k], 12)
        assert got[k] == [ids[i] for i in sorted(range(700), key=lambda i: (-cos[i], ids[i]))[:20]]
    assert len(got) == 14


def test_best_keeps_ties_by_key_over_batches():
    rng = np.random.default_rng(1)
    scores, keys = rng.integers(0, 5, (6, 400)).astype("f8"), rng.permutation(400)
    best = Best(6, 7)
    for i in range(0, 400, 30):
        best.offer(scores[:, i : i + 30], keys[i : i + 30])
    row, key, value = best.result()
    for j in range(6):
        want = sorted(range(400), key=lambda i: (-scores[j, i], keys[i]))[:7]
        assert key[row == j].tolist() == keys[want].tolist() and value[row == j].tolist() == scores[j, want].tolist()
    assert Best(3, 2).result() is None


def test_bm25_top_k_equals_the_scores_of_the_join(spark):
    rng = np.random.default_rng(2)
    rows = {(f"t{int(t)}", int(d)): int(rng.integers(1, 5)) for t, d in zip(rng.zipf(1.3, 3000) % 90, rng.integers(0, 120, 3000))}
    posts = spark.createDataFrame([(t, d, n) for (t, d), n in rows.items()], "term string, doc_ord long, tf int")
    asked = spark.createDataFrame([(q, i, f"t{t}") for q in range(9) for i, t in enumerate(rng.integers(0, 95, 12).tolist())], "q long, pos int, term string")
    every = bm25.bm25_scores(posts, asked).select("q", "doc_ord", F.round("score", 9).alias("score"))
    want = [tuple(r) for r in bm25.top_k(every, 10).select("q", "doc_ord", "rank").orderBy("q", "rank").collect()]
    got = [tuple(r) for r in bm25.bm25_top_k(posts, asked, 10).select("q", "doc_ord", "rank").orderBy("q", "rank").collect()]
    assert got == want
    names = spark.createDataFrame([(d, f"n{d % 50:02d}x{d}") for d in range(0, 120, 2)], "doc_ord long, id string")
    pairs = spark.createDataFrame([(q, f"n{d % 50:02d}x{d}") for q in range(9) for d in (4, 8, 7)] + [(77, "n04x4")], "q long, id string")
    old, bm25.BROADCAST_ROWS = bm25.BROADCAST_ROWS, 40
    try:
        some = bm25.bm25_top_k(posts, asked, 10, names, "id", pairs).collect()
    finally:
        bm25.BROADCAST_ROWS = old
    held = {(r.q, r.doc_ord): r.score for r in every.collect()}
    at = {f"n{d % 50:02d}x{d}": d for d in range(120)}
    assert all(abs(held.get((r.q, at[r.id]), 0) - r.score) < 2e-9 for r in some)
    assert {(r.q, r.id) for r in some if r["rank"] is None} == {(q, f"n{d % 50:02d}x{d}") for q in range(9) for d in (4, 8)}
    assert bm25.bm25_top_k(posts.where("false"), asked).count() == 0 and bm25.bm25_top_k(posts, asked.where("false")).count() == 0


def slow_scores(rows, asked):
    n, dl, df = len({d for _, d, _ in rows}), {}, {}
    for t, d, tf in rows:
        dl[d], df[t] = dl.get(d, 0) + tf, df.get(t, 0) + 1
    avg, out = sum(dl.values()) / n, {}
    for q, _, term in asked:
        for t, d, tf in rows:
            if t == term:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                out[q, d] = out.get((q, d), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[d] / avg))
    return out


def test_bm25_scores_need_no_shuffle_and_no_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", d, int(rng.integers(1, 5))) for d in range(70) for t in {*(rng.zipf(1.3, 30) % 60).tolist()}]
    rows += [("twice", d, tf) for d in range(70) for tf in (1, 2)]  # more postings than pieces: its share is negative
    asked = [(f"q{q}", i, f"t{t}") for q in range(12) for i, t in enumerate(rng.integers(0, 65, 15).tolist())] + [("q0", 15, "twice"), ("only", 0, "twice"), ("none", 0, None)]
    posts, queries = spark.createDataFrame(rows, "term string, doc_ord long, tf int"), spark.createDataFrame(asked, "q string, pos int, term string")
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(bm25, "CELLS", 60)
    monkeypatch.setattr(bm25, "SENT", 50, raising=False)
    df = bm25.bm25_scores(posts, queries)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # a row for each query, piece and common term fills the disk
    got, want = {(r.q, r.doc_ord): r.score for r in df.collect()}, slow_scores(rows, asked)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(q == "only" and x < 0 for (q, _), x in got.items()) == 70
    short = {(r.q, r.doc_ord): r.score for r in bm25.bm25_scores(posts, queries, mask=posts.where("doc_ord < 9").select("doc_ord"), digits=3).collect()}
    assert short.keys() == {k for k in got if k[1] < 9} and all(abs(short[k] - got[k]) < 5.1e-4 and round(short[k], 3) == short[k] for k in short)
    assert bm25.half_away(np.array([0.5, 1.5, -0.5, -1.2, 2.4999])).tolist() == [1, 2, -1, -1, 2]


def test_bm25_top_k_under_a_mask_of_pieces(spark):
    rows = [(t, d, 1 + (d + i) % 3) for d in range(40) for i, t in enumerate(("de", f"t{d % 4}", f"u{d % 7}"))]
    asked = [(q, i, t) for q in (0, 1) for i, t in enumerate(("de", f"t{q}", "u3"))]
    posts, queries = spark.createDataFrame(rows, "term string, doc_ord long, tf int"), spark.createDataFrame(asked, "q long, pos int, term string")
    mask = spark.createDataFrame([(d,) for d in (*range(0, 40, 3), 3, 999)], "doc_ord long")
    got = bm25.bm25_top_k(posts, queries, 6, names=mask)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: round(x, 9) for k, x in slow_scores(rows, asked).items() if k[1] % 3 == 0}
    best = [(q, d, i) for q in (0, 1) for i, d in enumerate(sorted((d for p, d in want if p == q), key=lambda d: (-want[q, d], d))[:6], 1)]
    assert [(r.q, r.doc_ord, r["rank"]) for r in got.orderBy("q", "rank").collect()] == best


SHELF = [
    ("calendario#1", "vacina ighvz dose esquema", ["pediatria", "preventiva"], "f1", False, [1, 0, 0]),
    ("asma#1", "asma esquema dose", ["clinica-medica", "pediatria"], "f2", False, [0, 1, 0]),
    ("dm2#1", "diabete dieta", ["clinica-medica"], "f3", False, [0, 0, 1]),
    ("dm2#2", "diabete esquema dose dose", ["clinica-medica"], "f3", False, [0, 1, 1]),
    ("tb#1", "tuberculose esquema", ["clinica-medica", "preventiva"], "f4", False, [1, 1, 0]),
    ("tb#ref", "referencias", ["clinica-medica", "preventiva"], "f4", True, [1, 0, 1]),
]


def shelf(spark):
    rows = [(k, i, a, f, 2020, "texto", x, [float(y) for y in v], t) for k, (i, t, a, f, x, v) in enumerate(SHELF)]
    df = spark.createDataFrame(rows, "ord long, id string, areas array<string>, fonte_id string, ano int, tipo string, descartavel boolean, vec array<float>, texto string")
    return df, bm25.build_postings(df)


def run(spark, where=search.Filter(), n=2, **more):
    df, postings = shelf(spark)
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(["ighvz", "dose", "esquema"])], "q long, pos int, term string")
    vec = spark.createDataFrame([(0, [0.0, 1.0, 1.0])], "q long, qvec array<float>")
    return search.hybrid_search(df, postings, df.select("ord", "vec"), asked, vec, where, n=n, dims=3, **more).orderBy("ordem").collect()


def test_hybrid_shelf(spark):
    got = run(spark)
    assert [(r.id, r.garantido) for r in got if r.entregue] == [("dm2#2", False), ("calendario#1", True)]
    head = {r.id: r for r in got}["calendario#1"]
    assert (head.posicao_lexica, head.posicao_densa) == (1, 5)
    plain = {r.id: r for r in got}["dm2#1"]
    assert plain.posicao_lexica is None and plain.bm25 == 0 and abs(plain.cosseno - 0.5**0.5) < 1e-6
    assert len(got) == 5 and "tb#ref" not in {r.id for r in got}
    only = run(spark, search.Filter(areas=("pediatria",)))
    by = {r.id: (r.cosseno, r.bm25) for r in got}
    assert {r.id for r in only} == {"calendario#1", "asma#1"} and all((r.cosseno, r.bm25) == by[r.id] for r in only)
    assert len(run(spark, search.Filter(with_discardable=True))) == 6


def test_equal_vectors_across_the_cut_go_by_id(spark):
    rows = [(k, f"p#{99 - k}", [1.0, 0.0, 0.0] if k % 3 else [1.0, 0.1, 0.0]) for k in range(90)]  # ids fall as ord grows
    df = spark.createDataFrame([(*r[:2], ["a"], "f1", 2020, "texto", False, r[2]) for r in rows], "ord long, id string, areas array<string>, fonte_id string, ano int, tipo string, descartavel boolean, vec array<float>")
    posts = spark.createDataFrame([("x", 0, 1)], "term string, doc_ord long, tf int")
    asked = spark.createDataFrame([(0, 0, "nada")], "q long, pos int, term string")
    vec = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "q long, qvec array<float>")
    got = search.hybrid_search(df.repartition(3), posts, df.select("ord", "vec"), asked, vec, depth=20, dims=3).where("posicao_densa is not null")
    want = sorted(i for _, i, v in rows if v[1] == 0)[:20]
    assert [r.id for r in got.orderBy("posicao_densa").collect()] == want


def test_rerank_reorders_before_the_cut(spark):
    from pyspark.sql.window import Window

    flip = lambda df: df.withColumn("ordem", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("ordem"))))
    plain, turned = run(spark), run(spark, rerank=flip)
    assert [r.id for r in turned] == [r.id for r in plain][::-1] and sum(r.entregue for r in turned) == 2


def test_outside_boxes(spark):
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0)], "pag int, x0 double, x1 double, top double, bottom double")
    things = [(1, 1, 0.0, 20.0, 0.0, 20.0), (2, 1, 0.0, 20.2, 0.0, 20.0), (3, 2, 1.0, 2.0, 1.0, 2.0), (4, 1, None, 2.0, 1.0, 2.0)]
    objects = spark.createDataFrame(things, "k int, pag int, x0 double, x1 double, top double, bottom double")
    assert {r.k for r in geometry.outside_boxes(objects, boxes, ["pag"]).collect()} == {2, 3, 4}

"""Operators for training text against brute force and stated cases."""

import datetime as dt
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import containers, distinctive, leakage, lookalike, neighbours, rank_walk, scan_repair, shared_spans, splitting, term_counts
from folio.session import fresh_path

# --- 1


def scan(spark, lines, source="s"):
    rows = [(source, k, p, kind, t, dt.datetime(2025, 1, 1)) for k, (p, kind, t) in enumerate(lines)]
    schema = "fonte_id string, ord long, pagina int, tipo string, texto string, extraido_em timestamp"
    return spark.createDataFrame(rows + rows[:3], schema), spark.createDataFrame([("s", "Guia de asma grave", "Rede Vale Claro", 2020)], "id string, titulo string, orgao string, ano int")


def scanned():
    body = ["O paciente deve receber tratamento com dose segura e avaliação", "clínica em quatro semanas, conforme a resposta ao tratamento inicial."]
    out = []
    for p in range(1, 25):
        out += [(p, "texto", "Guia de asma grave" if p % 2 else "REDE VALE CLARO")]
        out += [(p, "texto", x) for x in body * 3]
        if p == 4:
            out += [(p, "texto", "O paciente deve receber trata-")]
        if p == 5:
            out[-7] = (p, "texto", "Guia de aşma grave")
            out.insert(len(out) - 6, (p, "texto", "mento com dose segura."))
        if p == 6:
            out += [(p, "texto", "O paciente deve reccber dose segura12 e avaliação.")]
        out += [(p, "tabela", "Guia de asma grave"), (p, "texto", f"- {p} -" if p != 9 else "- g -")]
    return [*out, (None, "texto", None), (None, "texto", "  ")]


def test_scan_noise(spark):
    blocks, sources = scan(spark, scanned())
    text = {r.ord: r.texto for r in blocks.collect()}
    got = defaultdict(set)
    for r in scan_repair.found_noise(blocks, sources).collect():
        got[r.ruido].add(r.ord)
    kinds = {r.ord: r.tipo for r in blocks.collect()}
    want = {k for k, t in text.items() if t and t.lower() in ("guia de asma grave", "rede vale claro", "guia de aşma grave") and kinds[k] == "texto"}
    assert got["cabecalho"] == want
    assert got["pagina"] == {k for k, t in text.items() if t and t.startswith("- ")}
    assert {text[k] for k in got["hifen"]} == {"O paciente deve receber trata-"}
    assert {text[k] for k in got["troca"]} == {"O paciente deve reccber dose segura12 e avaliação."}
    para = [r.texto for r in scan_repair.paragraphs(blocks, sources).collect()]
    assert any("deve receber tratamento com dose segura." in t for t in para) and not any("reccber" in t or "Rede Vale" in t for t in para)


def test_scan_of_nothing(spark):
    blocks, sources = scan(spark, scanned())
    assert scan_repair.found_noise(blocks.where("false"), sources).count() == 0
    assert scan_repair.paragraphs(blocks.where("false"), sources.where("false")).count() == 0


def test_scan_noise_needs_no_row_of_the_source(spark):
    blocks, sources = scan(spark, scanned())
    want = {tuple(r) for r in scan_repair.found_noise(blocks, sources).collect()}
    assert {tuple(r) for r in scan_repair.found_noise(blocks, sources.where("false")).collect()} == want


def test_running_forms_and_likeness(spark):
    pages = []
    for p in range(1, 31):
        pages += [(p, f"{'Precauções' if p < 12 else 'Doses'} — Rede Vale Claro {p}"), (p, "A dose deve ser dada em seis horas, e a avaliação repetida"), (p, f"{1 + p // 5}. MONITORAMENTO" if p % 5 == 0 else "em quatro semanas."), (p, f"Página {p} de 30")]
    rows = spark.createDataFrame([("s", k, p, t) for k, (p, t) in enumerate(pages)], "fonte_id string, ord long, pagina int, linha string")
    none = spark.createDataFrame([], "id string, titulo string, orgao string")
    forms = scan_repair.running_forms(rows, none)[0].first()
    assert "rede vale claro" in forms.formas and not {"monitoramento", "precauções", "página de"} & set(forms.formas)
    lines = ["12  Rede Vale Claro · edição de 2020", "Precauções — Rede Va1e Claro 7", "na rede vale o registro claro da dose", "Rede Vale Glaro", "Rede Va Cl4ro", "", "Rede"]
    df = spark.createDataFrame([(k, t, forms.formas) for k, t in enumerate(lines)], "k int, linha string, formas array<string>")
    df = df.withColumn("_l", scan_repair.line_forms(F.col("linha"))).select("k", scan_repair.likeness(F.col("formas")).alias("x"))
    assert [r.x for r in df.orderBy("k").collect()] == [2, 2, 0, 2, 1, 0, 0]


def test_page_numbers():
    assert [scan_repair.page_number(*x) for x in (("pág. 12", 12), ("Z9", 29), ("iv", 4), ("- l5 -", 15), ("313", 30), ("dias.", 3), ("12,5%", 12), ("Página 3 de 90", 3))] == [2, 2, 2, 2, 1, 0, 0, 2]


def test_paths_by_chunks_are_those_of_the_whole():
    rng = np.random.default_rng(8)
    obs = np.stack([rng.choice(3, 1500, p=p) for p in ([0.9, 0.02, 0.08], [0.9, 0.05, 0.05], [0.8, 0.1, 0.1], [0.6, 0.3, 0.1])], 1)
    model = scan_repair.starting_model()
    tables, moves = scan_repair.log_tables(model)
    e = scan_repair.log_emissions(obs, tables)
    score, back = e[0].copy(), []
    for row in e[1:]:
        to = score[:, None] + moves
        back.append(to.argmax(0))
        score = to.max(0) + row
    path = [int(score.argmax())]
    for x in back[::-1]:
        path.append(int(x[path[-1]]))
    assert (scan_repair.viterbi(obs, model) == np.array(path[::-1])).all()
    counts = scan_repair.expected_counts([obs[:700], obs[:1], obs[700:]], model)
    assert np.isclose(counts["likeness"].sum(), 1500) and all(len(scan_repair.viterbi(obs[:n], model)) == n for n in (0, 1, 2, 256, 257))
    refined = scan_repair.next_model(counts, 0.0)
    assert np.allclose(refined["moves"].sum(1), 1, atol=1e-4)


def test_hidden_characters_are_read_by_what_fits(spark):
    words = spark.createDataFrame([("terapia", 50), ("tera�ia", 1), ("ter□pia", 1), ("t·r·pia", 1), ("dose", 9), ("dos�", 1), ("dosa", 3)], "t string, n long")
    got = {r.t: r.w for r in scan_repair.misread_words(words).collect()}
    assert got["tera�ia"] == got["ter□pia"] == "terapia" and got["dos�"] == "dose" and got["t·r·pia"] is None


def test_long_paragraphs_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scan_repair, "LONGEST", 8)
    lines = [(1 + k // 10, "texto", "a dose deve ser dada em seis horas e depois") for k in range(40)]
    blocks, sources = scan(spark, lines)
    rows = scan_repair.paragraphs(blocks, sources).orderBy("ord", "parte").collect()
    assert len(rows) >= 5 and sum(len(r.texto.split()) for r in rows) == 40 * 10 and all(r.ord_final - r.ord < 48 for r in rows)


# --- 2


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 64))
    x = (centre[rng.integers(0, 40, 1200)] + 0.25 * rng.normal(size=(1200, 64))).astype("f4")
    x[600:900] = x[0]  # one vector under a quarter of the keys
    x[900] = 3 * x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (2000, None), (2001, [1.0]), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "ord long, vec array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, "ord", "vec").orderBy("ord", "posicao").collect():
        got[r.ord].append(r.vizinho)
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    true = [np.lexsort((np.arange(1200), -cos[i]))[:5].tolist() for i in range(1200)]
    assert set(got) == set(range(1200))
    hits = sum(len(set(got[i]) & set(true[i])) for i in range(1200)) / 6000
    assert hits >= 0.95
    assert all(got[i] == true[i] for i in range(600, 900))  # equal vectors: the smallest keys


@pytest.mark.parametrize("noise", [0, 1e-3, 1e-2])
def test_neighbours_in_a_hot_direction(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)).astype("f4")
    hot = rng.permutation(6000)[:3000]
    x[hot] = (x[0] + noise * rng.normal(size=(3000, 64))) * rng.uniform(0.01, 100, (3000, 1))  # one direction, many lengths
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, vec array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, "ord", "vec").orderBy("ord", "posicao").collect():
        got[r.ord].append(r.vizinho)
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    hits = sum(len({*got[i]} & {*np.lexsort((np.arange(6000), -cos[i]))[:5].tolist()}) for i in hot) / 15000
    assert hits == 1


@pytest.mark.parametrize("n", [0, 1, 2])
def test_neighbours_of_few(spark, n):
    df = spark.createDataFrame([(i, [1.0] * 63 + [float(i)]) for i in range(n)], "ord long, vec array<float>")
    assert neighbours.close_pairs(df).count() == (1 if n == 2 else 0)


# --- 3 and 6


def postings(spark, rows):
    return spark.createDataFrame([(*r, "f", 0) for r in rows], "term string, doc_ord long, tf int, fonte_id string, salt int")


DIRT = [("", 1, 1), (None, 1, 1), ("x", None, 1), ("x", 1, None), ("x", 1, 0), ("x", 1, -999)]


def some_postings(seed=1, n=300):
    rng = random.Random(seed)
    rows = {(f"t{rng.randint(0, 40)}", rng.randint(0, 60)): rng.choice([1, 1, 1, 2, 3, 5, 9]) for _ in range(n)}
    rows |= {("comum", d): 1 for d in range(61)} | {("raro", 3): 4}
    return [(t, d, tf) for (t, d), tf in rows.items()]


def test_distinctive_terms(spark):
    rows = some_postings()
    df = postings(spark, rows + rows[:20] + DIRT)
    total = Counter()
    for t, _, tf in rows:
        total[t] += tf
    want = {(d, t) for t, d, tf in rows if tf >= 3 and 2 * tf >= total[t]}
    assert {tuple(r) for r in distinctive.dominated_terms(df).collect()} == want and want
    s = {(r.term, r.doc_ord): r for r in distinctive.term_scores(df).collect()}
    assert len(s) == len(rows) and all(0 <= r.score <= 1 for r in s.values())
    assert s["raro", 3].log_odds > s["comum", 3].log_odds
    by = defaultdict(list)
    for r in s.values():
        by[r.term].append((r.tf, r.log_odds))
    assert all(a[1] <= b[1] + 1e-9 for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:]))  # more occurrences, more elite
    assert distinctive.term_scores(df.where("false")).count() == 0


@pytest.mark.parametrize("tfs", [[3, 1, 1], [4, 1, 1, 1, 1]])
def test_distinctive_terms_of_few_records(spark, tfs):
    df = postings(spark, [("x", d, tf) for d, tf in enumerate(tfs)])
    assert [tuple(r) for r in distinctive.dominated_terms(df).collect()] == [(0, "x")]


def test_em_finds_two_rates():
    rng = np.random.default_rng(0)
    n = 20_000
    elite = rng.random(n) < 0.2
    tf = np.where(elite, rng.poisson(6.0, n), rng.poisson(0.3, n))
    v, c = np.unique(tf[tf > 0], return_counts=True)
    w, low, high = distinctive.em_two_poisson(np.array([0]), v.astype("f8"), c.astype("f8"), n, 200)[0]
    assert abs(w - 0.2) < 0.02 and abs(low - 0.3) < 0.05 and abs(high - 6) < 0.2


def counts_of(rows):
    occ, docs = Counter(), defaultdict(set)
    for t, d, tf in rows:
        occ[t] += tf
        docs[t].add(d)
    return {t: (occ[t], len(docs[t])) for t in occ}


def test_term_counts_by_deltas(spark):
    first = some_postings(1)
    second = [(t, d, tf + (d % 3 == 0)) for t, d, tf in some_postings(1) if d % 5] + [("novo", 7, 2)]
    store = term_counts.TermCounts(spark, fresh_path(spark, "t"), buckets=8)
    a, b = postings(spark, first + first[:9] + DIRT), postings(spark, second + DIRT)
    store.merge(term_counts.signed_deltas(a))
    read = lambda: {r.term: (r.occurrences, r.records) for r in store.counts().collect()}
    assert read() == counts_of(first)
    store.merge(term_counts.signed_deltas(*term_counts.changes(a, b)))
    assert read() == counts_of(second)
    before = read()
    store.merge(term_counts.signed_deltas(*term_counts.changes(b, b)))
    assert read() == before
    marks = {r.term: r.marca for r in term_counts.marked(store.counts(), 61).collect()}
    assert marks["novo"] == "raro" and marks["t1"] is None or marks["t1"] in ("raro", None)
    store.merge(term_counts.signed_deltas(None, b))
    assert read() == {}


def test_changed_row_keeps_its_record_count(spark):
    a, b = postings(spark, [("t", 1, 2)]), postings(spark, [("t", 1, 5)])
    got = term_counts.signed_deltas(*term_counts.changes(a, b)).collect()
    assert [(r.term, r.occurrences, r.records) for r in got] == [("t", 3, 0)]


@pytest.mark.parametrize("before, after, want", [
    ([("t", 1, 2), ("t", 1, 5)], [("t", 1, 5)], [("t", -2, 0)]),  # one of two rows of a pair goes
    ([("t", 1, 3)], [("t", 1, 3), ("t", 1, 5)], [("t", 5, 0)]),  # a second row comes
    ([("t", 1, 3)], [], [("t", -3, -1)]),
    ([], [("t", 1, 3), ("t", 1, 4), ("t", 2, 1)], [("t", 8, 2)]),
    ([("t", 1, 3)], [("t", 2, 3)], []),  # another record, the same counts
])
def test_deltas_count_records_not_rows(spark, before, after, want):
    a, b = postings(spark, before), postings(spark, after)
    assert [tuple(r) for r in term_counts.signed_deltas(*term_counts.changes(a, b)).collect()] == want


def test_store_takes_late_rows_as_changes_and_survives_a_dead_merge(spark):
    rows = some_postings(3)
    day = dt.datetime(2025, 1, 1)
    rng = random.Random(9)
    timed = [(t, d, tf, day + dt.timedelta(days=rng.choice([0, 0, 0, 60]))) for t, d, tf in rows]
    timed += [(t, d, tf, day + dt.timedelta(days=90)) for t, d, tf, _ in timed[:40]]  # repeated, late
    timed += [(t, d, tf + 1, day + dt.timedelta(days=91)) for t, d, tf, _ in timed[40:80]] + [("so-tarde", 999, 2, day + dt.timedelta(days=92)), ("sem", 998, 1, None)]
    df = spark.createDataFrame([(*r, "x") for r in timed + [("", 1, 1, day), (None, 5, 1, day)]], "term string, doc_ord long, tf int, indexado_em timestamp, salt string")
    store = term_counts.stored_counts(df)
    want = counts_of({(t, d, tf) for t, d, tf, _ in timed})
    read = lambda: {r.term: (r.occurrences, r.records) for r in store.counts().collect()}
    assert read() == want and store.state()["records"] == len({d for _, d, _, _ in timed}) and store.state()["number"] == 2
    broken = df.select("term", F.lit(1).alias("occurrences"), F.raise_error(F.lit("lost")).cast("long").alias("records"))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken)
    assert read() == want
    same = store.state() | {"number": 2}
    with pytest.raises(RuntimeError):
        store._commit(same)  # a state is never overwritten


# --- 4


def searches(spark, seed=2):
    rng = random.Random(seed)
    rows = []
    for q in range(12):
        for i in range(rng.randint(1, 30)):
            rows.append((q, f"d{i}", *(rng.choice([None, float("nan"), rng.random() * 10**s, 0.5]) for s in range(3))))
    rows += rows[:30] + [(None, "a", 1.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "consulta_id long, id string, cosseno double, bm25 double, rrf double")


def winners(rows):
    best = defaultdict(dict)
    low = lambda x: float("-inf") if x is None or x != x else x
    for q, i, *s in rows:
        if q is not None and i is not None:
            best[q][i] = tuple(map(low, s))
    return {(q, i) for q, h in best.items() for i, s in h.items() if all(sum(x > y for x, y in zip(s, t)) >= 2 for j, t in h.items() if j != i)}


def test_rank_walk_small_and_large_agree(spark):
    rows, df = searches(spark)
    assert {tuple(r) for r in rank_walk.majority_winners(df).collect()} == winners(rows)
    one = df.where("consulta_id in (1, 2, 3)")
    cols = ["cosseno", "bm25", "rrf"]
    small = {(r.consulta_id, r.id): r for r in rank_walk.rank_walk(one, "consulta_id", "id", cols, rounds=8).collect()}
    large = {(r.consulta_id, r.id): r for r in rank_walk.rank_walk(one, "consulta_id", "id", cols, small=3, rounds=8, block=4).collect()}
    assert small.keys() == large.keys()
    for k, r in small.items():
        assert abs(r.mass - large[k].mass) < 1e-9 and r.place == large[k].place and r.champion == large[k].champion
    assert rank_walk.majority_winners(df.where("false")).count() == 0


def test_ties_go_by_id_on_both_paths(spark):
    df = spark.createDataFrame([(1, i, 0.5, 0.5, 0.5) for i in range(12)], "consulta_id long, id long, cosseno double, bm25 double, rrf double")
    cols = ["cosseno", "bm25", "rrf"]
    for small in (100, 3):
        got = rank_walk.rank_walk(df, "consulta_id", "id", cols, small=small, rounds=4, block=4).orderBy("place").collect()
        assert [r.id for r in got] == list(range(12)) and not any(r.champion for r in got)


def test_winner_is_among_the_candidates_of_the_walk():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 40))
        v = rng.integers(0, n, (n, 3)).astype("f8")
        v[0, rng.permutation(3)[:2]] = n + 1  # a winner that may be last on the third score
        v[0, v[0] < n] = -1
        if rng.random() < 0.5:  # or one that wins on different scores against different items
            v = np.stack([rng.permutation(n), rng.permutation(n), rng.permutation(n)], 1).astype("f8")
        mass = rank_walk.walk(v)
        win = [i for i in range(n) if all((v[i] > v[j]).sum() >= 2 for j in range(n) if j != i)]
        candidate = mass >= rank_walk.winner_bound(n, 3, 2)
        assert all(candidate[i] for i in win)
        best = rank_walk.majority_champion(v, np.argsort(-mass), candidate, 2)
        assert best == (win[0] if win else None)


def test_rank_walk_is_not_moved_by_scale():
    rng = np.random.default_rng(1)
    v = rng.random((50, 3))
    assert np.allclose(rank_walk.walk(v), rank_walk.walk(np.stack([v[:, 0] * 1e6, np.exp(v[:, 1]), v[:, 2] - 5], 1)))
    assert np.isclose(rank_walk.walk(v).sum(), 1)
    top = np.vstack([v, [2, 2, 2]])
    assert rank_walk.walk(top).argmax() == 50


# --- 5


def cut_class(t, limit=50):
    import re

    paras = t.split("\n")
    if max(map(len, paras)) <= limit:
        return "paragrafo"
    if max(len(s) for p in paras for s in re.split(r"(?<=[.!?])\s+", p)) <= limit:
        return "frase"
    return "espaco" if max(len(w) for w in t.split() or [""]) <= limit else "nenhum"


def test_splitting(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(200):
        words = ["x" * rng.choice([1, 3, 7, rng.randint(40, 70)]) + rng.choice(["", "", ".", "!", "é", "😀"]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words).strip())
    texts += [None, "", "   ", "\n\n", "a" * 120]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "ord long, texto string, secao string")
    got = {r.ord: r.corte for r in splitting.weakest_cut(df, "ord", "texto", 50).collect()}
    assert got == {i: cut_class(t) for i, t in enumerate(texts) if t and len(t) > 50}
    pieces = defaultdict(list)
    for r in splitting.split_pieces(df, "texto", ["ord", "secao"], 50, 0).orderBy("ord", "n").collect():
        pieces[r.ord].append(r)
    for i, t in enumerate(texts):
        own = pieces.get(i, [])
        assert "".join("".join(r.texto.split()) for r in own) == "".join((t or "").split())  # nothing lost
        assert all(len(r.texto) <= 50 and t[r.inicio : r.inicio + len(r.texto)] == r.texto for r in own)
    for r in splitting.split_pieces(df, "texto", ["ord"], 50, 12).collect():
        assert len(r.texto) <= 50 and texts[r.ord][r.inicio : r.inicio + len(r.texto)] == r.texto
    with pytest.raises(ValueError):
        splitting.split_pieces(df, "texto", ["ord"], 50, 50)


def test_splitting_leaves_texts_within_the_limit_whole(spark):
    texts = ["a b. " * n for n in (7, 8, 9, 10)] + ["x" * 39, "x" * 50, "a b\n" * 12 + "c", ("y" * 47 + "\n") + "z" * 20, "x" * 51]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, texto string")
    got = defaultdict(list)
    for r in splitting.split_pieces(df, "texto", ["ord"], 50, 12).orderBy("ord", "n").collect():
        got[r.ord].append(r)
    for i, t in enumerate(texts[:7]):
        assert [(r.inicio, r.texto, r.corte) for r in got[i]] == [(0, t, "paragrafo")]
    assert got[7][0].texto == "y" * 47 and got[7][0].corte == "paragrafo" and len(got[7]) == 2
    assert len(got[8][0].texto) == 50 and len(got[8]) == 2


# --- 7


def test_lookalikes(spark):
    same = ["ação α-bloq 5 µg", "a​ção α‑bloq 5 μg", "ação α-bloq 5 µg", "ａção α-bloq ５ µg", "аçãо α‐bloq　5 μg", "ação α-bloq 5 µg"]
    other = ["Ação α-bloq 5 µg", "acao α-bloq 5 µg", "ação α-bloq 6 µg", "", None, "ѐ", "è"]
    rows = list(enumerate(same + other)) + [(0, same[0]), (None, same[0])]
    df = spark.createDataFrame(rows, "ord long, texto string").withColumn("forma", F.lit(1))
    got = {tuple(r) for r in lookalike.lookalike_pairs(df, "ord", "texto").collect()}
    n = len(same)
    want = {(a, b) for a, b in combinations(range(n), 2) if (same + other)[a] != (same + other)[b]} | {(n + 5, n + 6)}
    assert got == want
    assert lookalike.lookalike_pairs(df.where("false"), "ord", "texto").count() == 0
    forms = {r.ord: r.x for r in lookalike.one_form(df.drop("forma"), "texto", "x").collect()}
    assert forms[1] == "ação α-bloq 5 μg" and forms[n + 4] is None and forms[n + 3] == ""


# --- 8


def test_packing(spark):
    rng = random.Random(5)
    texts = [" ".join("dose" for _ in range(rng.choice([1, 5, 20, 60, 250]))) for _ in range(300)] + ["", None, "dose " * 3]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = containers.pack_texts(df, "doc_id", "text", capacity=100, group=100).collect()
    size, load = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.doc_id] += r.tokens
        load[r.recipiente] += r.tokens
        assert r.tokens <= 100 and (r.parte == 0 or r.inicio == 100 * r.parte)
    count = {r.doc_id: r.tokens for r in containers.token_counts(df, "doc_id", "text").collect()}
    assert dict(size) == count and 301 not in size and size[300] == 0
    assert max(load.values()) <= 100
    assert all(sum(1 for r in rows if r.doc_id == d) == max(1, -(-t // 100)) for d, t in count.items())
    open_room: list[int] = []  # best fit of the same items, for comparison
    for t in sorted((r.tokens for r in rows), reverse=True):
        fits = [i for i, x in enumerate(open_room) if x >= t]
        if fits:
            open_room[min(fits, key=open_room.__getitem__)] -= t
        else:
            open_room.append(100 - t)
    assert len(load) <= 1.03 * len(open_room) + 3
    assert containers.pack_texts(df.where("false"), "doc_id", "text").count() == 0


def test_packing_balances_cost():
    at = containers.pack(np.array([60, 60, 20, 20, 20, 20]), 100)
    assert sorted(np.bincount(at, [60, 60, 20, 20, 20, 20])) == [100, 100]


# --- 9


def leaks_by_force(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leakage.words_of(t)] for i in range(len(w) - n + 1)}
    d, i = ({k: grams(t) for k, t in x} for x in (docs, items))
    return {(a, b) for a in d for b in i if d[a] & i[b]}


def test_leakage(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["dose", "ação", "É", "asma", "de", "a", "5", "µg", "x²"])
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rng.randint(0, 80))]
        src = rng.choice(items[:30])[1].split()
        s = rng.randint(0, len(src))
        docs.append((k, " ".join(own + [w.upper() for w in src[s : s + rng.randint(8, 20)]] + own[:9])))
    docs += [(500, None), (501, ""), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit(0))
    i = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("i", F.lit(0))
    want = leaks_by_force(docs, items)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == want and len(want) > 20
    old, leakage.BLOCK_WORDS = leakage.BLOCK_WORDS, 400
    try:
        assert {tuple(r) for r in leakage.leaks(d, i).collect()} == want  # several passes
    finally:
        leakage.BLOCK_WORDS = old
    assert leakage.leaks(d.where("false"), i).count() == 0 and leakage.leaks(d, i.where("false")).count() == 0


# --- 10


def shared_by_force(docs, n):
    at = defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - n + 1):
            at[t[i : i + n]].add(k)
    pairs = {p for s in at.values() for p in combinations(sorted(s), 2)}
    cover = {}
    for k, t in docs:
        marks = [False] * len(t or "")
        for i in range(len(t or "") - n + 1):
            if len(at[t[i : i + n]]) > 1:
                marks[i : i + n] = [True] * n
        cover[k] = sum(marks)
    return pairs, cover


def test_window_and_block_hashes():
    t = "ação 😀 " * 40
    h = shared_spans.window_hashes(t, 16)
    assert len(h) == len(t) - 15 and (shared_spans.block_hashes(t, 16) == h[::16][: len(t) // 16]).all()
    assert h[0] == h[7] == shared_spans.window_hashes("x" + t[:16], 16)[1] != h[1]
    assert len(shared_spans.window_hashes("abc", 4)) == len(shared_spans.block_hashes("", 4)) == 0


@pytest.mark.parametrize("passes", [None, 4, 1])
def test_shared_spans(spark, passes, monkeypatch):
    if passes:  # small bitmaps: the same result in several passes, and by the join
        monkeypatch.setattr(shared_spans, "MOST_BITS", 1 << 14)
        monkeypatch.setattr(shared_spans, "MOST_PASSES", passes)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgé😀 ") for _ in range(n))
    base = [text(rng.randint(30, 150)) for _ in range(8)]
    docs = []
    for k in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            s = rng.randint(0, 20)
            parts += [b[s : s + rng.randint(15, 130)], text(rng.randint(0, 30))]
        docs.append((k, "".join(parts)))
    docs += [(100, docs[1][1] + "x" * 50), (101, docs[1][1] + "x" * 50), (102, "x" * 90), (103, None), (104, ""), (105, "z" * 200)]
    pairs, cover = shared_by_force(docs, 20)
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").withColumn("h", F.lit(0))
    assert {tuple(r) for r in shared_spans.shared_pairs(df, least=20).collect()} == pairs and len(pairs) > 20
    got = {r.doc_id: r.compartilhado for r in shared_spans.shared_coverage(df, least=20).collect()}
    assert got == cover
    assert shared_spans.shared_pairs(df.where("false")).count() == 0

"""Problem 1: repairing text from scanned pages, by a hidden Markov model over lines.

Every line of a source is labelled as running line (cabecalho), page number (pagina), body (corpo)
or break (quebra: a heading, a list item or the first line of a paragraph) by the Viterbi path of a
hidden Markov model. Its observations are layout features: likeness to what the source prints on
many of its pages, shape and value of a page number, place on the page, and how the line opens after
the one before. What a source prints on its pages is found by repetition: forms (parts of a line
between rules, letters only) that open or close at least REPEATED of its pages and three of them,
besides its title and organ where these are known; likeness is the built-in edit distance to them.

The model starts from stated tables and is refined by expectation-maximisation over all segments:
each round sums expected counts over all of them. Words cut at line ends and misread words are then
settled by the words of the whole collection, and paragraphs are put together again.

A source is worked off in segments of SEGMENT places of the reading order, each with HALO places of
its neighbours, so the largest source is split like any other. Repeated rows meet in their segment
and count once. A misread word is one whose strokes (what scanning confuses is one stroke: rn and m,
0 and o, c and e, ...) are those of a word RATIO times as frequent: one aggregation over words. A word
with a sign that hides a character is read as the most frequent word that fits around the sign.

Defined cases: blocks with null source, place or kind are dropped; null and blank texts have no
line; a null page takes its neighbours' page; blocks of kind 'tabela' are left out; sources without
a row of their own have the running lines that repetition shows; a paragraph that goes on for more
than LONGEST places comes in several rows (parte).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.session import discard, written

SEGMENT, HALO = 2048, 64
CHUNK = 256  # lines that a path is sought for at a time, with HALO lines on either side
LONGEST = 8192  # places of a paragraph in one row
REPEATED = 0.1  # share of a source's pages that a running line opens or closes
ROUNDS, PRIOR = 3, 5000.0  # of the refinement; the starting tables weigh as so many observations of each state
RATIO = 20
SENT_OUT = 100_000  # rows that a table may have to be sent to every task
STATES = ["cabecalho", "pagina", "corpo", "quebra"]
HYPHENS = "-‐‑­¬"

# Starting tables of the model: rows are the states, columns the values of a feature.
START = {
    "likeness": [[0.0001, 0.0999, 0.90], [0.98, 0.01, 0.01], [0.985, 0.01, 0.005], [0.97, 0.02, 0.01]],
    "number": [[0.97, 0.02, 0.01], [0.0001, 0.0999, 0.90], [0.985, 0.01, 0.005], [0.985, 0.01, 0.005]],
    "place": [[0.05, 0.85, 0.10], [0.05, 0.85, 0.10], [0.80, 0.09, 0.11], [0.80, 0.09, 0.11]],
    "opening": [[0.20, 0.60, 0.20], [0.50, 0.40, 0.10], [0.97, 0.02, 0.01], [0.02, 0.73, 0.25]],
}
MOVES = [[0.02, 0.08, 0.60, 0.30], [0.60, 0.02, 0.28, 0.10], [0.03, 0.03, 0.79, 0.15], [0.02, 0.02, 0.86, 0.10]]
FEATURES = list(START)
LOWER_ENDS = frozenset("abcdefghijklmnopqrstuvwxyzáâãàéêíóôõúüç.;")  # no heading in capitals ends so

_ROMAN = re.compile(r"[ivxlc]+\Z", re.I)
_DIGIT = "0-9oOlIiZzSsBbGqg"  # digits and the letters they are misread as
_NUMBER = re.compile(
    rf"\W*(?:p[áa@]?[gq9]\w*\W*)?(?P<n>[{_DIGIT}□�·@]*|[ivxlc]+)(?:\s*(?:/|de)\s*[{_DIGIT}□�·@]+)?\W*\Z", re.I
)
_AS_DIGIT = str.maketrans("oOlIiZzSsBbGqg", "00111225588699"[:14])
_HEADING = re.compile(r"(?:\d+(?:\.\d+)*\.?\s+)?[A-ZÀ-Þ][A-ZÀ-Þ\s,:()\-]{3,88}\Z")
_BULLET = re.compile(r"\s*[•▪‣\-–]\s")
_EDGE = rf"\A\s*(?:[{_DIGIT}]{{1,4}}|[ivxlc]+)\s+(?=\S{{3,}})|[\s|,/·—-]+(?:[{_DIGIT}]{{1,4}}|[ivxlc]+)\s*\z"


def letters(c: Column) -> Column:
    """Lower-case letters and single spaces: what is compared of a running line."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-zà-ÿ]+", " "))


def whole_form(line: Column) -> Column:
    """The letters of a line without the page number at either end."""
    return letters(F.regexp_replace(F.regexp_replace(line, _EDGE, ""), _EDGE, ""))


def line_forms(line: Column) -> Column:
    """array<string>: the letters of the line and of its parts between rules, without page numbers at either end."""
    parts = F.transform(F.split(line, r"\s*[—–|·]\s*|\s-\s"), lambda x: letters(F.regexp_replace(x, _EDGE, "")))
    return F.array_distinct(F.filter(F.concat(F.array(letters(line), whole_form(line)), parts), lambda x: F.length(x) >= 6))


def running_forms(rows: DataFrame, fonte: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((fonte_id, formas, maior), (fonte_id, pagina, de, ate)): what each source prints on its pages, with the length of
    the longest form, and where the text of each page begins and ends (page numbers left out)."""
    line = F.struct("ord", "linha")
    number, section = r"(?iU)\A" + _NUMBER.pattern.replace("?P<", "?<"), r"\A\s*\d+(?:\.\d+)*\.\s"
    # a long line is neither a number nor without letters: only short ones are looked at closely
    text = (F.length("linha") > 60) | (F.length(letters(F.col("linha"))) >= 6) & ~F.col("linha").rlike(number)
    pages = rows.where("pagina is not null").where(text).groupBy("fonte_id", "pagina").agg(F.min(line).alias("a"), F.max(line).alias("b"))
    pages = written(pages.select("fonte_id", "pagina", "a", "b", F.col("a.ord").alias("de"), F.col("b.ord").alias("ate")), "pages")
    sizes = pages.groupBy("fonte_id").agg(F.count("*").alias("paginas"))
    edge = pages.select("fonte_id", "pagina", F.explode(F.array_distinct(F.array("a.linha", "b.linha"))).alias("linha"))
    edge = edge.where(~F.col("linha").rlike(section))
    edge = written(edge.select("fonte_id", "pagina", "linha", F.explode(line_forms(F.col("linha"))).alias("forma")), "edges")
    # of each line only the part that the source prints on most pages counts: a heading beside it is none
    counts = edge.groupBy("fonte_id", "forma").agg(F.countDistinct("pagina").alias("n"))
    chosen = edge.join(counts, ["fonte_id", "forma"]).groupBy("fonte_id", "pagina", "linha").agg(F.max(F.struct("n", F.length("forma").alias("m"), "forma")).alias("x"))
    # and the line as a whole, should the rule between its parts be misread
    whole = chosen.select("fonte_id", "pagina", whole_form(F.col("linha")).alias("forma"))
    chosen = chosen.select("fonte_id", "pagina", "x.forma").unionByName(whole.where(F.length("forma") >= 6))
    often = chosen.groupBy("fonte_id", "forma").agg(F.countDistinct("pagina").alias("n")).join(sizes, "fonte_id")
    often = written(often.where((F.col("n") >= 3) & (F.col("n") >= REPEATED * F.col("paginas"))).select("fonte_id", "forma", "n"), "often")
    # what stands within pages more often than at their edges is text that repeats
    most, few = often.agg(F.max(F.length("forma")), F.count("*")).first()
    every = rows.where(F.length("linha").between(6, (most or 0) + 24)).select("fonte_id", letters(F.col("linha")).alias("forma"))
    inside = every.join(F.broadcast(often) if few <= SENT_OUT else often, ["fonte_id", "forma"]).groupBy("fonte_id", "forma", "n").agg(F.count("*").alias("m"))
    often = often.join(inside.where("m > 2 * n"), ["fonte_id", "forma"], "left_anti").select("fonte_id", "forma")
    names = fonte.where("id is not null").select(F.col("id").alias("fonte_id"), F.explode(F.array(letters(F.col("titulo")), letters(F.col("orgao")))).alias("forma"))
    every = often.unionByName(names.where(F.length("forma") >= 6)).groupBy("fonte_id").agg(F.collect_set("forma").alias("formas"))
    # a form is on a tenth of the pages at least and a page has few: the array is short
    every = written(every.withColumn("maior", F.array_max(F.transform("formas", F.length))), "forms")
    return every, pages.select("fonte_id", "pagina", "de", "ate")


def likeness(forms: Column) -> Column:
    """2: a part of the line (_l) is a form, give or take one character in ten; 1: one in five; 0: it is not."""
    far = lambda x, f: F.when(F.abs(F.length(x) - F.length(f)) <= F.length(f) / 5, F.levenshtein(x, f) / F.length(f))
    least = F.array_min(F.flatten(F.transform("_l", lambda x: F.transform(forms, lambda f: F.when(x == f, 0.0).otherwise(far(x, f))))))
    return F.when(least <= 0.1, 2).when(least <= 0.2, 1).otherwise(0)


def roman(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s.lower()]
    return sum(-x if i + 1 < len(v) and v[i + 1] > x else x for i, x in enumerate(v))


def page_number(text: str, page: float | None) -> int:
    """2: only a page number, that of the page; 1: only something shaped like one; 0: neither."""
    t = text.strip()
    if not t or "\n" in t or t.endswith((".", ",", "%")):
        return 0
    m = _NUMBER.match(t)
    if not m or not m["n"] or (m["n"].isalpha() and not _ROMAN.match(m["n"]) and not re.search(r"[\d\W]", t)):
        return 0
    n = m["n"]
    values = set()
    if _ROMAN.match(n):
        values.add(roman(n))
    d = n.translate(_AS_DIGIT)
    if d.isdigit():
        values.add(int(d))
    if page is not None and page == page and int(page) in values:
        return 2
    return 1 if re.search(r"\d", n) or _ROMAN.match(n) or re.search(r"[-—|\[\]/]", t) else 0


def observe(seg: pd.DataFrame) -> pd.DataFrame:
    """Lines (ord, n, texto, features) of a segment's text blocks in reading order."""
    pages = seg.pagina.ffill().bfill().to_numpy()
    texts, ords, likes = seg.texto.to_numpy(), seg.ord.to_numpy(), seg.like.to_numpy()
    change = np.flatnonzero(np.concatenate([[True], pages[1:] != pages[:-1]])) if len(pages) else np.zeros(0, int)
    size = np.diff(np.append(change, len(pages)))
    first, last = np.repeat(change, size), np.repeat(change + size - 1, size)
    offs = np.minimum(np.arange(len(pages)) - first, last - np.arange(len(pages)))
    places = np.where(offs == 0, 1, np.where(offs == 1, 2, 0))
    ended, rows = True, []
    for ord_, t, page, like0, place in zip(ords.tolist(), texts.tolist(), pages.tolist(), likes.tolist(), places.tolist()):
        for n, line in enumerate(t.split("\n") if "\n" in t else (t,)):
            s = line.strip()
            if not s:
                continue
            like, num = (like0, page_number(t, page)) if n == 0 else (0, 0)
            heading = len(s) <= 106 and s[-1] not in LOWER_ENDS and _HEADING.match(s) is not None
            if heading or _BULLET.match(line):
                opening = 2
            else:
                opening = 1 if ended and (s[0].isupper() or s[0].isdigit() or not s[0].isalnum()) else 0
            rows.append((ord_, n, line, like, num, place, opening))
            if like < 2 and num == 0:
                ended = s[-1] in ".!?:" or heading and s[-1] not in HYPHENS
    return pd.DataFrame(rows, columns=["ord", "n", "texto", *FEATURES])


def log_tables(model: dict) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.log(np.asarray(model[f])) for f in FEATURES], np.log(np.asarray(model["moves"]))


def log_emissions(obs: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return sum(t[:, obs[:, k]].T for k, t in enumerate(tables))


def _chunks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, own): for each chunk the places of its lines with HALO on either side (-1 beyond the ends), and which are its own."""
    starts = np.arange(0, n, CHUNK)[:, None]
    at = starts + np.arange(-HALO, CHUNK + HALO)
    own = (np.arange(at.shape[1]) >= HALO) & (np.arange(at.shape[1]) < HALO + CHUNK) & (at < n)
    return np.where((at >= 0) & (at < n), at, -1), own


def viterbi(obs: np.ndarray, model: dict) -> np.ndarray:
    """The most probable states of a sequence of feature rows: by chunks with a halo, all chunks at a time."""
    if not len(obs):
        return np.zeros(0, int)
    tables, moves = log_tables(model)
    at, own = _chunks(len(obs))
    e = np.where((at >= 0)[:, :, None], log_emissions(obs, tables)[at], 0.0)
    # where there is no line the state stays as it is and nothing is added
    stay = np.where(np.eye(len(moves)) > 0, 0.0, -1e9)
    back = np.zeros(e.shape, "i1")
    score = e[:, 0] + np.log(1 / len(moves))
    for i in range(1, e.shape[1]):
        none = (at[:, i] < 0) | (at[:, i - 1] < 0)
        to = score[:, :, None] + np.where(none[:, None, None], stay, moves)
        back[:, i] = to.argmax(1)
        score = to.max(1) + e[:, i]
    every = np.arange(len(at))
    state, path = score.argmax(1), np.zeros(at.shape, int)
    for i in range(e.shape[1] - 1, -1, -1):
        path[:, i] = state
        state = back[every, i, state]
    return path[own]


def expected_counts(sequences: list[np.ndarray], model: dict) -> dict:
    """Expected observations of each state and moves between states (Baum-Welch), over chunks of all sequences at a time."""
    counts = {f: np.zeros(np.shape(START[f])) for f in FEATURES} | {"moves": np.zeros(np.shape(MOVES))}
    parts = [s[i : i + CHUNK] for s in sequences for i in range(0, len(s), CHUNK) if len(s) - i > 1]
    if not parts:
        return counts
    tables, lm = log_tables(model)
    m, size = np.exp(lm), np.array([len(p) for p in parts])
    obs = np.zeros((len(parts), CHUNK, len(FEATURES)), int)
    for k, p in enumerate(parts):
        obs[k, : len(p)] = p
    there = np.arange(CHUNK) < size[:, None]
    e = log_emissions(obs.reshape(-1, len(FEATURES)), tables).reshape(len(parts), CHUNK, -1)
    e = np.where(there[:, :, None], np.exp(e - e.max(2, keepdims=True)), 1.0)
    a, b = np.ones_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, CHUNK):
        a[:, i] = (a[:, i - 1] @ m) * e[:, i]
        a[:, i] /= a[:, i].sum(1, keepdims=True)
    for i in range(CHUNK - 2, -1, -1):
        x = np.where(there[:, i + 1, None], (b[:, i + 1] * e[:, i + 1]) @ m.T, 1.0)
        b[:, i] = x / x.sum(1, keepdims=True)
    g = a * b
    g = g / g.sum(2, keepdims=True) * there[:, :, None]
    x = a[:, :-1, :, None] * m * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    counts["moves"] = (x / x.sum((2, 3), keepdims=True) * there[:, 1:, None, None]).sum((0, 1))
    for k, f in enumerate(FEATURES):
        for v in range(counts[f].shape[1]):
            counts[f][:, v] = g[obs[:, :, k] == v].sum(0)
    return counts


def starting_model() -> dict:
    return {f: np.asarray(START[f]) for f in FEATURES} | {"moves": np.asarray(MOVES)}


def next_model(counts: dict, prior: float = PRIOR) -> dict:
    """The model of expected counts, to which the starting tables are added."""
    whole = {k: counts[k] + prior * v for k, v in starting_model().items()}
    return {k: np.maximum(v / v.sum(1, keepdims=True), 1e-6) for k, v in whole.items()}


def segments(bloco: DataFrame, fonte: DataFrame) -> DataFrame:
    """Text blocks with their likeness to running lines and the segments they belong to or border on."""
    rows = bloco.where("fonte_id is not null and ord is not null and tipo = 'texto' and trim(coalesce(texto, '')) <> ''")
    rows = rows.select("fonte_id", "ord", "pagina", "texto", F.trim(F.substring_index("texto", "\n", 1)).alias("linha"))
    forms, pages = running_forms(rows, fonte)
    sent = lambda df: F.broadcast(df) if df.count() <= SENT_OUT else df  # noqa: E731 - short rows, one a source or page
    rows = rows.join(sent(forms), "fonte_id", "left").join(sent(pages), ["fonte_id", "pagina"], "left")
    # a running line is among the first two or last two of its page: only these are taken apart
    edge = F.col("de").isNull() | (F.col("ord") <= F.col("de") + 1) | (F.col("ord") >= F.col("ate") - 1)
    rows = rows.withColumn("_l", F.when(edge & F.length("linha").between(6, 2 * F.col("maior") + 40), line_forms(F.col("linha"))))
    rows = rows.withColumn("like", likeness(F.col("formas")).cast("int")).select("fonte_id", "ord", "pagina", "texto", "like")
    low, high = F.floor((F.col("ord") - HALO) / SEGMENT), F.floor((F.col("ord") + HALO) / SEGMENT)
    return rows.withColumn("seg", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["ord", "texto"]).drop_duplicates("ord").reset_index(drop=True)


def fitted_model(parts: DataFrame) -> dict:
    """The model refined on all segments: their features are written once, and each round adds up their expected counts."""

    def features(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf.seg.iloc[0])
        lines = observe(_ordered(pdf))
        own = ((lines.ord // SEGMENT).clip(lower=0) == seg).to_numpy()
        return pd.DataFrame({"obs": [lines[FEATURES].to_numpy("i1")[own].tobytes()]})

    seen = written(parts.groupBy("fonte_id", "seg").applyInPandas(features, "obs binary"), "features")
    model, names = starting_model(), [*FEATURES, "moves"]
    for _ in range(ROUNDS):

        def count(batches: Iterator[pd.DataFrame], model: dict = model) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), 64):
                    some = [np.frombuffer(x, "i1").reshape(-1, len(FEATURES)).astype(int) for x in b.obs.iloc[i : i + 64]]
                    c = expected_counts(some, model)
                    yield pd.DataFrame([(k, j, float(x)) for k in names for j, x in enumerate(c[k].ravel())], columns=["table", "at", "x"])

        sums = seen.mapInPandas(count, "table string, at int, x double").groupBy("table", "at").agg(F.sum("x").alias("x")).collect()  # a fixed number of cells
        counts = {k: np.zeros(np.shape(model[k])) for k in names}
        for r in sums:
            counts[r.table].flat[r["at"]] = r.x
        model = next_model(counts)
    discard(seen)
    return model


def labelled_lines(bloco: DataFrame, fonte: DataFrame) -> DataFrame:
    """(fonte_id, seg, ord, n, texto, estado, junta, segue): every line with its label.

    junta: the last piece of a body line and the first of the body line after it, as (left, mark, right),
    if both are letters; segue: the line opens with the rest of a word that the line before may have begun.
    """
    parts = segments(bloco, fonte)
    held = bloco.sparkSession.sparkContext.broadcast(fitted_model(parts))
    left = re.compile(rf"([^\W\d_]+(?:[-‐][^\W\d_]+)*)([{HYPHENS}]?)\s*\Z")
    right = re.compile(r"\s*((?=[\d@□�·]*[^\W\d_])[\w@□�·]+(?:-[^\W\d_]+)*)")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        source, seg = pdf.fonte_id.iloc[0], int(pdf.seg.iloc[0])
        pdf = _ordered(pdf)
        lines = observe(pdf)
        states = viterbi(lines[FEATURES].to_numpy(int), held.value)
        text = lines.texto.to_numpy()
        body = np.flatnonzero(states >= 2)
        joints: list[tuple | None] = [None] * len(lines)
        follows = [False] * len(lines)
        body = [i for i in body if not text[i].strip().isdigit()]  # a number alone continues no word
        for i, j in zip(body, body[1:]):
            a, b = left.search(text[i]), right.match(text[j])
            if a and b and (a[2] or b[1].islower()):
                joints[i] = (a[1], a[2], b[1])
                follows[j] = bool(a[2])
        out = pd.DataFrame(
            {
                "fonte_id": source,
                "seg": seg,
                "ord": lines.ord,
                "n": lines.n,
                "texto": text,
                "estado": [STATES[s] for s in states],
                "esquerda": [x and x[0] for x in joints],
                "marca": [x and x[1] for x in joints],
                "direita": [x and x[2] for x in joints],
                "segue": follows,
            }
        )
        return out[(lines.ord // SEGMENT).clip(lower=0) == seg]

    schema = "fonte_id string, seg long, ord long, n int, texto string, estado string, esquerda string, marca string, direita string, segue boolean"
    return written(parts.groupBy("fonte_id", "seg").applyInPandas(label, schema), "lines")


def tokens(text: Column) -> Column:
    """Runs without white space, stripped of punctuation at the ends, in lower case."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"\A[^\p{L}\p{N}@□\x{fffd}·]+|[^\p{L}\p{N}@□\x{fffd}·]+\z", "")
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), bare), lambda t: t != "")


def body_words(lines: DataFrame) -> DataFrame:
    """(fonte_id, ord, t): words of the body but for those at a line end or start that may be cut."""
    t = tokens(F.col("texto"))
    skip = F.when(F.col("segue"), 2).otherwise(1)
    less = F.when(F.col("marca") != "", 1).otherwise(0)
    body = lines.where("estado in ('corpo', 'quebra')").select("fonte_id", "ord", t.alias("ts"), skip.alias("skip"), less.alias("less"))
    return body.select("fonte_id", "ord", F.explode(F.slice("ts", F.col("skip"), F.greatest(F.size("ts") - F.col("skip") + 1 - F.col("less"), F.lit(0)))).alias("t"))


# Characters and the strokes they share with what scanning takes them for.
_ACCENTS = "áàâãäåéèêëíìîïóòôõöúùûüñý", "aaaaaaeeeeiiiiooooouuuuny"
_SAME = "çęe1i!0569@t", "ccclllosbgaf"
_STROKES = [("ﬁ", "fl"), ("ﬂ", "fl"), ("w", "vl"), ("m", "rrl"), ("n", "rl"), ("u", "ll"), ("h", "ll"), ("d", "cl")]


def strokes(t: Column) -> Column:
    """One form for words that scanning confuses."""
    flat = F.translate(t, _ACCENTS[0], _ACCENTS[1])
    flat = F.translate(flat, _SAME[0], _SAME[1])
    for a, b in _STROKES:
        flat = F.replace(flat, F.lit(a), F.lit(b))
    return flat


def vocabulary(words: DataFrame) -> DataFrame:
    """(t, n): how often each word stands in the body of the collection."""
    return words.groupBy("t").agg(F.count("*").alias("n"))


def misread_words(words: DataFrame) -> DataFrame:
    """(t, w): words that are misread, and the word they stand for (null if a sign hides it)."""
    # 6 stands for b as well as for ó
    readings = F.array_distinct(F.array(strokes(F.col("t")), strokes(F.replace(F.col("t"), F.lit("6"), F.lit("o")))))
    s = words.withColumn("s", F.explode(readings))
    best = s.where(~F.col("t").rlike(r"[\d@□\x{fffd}·ﬁﬂ]") & (F.length("t") >= 2)).groupBy("s").agg(F.max(F.struct("n", "t")).alias("b"))
    odd = F.col("t").rlike(r"[\d@ﬁﬂ]")
    near = s.join(best, "s").select("t", "n", F.col("b.t").alias("w"), F.col("b.n").alias("m"), odd.alias("odd"))
    letters_only = F.length("t") >= 5
    enough = F.when(letters_only | F.col("odd"), F.col("m") >= RATIO * F.col("n")).otherwise(F.col("m") >= 10 * RATIO * F.col("n"))
    near = near.where((F.col("t") != F.col("w")) & F.col("t").rlike(r"\p{L}") & (F.length("w") >= 3) & enough)
    near = near.groupBy("t", "n", "odd").agg(F.max(F.struct("m", "w")).alias("b")).select("t", "n", "odd", "b.m", "b.w")
    # a number of a reference call glued to a word leaves that word
    stem = F.regexp_replace("t", r"\d[\d,–-]*\z", "")
    calls = near.where(F.col("t").rlike(r"\p{L}\d[\d,–-]*\z")).withColumn("stem", stem)
    calls = calls.join(words.select(F.col("t").alias("stem"), F.col("n").alias("k")), "stem").where(F.col("k") * RATIO >= F.col("m")).select("t")
    near = near.join(calls, "t", "left_anti").select("t", "w")
    hidden = words.where(F.col("t").rlike(r"\p{L}.*[□\x{fffd}·]|[□\x{fffd}·].*\p{L}") & (F.length("t") >= 3)).select("t", F.translate("t", "□\ufffd·", "???").alias("mask"))
    # every word with each of its characters hidden in turn: the most frequent one that fits is what was printed
    plain = words.where(F.col("t").rlike(r"\A[\p{L}-]+\z") & (F.length("t") >= 3) & (F.col("n") >= 2))
    masks = plain.select("t", "n", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    masks = masks.select(F.concat(F.substring("t", 1, F.col("i") - 1), F.lit("?"), F.expr("substring(t, i + 1)")).alias("mask"), "n", "t")
    masks = masks.join(hidden.select("mask").distinct(), "mask", "left_semi").groupBy("mask").agg(F.max(F.struct("n", "t")).alias("b"))
    hidden = hidden.join(masks, "mask", "left").select("t", F.col("b.t").alias("w"))
    signs = words.where(F.col("t").rlike(r"\A[\p{L}@-]*@[\p{L}@-]*\z") & (F.length("t") >= 3)).join(near, "t", "left_anti")
    signs = signs.select("t", F.regexp_replace("t", "@", "a").alias("w"))
    return near.unionByName(hidden).unionByName(signs)


def cut_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(fonte_id, ord, n, inteira): body lines that end in the first half of a word, and the whole word.

    A mark at the line end cuts a word unless the collection rather has the word with a hyphen; without
    a mark, the two halves must make a word far more frequent than either alone.
    """
    a, b = F.lower("esquerda"), F.lower("direita")
    last = F.regexp_extract(a, r"([^-‐]+)\z", 1)
    first = F.regexp_extract(b, r"\A([^-‐]+)", 1)
    rows = lines.where("esquerda is not null and estado in ('corpo', 'quebra')").select(
        "fonte_id", "ord", "n", "marca", a.alias("a"), b.alias("b"), F.concat(a, b).alias("ab"), F.concat(a, F.lit("-"), b).alias("ahb"), last.alias("la"), first.alias("fb")
    )
    asked = rows.select(F.explode(F.array("ab", "ahb", "a", "b")).alias("t")).distinct()
    known = written(asked.join(words, "t"), "joints")
    look = lambda df, c: df.join(known.select(F.col("t").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    for c in ("ab", "ahb", "a", "b"):
        rows = look(rows, c)
    z = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    marked = (F.col("marca") != "") & (z("ab") >= z("ahb")) & ((z("ab") > 0) | (z("ahb") == 0) & ((z("a") == 0) | (z("b") == 0)))
    bare = (F.col("marca") == "") & (z("ab") >= 5) & (z("a") * RATIO < z("ab")) & (z("b") * RATIO < z("ab")) & (F.length("a") >= 2) & (F.length("b") >= 2)
    return rows.where(marked | bare).select("fonte_id", "ord", "n", F.col("ab").alias("inteira"))


def _repairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(misread words by block, cut words by line)."""
    occurrences = body_words(lines)
    words = written(vocabulary(occurrences), "words")
    wrong = written(misread_words(words), "misread")
    # most words are among the frequent ones: those rows need not travel (at most 20,000 words are sent out)
    usual = words.orderBy(F.desc("n"), "t").limit(20_000).join(wrong, "t", "left_anti").select("t")
    rare = occurrences.join(F.broadcast(usual), "t", "left_anti").distinct()
    return rare.join(wrong, "t").select("fonte_id", "ord", "t", "w"), cut_words(lines, words)


def found_noise(bloco: DataFrame, fonte: DataFrame) -> DataFrame:
    """(fonte_id, ord, ruido): running lines, page numbers, cut words and misread words by block."""
    lines = labelled_lines(bloco, fonte)
    wrong, cut = _repairs(lines)
    kind = lambda df, k: df.select("fonte_id", "ord", F.lit(k).alias("ruido"))
    furniture = lines.where("n = 0 and estado = 'cabecalho'"), lines.where("n = 0 and estado = 'pagina'")
    out = kind(furniture[0], "cabecalho").unionByName(kind(furniture[1], "pagina"))
    return out.unionByName(kind(cut, "hifen")).unionByName(kind(wrong, "troca")).distinct()


def paragraphs(bloco: DataFrame, fonte: DataFrame) -> DataFrame:
    """(fonte_id, ord, linha, parte, ord_final, texto): paragraphs of each source's body in reading order, by the place
    and line where they open, with cut words joined and misread words replaced; parte is 0 but for very long ones."""
    lines = labelled_lines(bloco, fonte)
    wrong, cut = _repairs(lines)
    fixes = wrong.where("w is not null").groupBy("fonte_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("trocas"))
    body = lines.where("estado in ('corpo', 'quebra')")
    opens = F.when(F.col("estado") == "quebra", F.struct("ord", "n"))
    # the last opening before a segment: one row a segment goes through the window, not one a line
    ends = body.groupBy("fonte_id", "seg").agg(F.max(opens).alias("ultima"))
    before = Window.partitionBy("fonte_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("fonte_id", "seg", F.last("ultima", ignorenulls=True).over(before).alias("antes"))
    within = Window.partitionBy("fonte_id", "seg").orderBy("ord", "n").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.struct(F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("n"))
    body = body.join(ends, ["fonte_id", "seg"]).withColumn("p", F.coalesce(F.last(opens, ignorenulls=True).over(within), "antes", zero))
    body = body.join(cut, ["fonte_id", "ord", "n"], "left").join(fixes, ["fonte_id", "ord"], "left")
    body = body.withColumn("parte", F.floor((F.col("ord") - F.greatest(F.col("p.ord"), F.lit(0))) / LONGEST).cast("int"))
    rows = body.groupBy("fonte_id", "p", "parte").agg(
        F.sort_array(F.collect_list(F.struct("ord", "n", "texto", F.col("inteira").isNotNull().alias("cortada"), F.map_entries("trocas").alias("trocas")))).alias("x")
    )
    word = re.compile(r"\S+")

    def mend(line: str, fixes: dict[str, str]) -> str:
        def one(m: re.Match) -> str:
            t = m[0]
            core = t.strip(".,;:()[]\"“”?!•")
            w = fixes.get(core.lower())
            if not w:
                return t
            w = w.upper() if core.isupper() and len(core) > 1 else w.capitalize() if core[:1].isupper() else w
            return t.replace(core, w)

        return word.sub(one, line)

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, p, part, x in zip(b.fonte_id, b.p, b.parte, b.x):
                text, glue = "", ""
                for r in x:
                    line = re.sub(r"\s+", " ", mend(r["texto"], {e["key"]: e["value"] for e in (r["trocas"] if r["trocas"] is not None else [])})).strip()
                    text += glue + line
                    glue = " "
                    if r["cortada"]:
                        text, glue = text.rstrip(HYPHENS), ""
                    elif text.endswith(tuple(HYPHENS)):
                        text, glue = text[:-1] + "-", ""
                out.append((source, p["ord"], p["n"], part, x[-1]["ord"], unicodedata.normalize("NFC", text)))
            yield pd.DataFrame(out, columns=["fonte_id", "ord", "linha", "parte", "ord_final", "texto"])

    return rows.mapInPandas(put_together, "fonte_id string, ord long, linha int, parte int, ord_final long, texto string")

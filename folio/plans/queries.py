"""Queries of the core by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import config
from folio.functions import text as tx
from folio.functions import tokens as tk
from folio.functions import vectors as vx
from folio.operators import bm25, boundaries, caption, chunk, dense, fusion, geometry, search, select
from folio.plans import index
from folio.plans.index import content_hash
from folio.sources import blocks as bl
from folio.session import written
from folio.sources import cache, manifest
from folio.sources.tables import read_table as table
from folio.streaming import runlog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- tables as they are used: repeated rows once, the latest of late ones -----------------------------------------


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pedaco").drop("gravado_em").dropDuplicates(["ord"])


def postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.valid_postings(table(spark, d, "posting"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fonte").dropDuplicates(["id"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matriz").where(vx.is_valid(F.col("vec"), 64)).groupBy("ord").agg(F.max("vec").alias("vec"))


def piece_queries(spark: SparkSession, d: str) -> DataFrame:
    """(q, pos, term): every piece whose place is divisible by 50 asks with its own terms, without function words."""
    own = postings(spark, d).where(F.col("doc_ord") % 50 == 0)
    cased = F.col("term").endswith(config.CASE_MARK)
    plain = F.when(cased, tk.fold(F.regexp_replace("term", r"\|C\z", ""))).otherwise(F.col("term"))
    own = own.where(~plain.isin(*config.FUNCTION_WORDS))
    w = Window.partitionBy("doc_ord").orderBy("term")
    return own.select(F.col("doc_ord").alias("q"), F.row_number().over(w).alias("pos"), "term")


_P = "p as (select distinct on (ord) * exclude (gravado_em) from pedaco)"
_C = "c as (select distinct term, doc_ord, tf from posting where term is not null and term <> '' and doc_ord is not null and tf > 0)"
_F = "f as (select distinct on (id) * from fonte)"
_V = """v as (select ord, max(vec)::double[] as vec from matriz where len(vec) = 64 and len(list_filter(vec, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(vec, lambda x: x <> 0)) > 0 group by ord)"""
_STOP = ", ".join(f"'{w}'" for w in config.FUNCTION_WORDS)
_Q = f"""q as (select doc_ord as q, row_number() over (partition by doc_ord order by term) as pos, term from c where doc_ord % 50 = 0
  and case when term like '%|C' then replace(lower(strip_accents(replace(term, '|C', ''))), 'ß', 'ss') else term end not in ({_STOP}))"""
_STATS = """dl as (select doc_ord, sum(tf)::double as dl from c group by doc_ord), st as (select count(*)::double as n, avg(dl) as avgdl from dl),
  df as (select term, count(*)::double as df from c group by term),
  pt as (select c.term, c.doc_ord, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as part
    from c join df using (term) join dl using (doc_ord), st)"""
_SCORES = f"{_C}, {_Q}, {_STATS}, s as (select q, doc_ord, sum(round(part * 1e12)::bigint)::double / 1e12 as score from q join pt using (term) group by q, doc_ord)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_FROM, _TO = "'µμ²³¹ºª\u00a0\u3000\u2007\u2009\u202f'", "'uu231oa     '"
# cleaning: glued reference calls go, token by token; RE2 has no look-around, so what stands around a call is kept by groups
_ADDRESS = r"(?i)https?://|www\.|\.[A-Za-z]{2,5}(?:/|\?|$)|\.(?:com|org|net|gov|edu|int|br|pdf|html?)(?:[^A-Za-z0-9_]|$)"
_CALLS = (
    rf"case when regexp_matches(t, '{_ADDRESS}') then t else regexp_replace(regexp_replace(t, "
    r"'([A-Za-zÀ-ÿ)])[0-9]+(?:–[0-9]+)?(?:,[0-9]+(?:–[0-9]+)?)+([^\pL\pN_]|$)', '\1\2', 'g'), "
    r"'([A-Za-zÀ-ÿ]{4}[a-zà-ÿ])[0-9]+($|[.,]$|[.,][^0-9]|[^\pL\pN_.,])', '\1\2', 'g') end"
)
_CLEANED = rf"regexp_replace(array_to_string(list_transform(string_split(replace(regexp_replace(coalesce(x, ''), '[\x{{E000}}-\x{{F8FF}}]', '-', 'g'), chr(160), ' '), ' '), lambda t: {_CALLS}), ' '), '[ \t]+', ' ', 'g')"
_PLAIN_SPACES = r"regexp_replace(coalesce(texto, ''), '[\x{00A0}\x{3000}\x{2007}\x{2009}\x{202F}]', ' ', 'g')"


# --- cleaning and normalising -----------------------------------------------------------------------------------


@query(
    rf"""with l as (select doc_id, unnest(a) as x, unnest(range(len(a))) as ord from (select distinct doc_id, regexp_split_to_array(text, '\r\n|\n|\r') as a from documents where text is not null)),
    k as (select doc_id, ord, {_strip(_CLEANED)} as texto from l)
    select doc_id, ord, texto from k where texto <> ''"""
)
def doc_blocks(spark, d):
    return bl.document_blocks(table(spark, d, "documents"))


@query(f"select distinct fonte_id, ord, {_strip(_CLEANED.replace('coalesce(x', 'coalesce(texto'))} as texto from bloco")
def clean_text(spark, d):
    return table(spark, d, "bloco").select("fonte_id", "ord", tx.clean(F.col("texto")).alias("texto")).distinct()


@query(f"select doc_id, replace(lower(strip_accents(translate(text, {_FROM}, {_TO}))), 'ß', 'ss') as dobrado from documents where text is not null")
def fold_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tk.fold(F.col("text")).alias("dobrado"))


@query(
    """select fonte_id, ord, array_to_string(list_transform(list_filter(list_transform(string_split(texto, chr(10)),
      lambda r: list_transform(string_split(r, '|'), lambda x: trim(x))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0), lambda r: array_to_string(r, ' | ')), chr(10)) as tabela
    from (select distinct fonte_id, ord, texto from bloco where tipo = 'tabela' and texto is not null)"""
)
def table_text(spark, d):
    rows = table(spark, d, "bloco").where("tipo = 'tabela' and texto is not null").select("fonte_id", "ord", "texto").distinct()
    cells = F.transform(F.split("texto", "\n"), lambda r: F.split(r, r"\|"))
    return rows.select("fonte_id", "ord", tx.table_text(cells).alias("tabela"))


@query(f"with {_P} select ord, substr(sha256(texto), 1, 16) as digest from p")
def text_digest(spark, d):
    return pieces(spark, d).select("ord", tx.digest(F.col("texto")).alias("digest"))


_SLUG = "substr(lower(trim(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', '-', 'g'), '-')), 1, 24)"
_KEY = f"""fonte_id || '#' || case when {_SLUG.format('parte')} <> '' then {_SLUG.format('parte')} || '/' else '' end ||
  case when coalesce(secao, '') <> '' then secao when {_SLUG.format('titulo_secao')} <> '' then {_SLUG.format('titulo_secao')} else 'preambulo' end"""


@query(f"with {_P}, k as (select ord, {_KEY} as chave from p) select ord, chave || '.' || row_number() over (partition by chave order by ord) as id from k")
def slug_ids(spark, d):
    return chunk.with_ids(pieces(spark, d).drop("id"), ["ord"]).select("ord", "id")


_SECTION = "concat_ws('. ', nullif(coalesce(secao, ''), ''), nullif(coalesce(titulo_secao, ''), ''))"
_HEADER = f"""concat_ws(' — ', titulo_fonte || ' (' || orgao || ', ' || ano || ')', nullif(coalesce(parte, ''), ''), coalesce(nullif({_SECTION}, ''), '(sem seção)'),
  'p. ' || pagina_inicial || case when pagina_final <> pagina_inicial then '-' || pagina_final else '' end)"""
_FRAME = f"concat_ws(' — ', titulo_fonte || ' (' || ano || ')', nullif(coalesce(parte, ''), ''), nullif({_SECTION}, ''))"


@query(f"with {_P} select ord, {_HEADER} as cabecalho, {_FRAME} as moldura from p")
def citation_labels(spark, d):
    return pieces(spark, d).select("ord", tx.header().alias("cabecalho"), tx.frame().alias("moldura"))


_CAPTIONED = rf"""{_P}, k as (select *, case when tipo = 'texto' then regexp_extract_all(texto, '(?m)^[ \t]*((?:Quadro|Tabela)\s*[0-9]{{1,2}}[ \t]*[.:–-][^\n]*)', 1) end as ls from p),
  l as (select *, case when len(ls) > 0 then {_strip("ls[len(ls)]")} end as lg from k),
  m as (select *, case when tipo = 'tabela' then coalesce(last_value(lg ignore nulls) over (partition by fonte_id, parte, secao order by ord rows between unbounded preceding and 1 preceding), '') else '' end as legenda from l)"""


@query(f"with {_CAPTIONED} select ord, legenda from m where tipo = 'tabela'")
def caption_asof(spark, d):
    return caption.with_captions(pieces(spark, d)).where("tipo = 'tabela'").select("ord", "legenda")


@query(
    rf"""with {_CAPTIONED}, t as (select ord, legenda, {_strip(_PLAIN_SPACES)} as s, {_FRAME} as fr from m)
    select ord, sha256(concat_ws(chr(10), nullif(fr, ''), nullif(legenda, ''), nullif(s, ''))) as denso, sha256({_strip("legenda || chr(10) || s")}) as lexico from t"""
)
def arm_texts(spark, d):
    rows = caption.with_captions(pieces(spark, d)).withColumn("texto", F.regexp_replace("texto", r"[\x{00A0}\x{3000}\x{2007}\x{2009}\x{202F}]", " "))
    c = F.col("legenda")
    return rows.select("ord", F.sha2(tx.dense_text(c).cast("binary"), 256).alias("denso"), F.sha2(tx.lexical_text(c).cast("binary"), 256).alias("lexico"))


# --- tokens and the inverted index ------------------------------------------------------------------------------

_FOLDED = f"replace(lower(strip_accents(translate(text, {_FROM}, {_TO}))), 'ß', 'ss')"
_TOKENS = f"regexp_extract_all({_FOLDED}, '[0-9a-z]+(?:[./,\\-][0-9a-z]+)*')"


@query(
    f"""with t as (select doc_id, unnest({_TOKENS}) as token from (select distinct doc_id, text from documents where text is not null))
    select doc_id, token, count(*) as tf from t group by doc_id, token"""
)
def tokenize_base(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    words = docs.select("doc_id", F.explode(tk.base_tokens(tk.fold(F.col("text")))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


# a thousands dot is one between a digit and exactly three digits; a distinct list keeps the first of equal values
_TH = """array_to_string(list_transform(string_split({0}, '.'), lambda p, i: case when i = 1 then p
  when regexp_matches(string_split({0}, '.')[i - 1], '[0-9]$') and regexp_matches(p, '^[0-9]{{3}}([^0-9]|$)') then p else '.' || p end), '')"""
_GLUE = "regexp_replace(" + _TH.format("token") + ", '[-/]', '', 'g')"
_FORMS = f"""case when len(parts) > 1 then list_concat([token, {_TH.format("token")}], flatten(list_transform(parts, lambda s: [s, {_TH.format("s")}])),
  case when length({_GLUE}) <= 8 and regexp_matches({_GLUE}, '[a-z]') then [{_GLUE}] else [] end) else [token, {_TH.format("token")}] end"""
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_PARTS = "list_filter(regexp_split_to_array(token, '[-/]'), lambda s: s <> '')"


@query(
    f"""with t as (select distinct unnest({_TOKENS}) as token from prova_item where text is not null), p as (select token, {_PARTS} as parts from t), f as (select token, {_FORMS} as fs from p),
    d as (select token, {_DISTINCT.format("fs")} as fs from f) select token, unnest(range(len(fs)))::int as ordem, unnest(fs) as forma from d"""
)
def token_forms(spark, d):
    """Every distinct token of the items with its forms (thousands, segments, glued), by built-in functions."""
    items = table(spark, d, "prova_item").where("text is not null")
    words = items.select(F.explode(tk.base_tokens(tk.fold(F.col("text")))).alias("token")).distinct()
    return words.select("token", F.posexplode(tk.token_forms(F.col("token"))).alias("ordem", "forma"))


_RAW = "regexp_extract_all(text, '[0-9A-Za-zÀ-ÖØ-öø-ÿµμ²³¹ºª]+(?:[./,\\-][0-9A-Za-zÀ-ÖØ-öø-ÿµμ²³¹ºª]+)*')"


@query(
    f"""with i as (select distinct item_id, text from prova_item), r as (select item_id, {_RAW} as rs from i), u as (select item_id, unnest(rs) as text, unnest(range(len(rs))) as n from r),
    t as (select item_id, n, text as raw, {_FOLDED} as token from u), p as (select *, {_PARTS} as parts from t), f as (select *, {_FORMS} as fs from p),
    d as (select item_id, n, list_concat({_DISTINCT.format("fs")}, case when length(raw) <= 5 and raw <> lower(raw) then [raw || '|C'] else [] end) as fs from f),
    e as (select item_id, n, unnest(range(len(fs))) as k, unnest(fs) as token from d),
    k as (select * from e where case when token like '%|C' then replace(lower(strip_accents(replace(token, '|C', ''))), 'ß', 'ss') else token end not in ({_STOP}))
    select item_id, (row_number() over (partition by item_id order by n, k) - 1)::int as pos, token from k"""
)
def item_tokens(spark, d):
    """Query tokens of the items: all forms and cased tokens, without function words."""
    items = table(spark, d, "prova_item").select("item_id", "text").distinct()
    return items.select("item_id", F.posexplode(tk.query_tokens(F.col("text"))).alias("pos", "token"))


@query(
    f"""with t as (select item_id, unnest({_TOKENS}) as token from (select distinct item_id, text from prova_item where text is not null))
    select item_id, token, count(*) as n from t where token not in ({_STOP}) group by item_id, token"""
)
def query_tokens(spark, d):
    items = table(spark, d, "prova_item").where("text is not null").select("item_id", "text").distinct()
    words = items.select("item_id", F.explode(tk.drop_function_words(tk.base_tokens(tk.fold(F.col("text"))))).alias("token"))
    return words.groupBy("item_id", "token").agg(F.count("*").alias("n"))


# texts of characters that no readable copy of a piece would show otherwise
_READABLE = r"^[\n -~À-ÖØ-öø-ÿ•–—≥≤µ²³¹ºª°]*$"


@query(
    f"""with {_P}, {_C} select c.term, c.doc_ord, c.tf from c join p on p.ord = c.doc_ord where p.texto is not null and regexp_matches(p.texto, '{_READABLE}')"""
)
def term_frequencies(spark, d):
    """The inverted index made by the full tokenizer from the pieces whose stored text is its own readable copy:
    the given postings come from such copies."""
    rows = pieces(spark, d).where(F.col("texto").rlike(_READABLE.replace("^", r"\A").replace("$", r"\z")))
    return bm25.build_postings(rows)


@query()
def term_frequencies_all(spark, d):
    """The inverted index made by the full tokenizer from all pieces as they are stored."""
    return bm25.build_postings(pieces(spark, d))


@query(f"with {_C} select term, count(*) as df, sum(tf)::bigint as occurrences from c group by term")
def doc_frequencies(spark, d):
    return bm25.doc_frequencies(postings(spark, d))


@query(f"with {_C} select doc_ord, sum(tf)::bigint as dl from c group by doc_ord")
def doc_lengths(spark, d):
    return bm25.doc_lengths(postings(spark, d))


@query(f"with {_C}, l as (select doc_ord, sum(tf) as dl from c group by doc_ord) select count(*) as n, round(avg(dl), 6) as avgdl from l")
def corpus_stats(spark, d):
    return bm25.corpus_stats(bm25.doc_lengths(postings(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"""with {_C}, d as (select count(distinct doc_ord)::double as n from c), t as (select term, count(*) as df from c group by term)
    select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) as idf from t, d"""
)
def idf(spark, d):
    p = postings(spark, d)
    got = bm25.idf(bm25.doc_frequencies(p), bm25.corpus_stats(bm25.doc_lengths(p)))
    return got.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_SCORES} select q, doc_ord, round(score, 6) as score from s")
def bm25_scores(spark, d):
    asked = written(piece_queries(spark, d), "asked")
    return bm25.bm25_scores(postings(spark, d), asked, digits=6)


@query(f"with {_SCORES}, r as (select q, doc_ord, round(score, 9) as score, row_number() over (partition by q order by round(score, 9) desc, doc_ord) as rank from s) select q, doc_ord, round(score, 6) as score, rank from r where rank <= 50")
def bm25_topk(spark, d):
    asked = written(piece_queries(spark, d), "asked")
    return bm25.bm25_top_k(postings(spark, d), asked).withColumn("score", F.round("score", 6))


@query(
    f"""with {_SCORES}, {_P}, m as (select ord from p where not coalesce(descartavel, false) and tipo = 'texto'),
    r as (select q, doc_ord, round(score, 9) as score, row_number() over (partition by q order by round(score, 9) desc, doc_ord) as rank from s where doc_ord in (select ord from m))
    select q, doc_ord, round(score, 6) as score, rank from r where rank <= 50"""
)
def bm25_masked(spark, d):
    mask = pieces(spark, d).where(search.Filter(kinds=("texto",)).column()).select(F.col("ord").alias("doc_ord"))
    asked = written(piece_queries(spark, d), "asked")
    return bm25.bm25_top_k(postings(spark, d), asked, names=mask).withColumn("score", F.round("score", 6))


@query(f"with {_SCORES.replace('sum(round(', '2 * sum(round(')} select q, doc_ord, round(score, 6) as score from s")
def bm25_repeated_term(spark, d):
    """Every query token twice: a repeated token counts again."""
    twice = piece_queries(spark, d).withColumn("pos", F.explode(F.array(2 * F.col("pos"), 2 * F.col("pos") + 1)))
    return bm25.bm25_scores(postings(spark, d), written(twice, "asked"), digits=6)


# --- the dense arm ----------------------------------------------------------------------------------------------


@query(f"with {_V} select ord, round(sqrt(list_inner_product(vec, vec)), 6) as norma, round(vec[1] / sqrt(list_inner_product(vec, vec)), 6) as primeira from v")
def l2_normalize(spark, d):
    v = F.col("vec")
    return vectors(spark, d).select("ord", F.round(vx.norm(v), 6).alias("norma"), F.round(F.element_at(vx.l2_normalize(v), 1), 6).alias("primeira"))


_COS = f"{_V}, s as (select a.ord as q, b.ord, list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec)) / sqrt(list_inner_product(b.vec, b.vec)) as cosine from v a, v b where a.ord % 50 = 0)"


@query(f"with {_COS}, r as (select *, row_number() over (partition by q order by round(cosine, 12) desc, ord) as rank from s) select q, ord, round(cosine, 6) as cosine, rank from r where rank <= 50")
def dense_topk(spark, d):
    v = vectors(spark, d)
    asked = v.where("ord % 50 = 0").select(F.col("ord").alias("q"), F.col("vec").alias("qvec"))
    return dense.dense_top_k(v, asked).withColumn("cosine", F.round("cosine", 6))


@query(
    """with e as (select vec_id, embedding::double[] as v from embeddings), s as (select a.vec_id as q, b.vec_id, list_cosine_similarity(a.v, b.v) as c from e a, e b where a.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by q order by round(c, 12) desc, vec_id) as rank from s) select q, vec_id, round(c, 6) as cosine, rank from r where rank <= 8"""
)
def embeddings_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    return dense.dense_top_k(e, asked, 8, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


# --- fusion and search ------------------------------------------------------------------------------------------

_LOGGED = """h as (select distinct consulta_id as q, id, posicao_densa, posicao_lexica from achado where consulta_id is not null and id is not null),
  l as (select q, id, posicao_densa as rk from h where posicao_densa is not null union all select q, id, posicao_lexica from h where posicao_lexica is not null),
  s as (select q, id, sum(1.0::double / (60 + rk)) as rrf, min(rk) as best from l group by q, id),
  u as (select *, row_number() over (partition by q order by round(rrf, 12) desc, id) as fused from s)"""


def logged_lists(spark, d) -> list[DataFrame]:
    h = table(spark, d, "achado").where("consulta_id is not null and id is not null")
    h = h.select(F.col("consulta_id").alias("q"), "id", "posicao_densa", "posicao_lexica").distinct()
    return [h.where(F.col(c).isNotNull()).select("q", "id", F.col(c).alias("rank")) for c in ("posicao_densa", "posicao_lexica")]


@query(f"with {_LOGGED} select q, id, round(rrf, 9) as rrf, fused from u")
def rrf_fused(spark, d):
    return fusion.rrf(logged_lists(spark, d)).select("q", "id", F.round("rrf", 9).alias("rrf"), "fused")


_GIVEN = """k as (select *, best <= 1 as head, row_number() over (partition by q, best <= 1 order by round(rrf, 12) desc, id) as hr, sum((best <= 1)::int) over (partition by q) as nh from u),
  g as (select *, row_number() over (partition by q order by round(rrf, 12) desc, id) as posicao from k where head or (fused <= 8 and hr <= 8 - nh))"""


@query(f"with {_LOGGED}, {_GIVEN} select q, id, round(rrf, 9) as rrf, posicao, fused > 8 as garantido from g where posicao <= 8")
def guaranteed_delivery(spark, d):
    got = fusion.guarantee(fusion.rrf(logged_lists(spark, d)))
    return got.select("q", "id", F.round("rrf", 9).alias("rrf"), "posicao", "garantido")


def _hybrid(spark, d, where: search.Filter) -> DataFrame:
    v = vectors(spark, d)
    asked = v.where("ord % 50 = 0").select(F.col("ord").alias("q"), F.col("vec").alias("qvec"))
    return search.hybrid_search(pieces(spark, d), postings(spark, d), v, piece_queries(spark, d), asked, where)


def _hybrid_sql(mask: str) -> str:
    return f"""with {_SCORES}, {_V}, {_P}, al as (select ord, id from p where {mask}),
    x as (select q, id, score, row_number() over (partition by q order by round(score, 9) desc, id) as rk from s join al on al.ord = s.doc_ord),
    co as (select a.ord as q, b.ord, list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec)) / sqrt(list_inner_product(b.vec, b.vec)) as cosine from v a, v b where a.ord % 50 = 0),
    y as (select q, id, cosine, row_number() over (partition by q order by round(cosine, 12) desc, id) as rk from co join al using (ord)),
    l as (select q, id, rk from x where rk <= 50 union all select q, id, rk from y where rk <= 50),
    s2 as (select q, id, sum(1.0::double / (60 + rk)) as rrf, min(rk) as best from l group by q, id),
    u as (select *, row_number() over (partition by q order by round(rrf, 12) desc, id) as fused from s2), {_GIVEN}
    select g.q, g.id, round(g.rrf, 9) as rrf, g.fused > 8 as garantido, y.rk as posicao_densa, x.rk as posicao_lexica
    from g left join (select * from x where rk <= 50) x using (q, id) left join (select * from y where rk <= 50) y using (q, id) where posicao <= 8"""


def _delivered(df: DataFrame) -> DataFrame:
    return df.where("entregue").select("q", "id", F.round("rrf", 9).alias("rrf"), "garantido", "posicao_densa", "posicao_lexica")


@query(_hybrid_sql("not coalesce(descartavel, false)"))
def hybrid_batch(spark, d):
    return _delivered(_hybrid(spark, d, search.Filter()))


@query(_hybrid_sql("not coalesce(descartavel, false) and coalesce(list_has_any(areas, ['pediatria', 'clinica-medica']), false) and coalesce(ano >= 2000 and ano in (2015, 2016, 2017, 2018, 2019, 2020), false)"))
def hybrid_filtered(spark, d):
    return _delivered(_hybrid(spark, d, search.Filter(areas=("pediatria", "clinica-medica"), years=tuple(range(2015, 2021)))))


def _log_sql(mask: str) -> str:
    head, _, _ = _hybrid_sql(mask).rpartition("select g.q, g.id")
    return f"""{head} select u.q, u.id, row_number() over (partition by u.q order by g.posicao nulls last, u.fused)::int as ordem, x.rk as posicao_lexica, y.rk as posicao_densa,
      round(cv.cosine, 6) as cosseno, round(coalesce(sv.score, 0), 6) as bm25, round(u.rrf, 9) as rrf, coalesce(g.posicao <= 8 and g.fused > 8, false) as garantido
    from u left join (select * from g where posicao <= 8) g using (q, id) left join (select * from x where rk <= 50) x using (q, id) left join (select * from y where rk <= 50) y using (q, id)
      left join x sv on sv.q = u.q and sv.id = u.id left join y cv on cv.q = u.q and cv.id = u.id"""


@query(_log_sql("not coalesce(descartavel, false)"))
def run_log(spark, d):
    """The log of the searches: every candidate with its place, both ranks and both raw scores."""
    log = runlog.run_log(_hybrid(spark, d, search.Filter()))
    rows = log.select("q", F.explode("candidatos").alias("c")).select("q", "c.*")
    return rows.select("q", "id", "ordem", "posicao_lexica", "posicao_densa", F.round("cosseno", 6).alias("cosseno"), F.round("bm25", 6).alias("bm25"), F.round("rrf", 9).alias("rrf"), "garantido")


@query(f"with {_P} select ord, id from p where coalesce(list_has_any(areas, ['pediatria', 'urgencia']), false) and not coalesce(descartavel, false)")
def area_overlap_filter(spark, d):
    return pieces(spark, d).where(search.Filter(areas=("pediatria", "urgencia")).column()).select("ord", "id")


@query(
    f"""with {_P} select ord, id from p where coalesce(list_has_any(areas, ['pediatria', 'clinica-medica', 'saude-mental']), false)
    and coalesce(ano in (2016, 2019, 2022), false) and coalesce(tipo = 'texto', false)"""
)
def filter_composed(spark, d):
    f = search.Filter(areas=("pediatria", "clinica-medica", "saude-mental"), years=(2016, 2019, 2022), kinds=("texto",), with_discardable=True)
    return pieces(spark, d).where(f.column()).select("ord", "id")


# --- selection --------------------------------------------------------------------------------------------------

_REASONS = r"(?i)METODOLOGIA\s+DE\s+BUSCA|EQUIPE\s+DE\s+ELABORA[ÇCçc][ÃAãa]O|PARTES\s+INTERESSADAS"
_COND = rf"""b as (select distinct fonte_id, parte from {{0}} where regexp_matches(parte, '(?i)^\s*(AP[ÊEêe]NDICE|ANEXO)\b')
  and (regexp_matches(parte, '{_REASONS}') or regexp_matches(coalesce(titulo_secao, ''), '{_REASONS}') or regexp_matches(substr(coalesce(texto, ''), 1, 120), '{_REASONS}')))"""


@query(f"with {_P} select ord, fonte_id from p where fonte_id not in (select substitui from fonte where substitui is not null)")
def superseded_anti(spark, d):
    return pieces(spark, d).join(select.superseded(table(spark, d, "fonte")), "fonte_id", "left_anti").select("ord", "fonte_id")


@query(
    f"""with {_P}, r as (select * from p where fonte_id not in (select substitui from fonte where substitui is not null)), {_COND.format("r")}
    select ord, fonte_id, parte from r where not exists (select 1 from b where b.fonte_id = r.fonte_id and b.parte = r.parte)"""
)
def block_exclusion(spark, d):
    return select.indexable(pieces(spark, d), table(spark, d, "fonte")).select("ord", "fonte_id", "parte")


@query(
    f"""with {_P}, s as (select distinct id from fonte where id is not null) select id, case when id in (select substitui from fonte where substitui is not null) then 'superada'
      when id not in (select fonte_id from bloco where fonte_id is not null) then 'sem_pdf' else 'espinha_ausente' end as motivo from s
    where id in (select substitui from fonte where substitui is not null) or id not in (select fonte_id from bloco where fonte_id is not null)
      or id not in (select fonte_id from p where not coalesce(descartavel, false) and fonte_id is not null)"""
)
def exclusion_reasons(spark, d):
    return select.exclusion_reasons(table(spark, d, "fonte"), table(spark, d, "bloco"), pieces(spark, d))


@query(f"with {_P} select fonte_id, min(ord) as primeiro from p group by fonte_id")
def indexed_sources(spark, d):
    return select.indexed_sources(pieces(spark, d))


@query(
    """with i as (select distinct id from fonte where id is not null) select distinct id, 'replaces unknown ' || substitui as problema from fonte where substitui is not null and substitui not in (select id from i)
    union all select id, 'repeated id' from fonte where id is not null group by id having count(*) > 1
    union all select distinct id, 'missing areas' from fonte where areas is null and titulo is not null and orgao is not null and ano is not null and url is not null and base_legal is not null and redistribuivel is not null"""
)
def manifest_problems(spark, d):
    return manifest.problems(table(spark, d, "fonte"))


@query(
    rf"""with {_CAPTIONED}, {_V} select ord, id, substr(sha256(texto), 1, 16) as sha256_texto, length(concat_ws(chr(10), nullif({_FRAME}, ''), nullif(legenda, ''), nullif({_strip("coalesce(texto, '')")}, ''))) as caracteres
    from m where ord not in (select ord from v)"""
)
def refused_pieces(spark, d):
    """Pieces without a valid vector, with the length of the text that the dense arm embeds."""
    refused = caption.with_captions(pieces(spark, d)).join(vectors(spark, d).select("ord"), "ord", "left_anti")
    return refused.select("ord", "id", tx.digest(F.col("texto")).alias("sha256_texto"), F.length(tx.dense_text(F.col("legenda"))).cast("long").alias("caracteres"))


_CHAVE = "sha256(concat_ws(chr(0), 'bge-m3', 'd', texto))"


@query(f"with {_P}, {_V}, k as (select ord, {_CHAVE} as chave from p where texto is not null) select ord, chave from k where chave not in (select chave from k where ord in (select ord from v))")
def cache_misses(spark, d):
    """Texts that no piece with a valid vector has: what a cache of these vectors lacks."""
    rows = pieces(spark, d).where("texto is not null").select("ord", "texto")
    held = rows.join(vectors(spark, d), "ord").select(cache.cache_key(F.col("texto"), "bge-m3", "d").alias("chave"), F.col("vec").alias("vetor"))
    return cache.split_by_cache(rows, held, "bge-m3", "d")[1].select("ord", "chave")


@query(
    f"""with {_P} select id, fonte_id, parte, secao, titulo_secao, pagina_inicial, pagina_final, tipo, array_to_string(areas, ',') as areas, ano, substr(sha256(texto), 1, 16) as sha256_texto, length(texto)::int as caracteres from p"""
)
def public_registry(spark, d):
    """The registry of all pieces; areas as one text."""
    return index.registry_rows(pieces(spark, d)).withColumn("areas", F.array_join("areas", ","))


@query(
    f"""with {_P}, r as (select * from p where not coalesce(descartavel, false) and fonte_id not in (select substitui from fonte where substitui is not null)), {_COND.format("r")}
    select ord, id from r where not exists (select 1 from b where b.fonte_id = r.fonte_id and b.parte = r.parte)"""
)
def build_selection(spark, d):
    """What a build indexes: discardable pieces go first, then superseded sources and excluded blocks."""
    useful = pieces(spark, d).where(~F.coalesce("descartavel", F.lit(False)))
    return select.indexable(useful, table(spark, d, "fonte")).select("ord", "id")


@query(
    """select time_bucket(interval '10 minutes', registrado_em) as inicio, count(*) as candidatos, sum(coalesce(garantido, false)::int)::bigint as garantidos
    from achado where registrado_em is not null group by 1"""
)
def searches_per_window(spark, d):
    """Logged candidates per ten minutes, by the expression that streams use."""
    return runlog.searches_per_window(table(spark, d, "achado"))


_BOXES = [("a", 1, 0, 50, 100, 200), ("a", 1, 300, 50, 400, 80), ("b", 2, 10, 10, 20, 20)]


@query(
    "with b(arq, pag, x0, top, x1, bottom) as (values "
    + ", ".join(f"('{a}', {p}, {x0}, {t}, {x1}, {bo})" for a, p, x0, t, x1, bo in _BOXES)
    + """), o as (select l_orderkey, l_linenumber, case when l_returnflag = 'A' then 'a' else 'b' end as arq, 1 + l_linenumber % 2 as pag, (l_orderkey * 7 % 450)::double as x0, (l_orderkey * 7 % 450 + 12)::double as x1,
      (l_partkey * 3 % 300)::double as top, (l_partkey * 3 % 300 + 10)::double as bottom from lineitem)
    select l_orderkey, l_linenumber, arq, pag from o where not exists (select 1 from b where b.arq = o.arq and b.pag = o.pag
      and (o.x0 + o.x1) / 2 between b.x0 and b.x1 and (o.top + o.bottom) / 2 between b.top and b.bottom)"""
)
def bbox_exclusion(spark, d):
    """Objects laid out from the rows of lineitem, without those in the boxes of their page."""
    boxes = spark.createDataFrame([(a, p, float(x0), float(x1), float(t), float(b)) for a, p, x0, t, x1, b in _BOXES], "arq string, pag int, x0 double, x1 double, top double, bottom double")
    x, y = F.col("l_orderkey") * 7 % 450, F.col("l_partkey") * 3 % 300
    objects = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("arq"), (1 + F.col("l_linenumber") % 2).alias("pag"),
        x.cast("double").alias("x0"), (x + 12).cast("double").alias("x1"), y.cast("double").alias("top"), (y + 10).cast("double").alias("bottom"),
    )
    return geometry.outside_boxes(objects, boxes, ["arq", "pag"]).select("l_orderkey", "l_linenumber", "arq", "pag")


# --- chunking ---------------------------------------------------------------------------------------------------


@query(
    r"""with recursive p as (select doc_id, row_number() over (partition by doc_id order by i) as i, n from (select doc_id, unnest(list_transform(a, lambda x: length(x))) as n, unnest(range(len(a))) as i
      from (select distinct doc_id, string_split(text, chr(10)) as a from documents where text is not null)) where n > 0),
    g as (select doc_id, i, n, 0 as k, n + 1 as used from p where i = 1
      union all select p.doc_id, p.i, p.n, case when g.used + p.n + 1 > 1800 then g.k + 1 else g.k end, case when g.used + p.n + 1 > 1800 then p.n + 1 else g.used + p.n + 1 end
      from g join p on p.doc_id = g.doc_id and p.i = g.i + 1)
    select doc_id, k as grupo, count(*) as paragrafos, sum(n)::bigint + count(*) - 1 as tamanho from g group by doc_id, k"""
)
def greedy_packing(spark, d):
    """Paragraphs of each document packed by the array expression."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    docs = docs.withColumn("s", F.filter(F.transform(F.split("text", "\n"), F.length), lambda n: n > 0))
    rows = docs.select("doc_id", F.explode(F.arrays_zip(F.col("s").alias("n"), chunk.pack_column(F.col("s")).alias("k"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.k").alias("grupo")).agg(
        F.count("*").alias("paragrafos"), (F.sum("x.n") + F.count("*") - 1).alias("tamanho")
    )


@query(
    r"""with b as (select distinct fonte_id, ord, texto, regexp_replace(texto, '^\s+|\s+$', '', 'g') as t from bloco where tipo = 'texto' and texto is not null)
    select fonte_id, ord, coalesce(length(t) <= 90 and regexp_matches(t, '(?i)^\s*(ANEXO|AP[EÊeê]NDICE|TERMO DE ESCLARECIMENTO|FICHA FARMACOTERAP[EÊeê]UTICA)([^\wÀ-ÿ]|$)') and not contains(t, chr(10)) or regexp_matches(t, '^PARTE\s+[IVXL]+$'), false) as marco,
      regexp_matches(t, '^([0-9]+(?:\.[0-9]+)*)\.\s+[A-Za-zÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç][^\n]*$') or regexp_matches(t, '^([0-9]+(?:\.[0-9]+)*)\s+[A-ZÀ-ÖØ-Þ][^a-zà-ÿ.]{3,88}$') as candidata,
      t <> '' and length(t) <= 90 and not regexp_matches(t, '[a-zà-ÿ]') and regexp_matches(t, '[A-ZÀ-ÖØ-Þ]') as titulo from b"""
)
def boundary_flags(spark, d):
    rows = table(spark, d, "bloco").where("tipo = 'texto' and texto is not null").select("fonte_id", "ord", "texto").distinct()
    t = F.col("texto")
    return rows.select(
        "fonte_id", "ord", boundaries.marker(t).isNotNull().alias("marco"), boundaries.candidate(t).isNotNull().alias("candidata"), boundaries.is_title(tx.strip(t)).alias("titulo")
    )


_T = r"regexp_replace(texto, '^\s+|\s+$', '', 'g')"
_REFS = r"REFER[EÊeê]NCIAS"
_UP, _LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zà-ÿ]"
_TITLE = f"({{0}} <> '' and length({{0}}) <= 90 and not regexp_matches({{0}}, '{_LOW}') and regexp_matches({{0}}, '{_UP}'))"


@query(
    rf"""with b as (select distinct fonte_id, ord, texto, {_T} as t from bloco where tipo = 'texto' and texto is not null), s as (select *, {_strip(r"regexp_extract(t, '^[}]\s*([^\n]+)$', 1)")} as u,
      {_strip(r"case when regexp_matches(t, '^([0-9]+(?:[.][0-9]+)*)[.]\s+([A-Za-zÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç][^\n]*)$') then regexp_extract(t, '^[0-9]+(?:[.][0-9]+)*[.]\s+([A-Za-zÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç][^\n]*)$', 1) else regexp_extract(t, '^[0-9]+(?:[.][0-9]+)*\s+([A-ZÀ-ÖØ-Þ][^a-zà-ÿ.]{3,88})$', 1) end")} as titulo from b)
    select fonte_id, ord, regexp_matches(t, '^(REFER[EÊ]NCIAS( BIBLIOGR[ÁA]FICAS|\s+BIBLIOGR[ÁA]FICAS)?|BIBLIOGRAFIA)$') as ref,
      regexp_matches(t, '(?i)^[0-9]+(?:[.][0-9]+)*[.]?\s+({_REFS}(\s+BIBLIOGR[ÁAáa]FICAS)?|BIBLIOGRAFIA)\s*:?$') as ref_num,
      regexp_matches(titulo, '(?i)^\s*({_REFS}|BIBLIOGRAFIA)([^\pL\pN_]|$)') as descartavel, case when {_TITLE.format("u")} then u end as subtitulo,
      length(t) >= 4 and not ends_with(t, '.') and {_TITLE.format("t")} as solto from s"""
)
def line_kinds(spark, d):
    """Bibliography headings (bare, numbered, as a numbered title), titles after a brace, and unmarked titles."""
    rows = table(spark, d, "bloco").where("tipo = 'texto' and texto is not null").select("fonte_id", "ord", "texto").distinct()
    t = F.col("texto")
    return rows.select(
        "fonte_id", "ord", boundaries.opens_bare_references(t).alias("ref"), boundaries.starts_numbered_references(t).alias("ref_num"),
        F.coalesce(boundaries.is_discardable_title(boundaries.candidate(t)["titulo"]), F.lit(False)).alias("descartavel"),
        boundaries.subtitle(t).alias("subtitulo"), boundaries.unmarked_title(t).isNotNull().alias("solto"),
    )


@query(
    rf"""with b as (select fonte_id, ord, max({_T}) as t from bloco where tipo = 'texto' and fonte_id is not null and ord is not null and trim(coalesce(texto, '')) <> '' group by fonte_id, ord),
    c as (select fonte_id, ord, regexp_extract(t, '^([0-9]+(?:[.][0-9]+)*)[.]?\s', 1) as numero, string_split(numero, '.')::int[] as nivel from b
      where regexp_matches(t, '^([0-9]+(?:[.][0-9]+)*)[.]\s+[A-Za-zÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç][^\n]*$') or regexp_matches(t, '^([0-9]+(?:[.][0-9]+)*)\s+[A-ZÀ-ÖØ-Þ][^a-zà-ÿ.]{{3,88}}$')),
    l as (select *, lag(nivel) over (partition by fonte_id order by ord) as antes from c)
    select fonte_id, ord, numero, case when antes is null then nivel = [1] else nivel = list_append(antes, 1)
      or (len(nivel) <= len(antes) and nivel[1:len(nivel) - 1] = antes[1:len(nivel) - 1] and nivel[len(nivel)] = antes[len(nivel)] + 1) end as segue from l"""
)
def numbering(spark, d):
    """Numbered titles in reading order, and whether each continues the numbering of the one before."""
    rows = table(spark, d, "bloco").where("tipo = 'texto' and fonte_id is not null and ord is not null and trim(coalesce(texto, '')) <> ''")
    rows = rows.groupBy("fonte_id", "ord").agg(F.max(tx.strip(F.col("texto"))).alias("t"))
    titles = rows.withColumn("c", boundaries.candidate(F.col("t"))).where("c is not null").select("fonte_id", "ord", F.col("c.numero").alias("numero"), boundaries.level(F.col("c.numero")).alias("nivel"))
    # titles are few; their texts do not go through the window
    titles = titles.withColumn("antes", F.lag("nivel").over(Window.partitionBy("fonte_id").orderBy("ord")))
    return titles.select("fonte_id", "ord", "numero", boundaries.follows(F.col("antes"), F.col("nivel")).alias("segue"))


@query(f"with {_P} select ord, sha256({_HEADER} || chr(10) || chr(10) || texto) as ancorado from p where texto is not null")
def anchored_text(spark, d):
    return pieces(spark, d).where("texto is not null").select("ord", F.sha2(tx.anchored().cast("binary"), 256).alias("ancorado"))


_PARAGRAPHS = """p as (select doc_id, row_number() over (partition by doc_id order by i) as i, n from (select doc_id, unnest(list_transform(a, lambda x: length(x))) as n, unnest(range(len(a))) as i
      from (select distinct doc_id, string_split(text, chr(10)) as a from documents where text is not null)) where n > 0),
    g as (select doc_id, i, n, 0 as k, n + 1 as used from p where i = 1
      union all select p.doc_id, p.i, p.n, case when g.used + p.n + 1 > 1800 then g.k + 1 else g.k end, case when g.used + p.n + 1 > 1800 then p.n + 1 else g.used + p.n + 1 end
      from g join p on p.doc_id = g.doc_id and p.i = g.i + 1)"""


@query(
    f"""with recursive {_PARAGRAPHS}, s as (select *, sum(n) over w + count(*) over w - 1 as fim, max(k) over (partition by doc_id) as ultimo from g window w as (partition by doc_id order by i desc)),
    a as (select doc_id, min(i) filter (k = ultimo) as inicio, min(i) filter (k = ultimo - 1) as primeiro, min(fim) filter (k = ultimo) as x, max(ultimo) as ultimo from s group by doc_id),
    t as (select doc_id, max(fim) filter (k = ultimo) as resto from s group by doc_id),
    f as (select s.doc_id, max(s.i) as de from s join a using (doc_id) join t using (doc_id) where a.ultimo > 0 and t.resto < 120 and s.i > a.primeiro and s.i < a.inicio and s.fim >= 120 group by s.doc_id),
    ok as (select f.doc_id, f.de from f join s on s.doc_id = f.doc_id and s.i = f.de where s.fim <= 1800),
    r as (select s.doc_id, s.i, s.n, case when ok.de is not null and s.i >= ok.de then s.ultimo else s.k end as grupo from s left join ok using (doc_id))
    select doc_id, grupo::int as grupo, count(*) as paragrafos, sum(n)::bigint + count(*) - 1 as tamanho from r group by doc_id, grupo"""
)
def lifted_packing(spark, d):
    """Paragraphs of each document packed as the chunker does: greedily, then a short last group is lifted."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    docs = docs.withColumn("s", F.filter(F.transform(F.split("text", "\n"), F.length), lambda n: n > 0))
    rows = docs.select("doc_id", F.explode(F.arrays_zip(F.col("s").alias("n"), chunk.pack_lifted(F.col("s")).alias("k"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.k").alias("grupo")).agg(F.count("*").alias("paragrafos"), (F.sum("x.n") + F.count("*") - 1).alias("tamanho"))


_JOINED = f"""{_P}, o as (select *, length(texto) as n, row_number() over w as i, lag(struct_pack(a := tipo, b := descartavel, c := coalesce(parte, ''), d := coalesce(secao, ''), e := coalesce(titulo_secao, ''))) over w as antes,
      struct_pack(a := tipo, b := descartavel, c := coalesce(parte, ''), d := coalesce(secao, ''), e := coalesce(titulo_secao, '')) as agora from p where texto is not null window w as (partition by fonte_id order by ord)),
    j as (select fonte_id, i, ord, n, pagina_final, agora, ord as cabeca, n as total, 1 as novo from o where i = 1
      union all select o.fonte_id, o.i, o.ord, o.n, o.pagina_final, o.agora, case when same then j.cabeca else o.ord end, case when same then j.total + o.n + 1 else o.n end, case when same then 0 else 1 end
      from (select o.*, j.cabeca as jc, j.total as jt, j.agora = o.agora and j.total < 120 and j.total + o.n + 1 <= 1800 as same from j join o on o.fonte_id = j.fonte_id and o.i = j.i + 1) o join j on j.fonte_id = o.fonte_id and j.i = o.i - 1)"""


@query(
    f"""with recursive {_JOINED}, h as (select fonte_id, cabeca as ord, max(total) as caracteres, max(pagina_final) as pagina_final, any_value(agora) as rotulo, count(*) as juntados from j group by fonte_id, cabeca),
    l as (select *, lag(rotulo) over (partition by fonte_id order by ord) as antes from h)
    select fonte_id, ord, caracteres::int as caracteres, pagina_final, juntados from l where caracteres >= 120 or rotulo.a = 'tabela'
      or ((antes is null or (antes.c, antes.d, antes.e) <> (rotulo.c, rotulo.d, rotulo.e)) and (rotulo.d <> '' or rotulo.e <> ''))"""
)
def joined_pieces(spark, d):
    """All pieces taken as the chunker's output before its last steps: short ones joined, then what is below the floor dropped."""
    rows = pieces(spark, d).where("texto is not null").fillna("", ["parte", "secao", "titulo_secao"])
    rows = rows.withColumns({"trecho": F.lit(0).cast("long"), "corrida": F.lit(0).cast("long"), "k": F.lit(0)})
    got = chunk.keep_floor(chunk.join_short(rows))
    return got.select("fonte_id", "ord", F.length("texto").alias("caracteres"), "pagina_final", "juntados")


@query()
def chunk_blocks(spark, d):
    return chunk.chunk(table(spark, d, "bloco"), table(spark, d, "fonte"))


@query(
    f"""with {_P}, l as (select fonte_id, length(texto) as n, tipo from p where texto is not null), r as (select *, row_number() over (partition by fonte_id order by n) - 1 as i, count(*) over (partition by fonte_id) as c from l)
    select fonte_id, max(c) as pedacos, sum((tipo = 'tabela')::int)::bigint as tabelas, min(n) as minimo, max(case when i = c // 2 then n end) as mediana, max(n) as maximo from r group by fonte_id"""
)
def piece_stats(spark, d):
    """Counts and lengths per source; the median is the upper one of two."""
    rows = pieces(spark, d).where("texto is not null").select("fonte_id", "tipo", F.length("texto").cast("long").alias("n"))
    # counts per length first: a source's lengths are few however many pieces it has
    per = rows.groupBy("fonte_id", "n").agg(F.count("*").alias("c"), F.sum((F.col("tipo") == "tabela").cast("long")).alias("t"))
    w = Window.partitionBy("fonte_id").orderBy("n")
    per = per.withColumn("ate", F.sum("c").over(w)).withColumn("todos", F.sum("c").over(Window.partitionBy("fonte_id")))
    middle = F.floor(F.col("todos") / 2)
    return per.groupBy("fonte_id").agg(
        F.max("todos").alias("pedacos"), F.sum("t").alias("tabelas"), F.min("n").alias("minimo"), F.min(F.when(F.col("ate") > middle, F.col("n"))).alias("mediana"), F.max("n").alias("maximo")
    )


@query(
    f"""with {_P}, h as (select ord // 4096 as b, sha256(string_agg(coalesce(id, chr(0)), chr(10) order by ord)) as h, count(*) as n from p group by 1)
    , k as (select b // 4096 as c, sha256(string_agg(h, chr(10) order by b)) as h, sum(n) as n from h group by 1)
    select sha256(string_agg(h, chr(10) order by c)) as hash, sum(n)::bigint as linhas from k"""
)
def signature_hash(spark, d):
    return content_hash(pieces(spark, d), F.col("id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import containers, distinctive, leakage, lookalike, neighbours, rank_walk, scan_repair, shared_spans, splitting, term_counts
from folio.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.found_noise(read_table(spark, d, "bloco"), read_table(spark, d, "fonte"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.paragraphs(read_table(spark, d, "bloco"), read_table(spark, d, "fonte"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(read_table(spark, d, "matriz"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, d, "matriz"), "ord", "vec").withColumn("cosseno", F.round("cosseno", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.dominated_terms(read_table(spark, d, "posting"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(read_table(spark, d, "posting"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk.majority_winners(read_table(spark, d, "achado"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk.rank_walk(read_table(spark, d, "achado"), "consulta_id", "id", ["cosseno", "bm25", "rrf"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.weakest_cut(read_table(spark, d, "pedaco"), "ord", "texto")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "pedaco").select("ord", "id", "secao", "texto").distinct()
    return splitting.split_pieces(rows, "texto", ["ord", "id", "secao"])


def _marked_terms(spark: SparkSession, d: str) -> DataFrame:
    store = term_counts.stored_counts(read_table(spark, d, "posting"))
    return term_counts.marked(store.counts(), store.state()["records"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked_terms(spark, d).where("marca is not null").select("term", "marca")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _marked_terms(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(read_table(spark, d, "pedaco"), "ord", "texto")


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.form_classes(read_table(spark, d, "pedaco"), "ord", "texto")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.pack_texts(read_table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "prova_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_pairs(read_table(spark, d, "documents"))


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_coverage(read_table(spark, d, "documents")).withColumn("parte", F.round("parte", 6))


def queries() -> dict[str, Query]:
    found = [
        p1_found, p1_paragraphs, p2_found, p2_neighbours, p3_found, p3_scores, p4_found, p4_ranking, p5_found, p5_pieces,
        p6_found, p6_counts, p7_found, p7_classes, p8_containers, p9_found, p10_found, p10_coverage,
    ]
    return {f.__name__: f for f in found}


_VALID = "term is not null and term <> '' and doc_ord is not null and tf > 0"
_COUNTING = f"c as (select distinct term, doc_ord, tf from posting where {_VALID})"
_NEAR = """
v as (select ord, max(vec)::double[] as vec from matriz
      where ord is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(vec, lambda x: x <> 0)) > 0 group by ord),
p as (select a.ord, b.ord as vizinho, list_cosine_similarity(a.vec, b.vec) as cosseno from v a, v b where a.ord <> b.ord),
r as (select *, row_number() over (partition by ord order by round(cosseno, 12) desc, vizinho) as posicao from p)
"""
# the text of NaN, because isnan() misses NaN in files whose column statistics leave NaN out
_LOW = "case when {0} is null or {0}::varchar = 'nan' then '-infinity'::double else {0} end as {0}"
# two-character columns keep the lists of characters readable in pairs
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))
# typed here on their own, not taken from the operator that they check: Cyrillic, then Greek
_ALIKE = "АВЕКМНОРСТУХІЈЅԚԜҮӀаеорсухіјѕһԁԛԝѵӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲϳϹͿ"
_LATIN = "ABEKMHOPCTYXIJSQWYIaeopcyxijshdqwvl" + "ABEZHIKMNOPTYXovicjCJ"
_FORM = (
    "nfc_normalize(translate(translate(translate(translate(replace(replace(texto, 'ﬁ', 'fi'), 'ﬂ', 'fl'), "
    f"'​‌‍⁠﻿­', ''), '{_FULL.replace(chr(0xFF07), '')}µ²³¹ºª', '{_PLAIN.replace(chr(39), '')}μ231oa'), "
    f"'{_ALIKE}', '{_LATIN}'), "
    "'\t    　‐‑‒–−', '      -----'))"
)
_WORDS = "regexp_extract_all(lower(strip_accents(translate(text, '²³¹ºª', '231oa'))), '[a-z0-9]+')"


# cutting by position: the longest prefix of the window before a line end, else after a sentence end, else before a space
_BLANK = r"[\t\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = _BLANK[:1] + r"\n" + _BLANK[1:]
_CUT = rf"""with recursive t as (select distinct ord, id, secao, texto from pedaco where texto is not null and texto <> ''),
    c as (select *, 0 as n, 1 as p, 0 as l, -1 as k, 1 as proximo from t
      union all select ord, id, secao, texto, n + 1, proximo, l, k, proximo + l + length(regexp_extract(substr(texto, proximo + l), '^{_BLANK}*\n?')) from
        (select ord, id, secao, texto, n, proximo, case when resto <= lim then resto when a <> '' then length(a) when b <> '' then length(b) when e <> '' then length(e) else lim end as l,
           case when resto <= lim or a <> '' then 0 when b <> '' then 1 when e <> '' then 2 else 3 end as k from
          (select *, regexp_extract(w, '(?s)^(.+)\n', 1) as a, regexp_extract(w, '(?s)^(.*[.!?]){_SPACE}', 1) as b, regexp_extract(w, '(?s)^(.+){_SPACE}', 1) as e from
            (select *, length(texto) - proximo + 1 as resto, case when n = 0 then 1800 else 1600 end as lim, substr(texto, proximo, case when n = 0 then 1801 else 1601 end) as w from c where proximo <= length(texto))))),
    o as (select *, p - 1 as s, substr(texto, greatest(p - 201, 0) + 1, least(p - 1, 200)) as antes from c where n > 0 and regexp_matches(substr(texto, p, l), '[^' || '{_SPACE[1:]}')),
    q as (select *, case when s > 200 and not regexp_matches(substr(texto, s - 200, 1), '{_SPACE}') then regexp_replace(antes, '^[^' || '{_SPACE[1:]}' || '+{_SPACE}', '') else antes end as volta from o)
    select ord, id, secao, n - 1 as n, s - length(volta) as inicio, volta || substr(texto, p, l) as texto, ['paragrafo', 'frase', 'espaco', 'nenhum'][k + 1] as corte from q"""
# every window of 200 characters by its MD5 (hash() takes near-copies for equal), in stretches of 500 places so that no long text is counted through again
_WINDOWS = """d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 200),
    s as (select doc_id, 500 * c as o, substr(text, 500 * c + 1, 699) as x from (select doc_id, text, unnest(range((length(text) + 499) // 500)) as c from d)),
    w as (select doc_id, o + j as i, md5_number(substr(x, j, 200)) as h from (select *, unnest(range(1, least(500, length(x) - 199) + 1)) as j from s where length(x) >= 200)),
    g as (select h from w group by h having min(doc_id) <> max(doc_id)), m as (select w.* from w join g using (h))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_neighbours": f"with {_NEAR} select ord, vizinho, round(cosseno, 6) as cosseno, posicao::int as posicao from r where posicao <= 5",
        "p5_pieces": _CUT,
        "p7_classes": f"with t as (select distinct ord, texto from pedaco where ord is not null and texto is not null) select ord, sha256({_FORM}) as classe, sha256(texto) as grafia from t",
        "p10_found": f"with {_WINDOWS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from m a join m b on a.h = b.h and a.doc_id < b.doc_id",
        "p10_coverage": f"""with {_WINDOWS}, p as (select distinct doc_id, i from m), l as (select doc_id, i, lag(i) over (partition by doc_id order by i) as j from p),
            c as (select doc_id, sum((j is null or i > j + 200)::int)::bigint as trechos, sum(least(200, coalesce(i - j, 200)))::bigint as compartilhado from l group by doc_id)
            select t.doc_id, t.n_chars, coalesce(trechos, 0) as trechos, coalesce(compartilhado, 0) as compartilhado, case when t.n_chars > 0 then round(coalesce(compartilhado, 0) / t.n_chars, 6) else 0.0 end as parte
            from (select distinct doc_id, length(text) as n_chars from documents where doc_id is not null) t left join c using (doc_id)""",
        "p2_found": f"with {_NEAR} select distinct least(ord, vizinho) as ord_a, greatest(ord, vizinho) as ord_b from r where posicao <= 5 and cosseno >= 0.92",
        "p3_found": f"with {_COUNTING}, t as (select term, sum(tf) as n from c group by term) "
        "select doc_ord, term from c join t using (term) where tf >= 3 and 2 * tf >= n",
        "p4_found": f"""with a as (select distinct consulta_id, id, {_LOW.format("cosseno")}, {_LOW.format("bm25")}, {_LOW.format("rrf")} from achado)
            select consulta_id, id from a x where not exists (select 1 from a y where y.consulta_id = x.consulta_id and y.id <> x.id
              and (x.cosseno > y.cosseno)::int + (x.bm25 > y.bm25)::int + (x.rrf > y.rrf)::int < 2)""",
        "p5_found": r"""with t as (select distinct ord, texto from pedaco where length(texto) > 1800),
            l as (select ord, string_split(texto, chr(10)) as p from t),
            m as (select ord, list_max(list_transform(p, lambda x: length(x))) as p,
              list_max(list_transform(flatten(list_transform(p, lambda x: string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: length(x))) as f,
              list_max(list_transform(flatten(list_transform(p, lambda x: regexp_split_to_array(x, '\s+'))), lambda x: length(x))) as e from l)
            select ord, case when p <= 1800 then 'paragrafo' when f <= 1800 then 'frase' when e <= 1800 then 'espaco' else 'nenhum' end as corte from m""",
        "p6_found": f"""with {_COUNTING}, t as (select term, count(distinct doc_ord) as n from c group by term), d as (select count(distinct doc_ord) as m from c)
            select term, case when n <= 2 then 'raro' else 'comum' end as marca from t, d where n <= 2 or n > 0.5 * m""",
        "p6_counts": f"""with {_COUNTING}, d as (select count(distinct doc_ord) as m from c),
            t as (select term, sum(tf)::bigint as occurrences, count(distinct doc_ord) as records from c group by term)
            select term, occurrences, records, case when records <= 2 then 'raro' when records > 0.5 * m then 'comum' end as marca from t, d""",
        "p7_found": f"""with t as (select distinct ord, texto, {_FORM} as f from pedaco where texto is not null)
            select a.ord as ord_a, b.ord as ord_b from t a join t b on a.f = b.f and a.ord < b.ord and a.texto <> b.texto""",
        "p9_found": f"""with d as (select distinct doc_id as k, {_WORDS} as w from documents where text is not null),
            i as (select distinct item_id as k, {_WORDS} as w from prova_item where text is not null),
            dw as (select k, array_to_string(w[j:j + 12], ' ') as s from (select k, w, unnest(range(1, len(w) - 11)) as j from d where len(w) >= 13)),
            iw as (select k, array_to_string(w[j:j + 12], ' ') as s from (select k, w, unnest(range(1, len(w) - 11)) as j from i where len(w) >= 13))
            select distinct dw.k as doc_id, iw.k as item_id from dw join iw using (s)""",
    }

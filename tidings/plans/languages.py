"""Languages of texts, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import languages
from tidings.plans.registry import query
from tidings.tables import Tables


@query("sf6b_language_by_grams", r"""with w as (select doc_id, lang, length(text) as chars, unnest(list_filter(string_split_regex(lower(text), '[^\pL\pM]+'), lambda x: x <> '')) as w from documents),
 g as (select doc_id, lang, chars, substr(' ' || w || ' ', i, 3) as gram from (select *, unnest(range(1, length(w) + 1)) as i from w) x),
 n as (select lang, gram, count(*) as n from g where doc_id % 4 <> 2 and lang is not null group by 1, 2), t as (select lang, sum(n) as total, ln(0.5e0) - ln(sum(n) + 0.5e0 * 4001) as floor from n group by 1),
 p as (select lang, gram, ln(n + 0.5e0) - ln(0.5e0) as gain from n qualify row_number() over (partition by lang order by n desc, gram) <= 4000),
 s as (select doc_id, count(*) as size from g where chars >= 12 group by 1), a as (select doc_id, p.lang, sum(gain) as gain from g join p using (gram) where chars >= 12 group by 1, 2),
 e as (select s.doc_id, t.lang, round(coalesce(gain, 0) + size * floor, 6) as score from s cross join t left join a on a.doc_id = s.doc_id and a.lang = t.lang),
 b as (select doc_id, lang from e qualify row_number() over (partition by doc_id order by score desc, lang) = 1) select d.doc_id, b.lang as language from documents d left join b using (doc_id)""")
def by_grams(spark, d):
    """Profiles of three quarters of the documents, whose languages are given, tell the language of all."""
    docs = Tables(spark, d).documents
    return languages.detected(docs.select("doc_id", "text"), "doc_id", languages.profiles(docs.filter("doc_id % 4 <> 2").select("lang", "text")))

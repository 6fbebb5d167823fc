"""Names of one to seven words in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import names
from tidings.plans.registry import query
from tidings.tables import Tables


@query("jn13b_names_of_any_length", r"""with recursive t as (select doc_id as id, regexp_extract_all(coalesce(text, ''), '([\pL\pN_]+|[^\pL\pN_]+)', 1) as t from documents), w as (select id, t, list_filter(t, lambda x: regexp_matches(x, '^[\pL\pN_]')) as w from t),
 names as (select distinct array_to_string(w[4 : 4 + id % 7], ' ') as name from w where len(w) >= 12), n as (select name, string_split(name, ' ') as own from names),
 p as (select id, t, unnest(range(1, len(t) + 1)) as i from t), h as (select p.id, i - 1 as "at", max({'n': length(name), 'size': 2 * len(own) - 1, 'name': name}) as b from p join n on p.t[i] = own[1] and array_to_string(p.t[i : i + 2 * len(own) - 2], '') = name group by 1, 2),
 s as (select id, "at", b.size as size, b.name as name from h), k as (select id, "at", size, name from s qualify row_number() over (partition by id order by "at") = 1 union all
  select id, y."at", y.size, y.name from (select s.*, row_number() over (partition by s.id order by s."at") as r from k join s on s.id = k.id and s."at" >= k."at" + k.size) y where r = 1) select id, "at", name from k""")
def names_of_any_length(spark, d):
    """Word sequences taken from each document's beginning, found in all documents."""
    texts = Tables(spark, d).documents.select(F.col("doc_id").alias("id"), "text")
    words = F.filter(names.tokens(F.coalesce("text", F.lit(""))), lambda x: x.rlike(r"^[\p{L}\p{N}_]"))
    some = texts.select("id", words.alias("w")).filter(F.size("w") >= 12)
    own = some.select(F.array_join(F.slice("w", F.lit(4), (F.col("id") % 7 + 1).cast("int")), " ").alias("name")).distinct()
    return names.named_in(texts, own)

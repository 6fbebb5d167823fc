"""Searches by index, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import indexes, similarity
from tidings.plans.registry import query
from tidings.plans.relations import vectors
from tidings.plans.texts import MARKS
from tidings.tables import Tables

#: Searches as users type them, words already folded.
ASKED = [["eaueux", "ement"], ["tion"], ["ing", "er"], ["nowhere"]]
MISSPELLED = [["ement", "eauexx"], ["eaueuxe"]]


def held(words):
    return " and ".join(f"contains({MARKS.format('text')}, '{w}')" for w in words)


@query("sf10b_trigram_index", " union all ".join(f"select {n} as search, doc_id from documents where {held(w)}" for n, w in enumerate(ASKED)))
def trigram_index(spark, d):
    """All texts with all words of a search, found by posting lists."""
    items = Tables(spark, d).documents.select("doc_id", "text")
    path = indexes.trigram_index(items, "doc_id")
    return indexes.spelled_all(items, path, "doc_id", ASKED, fuzzy=False).select("search", "doc_id")


@query("jn8b_recall_of_cells", "select count(*) as queries, true as recall_reached from embeddings where vec_id % 100 = 0")
def recall_of_cells(spark, d):
    """Whether a search of as many cells as the sample asks for finds 0.9 of the true ten nearest, of all vectors whose id 100 divides against all."""
    v = vectors(spark, d)
    asked = v.filter("id % 100 = 0")
    cells = indexes.Cells(v, cells=24)
    found = cells.nearest(asked, 10, cells.probes_for(0.95)).select("id", "other", F.lit(1).alias("hit"))
    true = similarity.top_neighbours(v, asked, 10).select("id", "other")
    share = true.join(found, ["id", "other"], "left").agg(F.count_distinct("id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))
    return share


@query("tr12c_search")
def search(spark, d):
    """A search in one call: words as written, close spellings where these find little, meaning. The query's vector is that of row 0."""
    t = Tables(spark, d)
    items = t.documents.select("doc_id", "text")
    v = vectors(spark, d)
    path, cells = indexes.trigram_index(items, "doc_id"), indexes.Cells(v, cells=24)
    vector = v.filter("id = 0").first()["v"]
    searches = [*ASKED, *MISSPELLED]
    return indexes.searched_all(items, "doc_id", path, cells, searches, [vector] * len(searches)).select("search", "doc_id", "tier", "closeness")

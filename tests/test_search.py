"""Searches by index against the same searches without one."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import indexes, search, similarity
from tidings.tables import Tables

SF = "/root/testdata/sf0.001"
SOME = [
    (1, "Marché des Enfants-Rouges in Paris"), (2, "The market of red children"), (3, "Élysée: les enfants d'abord"), (4, "entants perdus"), (5, None), (6, ""), (7, "Storm hits the coast of Brittany, coastguard says"),
    (8, "A coasts guard"), (9, "enfant"), (10, "x_y z_enfants"), (11, "ΑΘΉΝΑ και Αθηνα"), (12, "un an à la mer"), (13, "enfantz ici"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(SOME, "doc_id long, text string").withColumn("trigram", F.lit("x")).withColumn("word", F.lit(0))


@pytest.fixture(scope="module")
def path(items):
    return indexes.trigram_index(items, "doc_id")


@pytest.mark.parametrize("words", [["enfants"], ["entants"], ["marche", "enfants"], ["enfants", "rouges", "des"], ["coast", "guard"], ["costguard", "storm"], ["an"], ["la", "un"], ["αθηνα"], ["zzzz"], ["y"], ["ouge"], ["lysee", "enfant"]])
def test_the_index_finds_what_a_scan_finds(items, path, words):
    for fuzzy in (False, True):
        want = search.by_close_spelling(items, words) if fuzzy else search.by_words(items, words)
        got = indexes.spelled(items, path, "doc_id", words, fuzzy=fuzzy)
        rows = lambda t: sorted((r["doc_id"], round(r["closeness"], 9) if fuzzy else 0) for r in t.collect())
        assert rows(got) == rows(want)


def test_the_index_finds_what_a_scan_finds_in_documents(spark):
    docs = Tables(spark, SF).documents.select("doc_id", "text")
    path = indexes.trigram_index(docs, "doc_id")
    seen = [w for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(3).collect() for w in re.findall(r"[a-z]{5,9}", r["text"].lower())[:4]]
    for words in [[seen[0]], [seen[1][:-1] + "q", seen[2]], [seen[5][1:4]]]:
        want = {r["doc_id"] for r in search.by_close_spelling(docs, words).collect()}
        assert {r["doc_id"] for r in indexes.spelled(docs, path, "doc_id", words).collect()} == want and want


def test_a_search_opens_the_lists_of_its_trigrams_only(spark, path, capsys):
    lists = indexes.postings(spark, path, indexes.needs(["enfants"]))
    lists.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: .*bucket#\d+ IN", plan) and "PushedFilters: [In(trigram, " in plan and "ReadSchema: struct<doc_id:bigint,trigram:string>" in plan
    assert {r["trigram"] for r in lists.collect()} <= {g for _, g, _ in indexes.needs(["enfants"])}


def unit(n, dims=16, seed=4):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(10, dims))
    v = centre[draw.integers(0, 10, n)] + 0.5 * draw.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_cells_hold_every_vector_once_and_probing_all_is_exact(spark):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit(600))], "id long, v array<double>")
    cells = indexes.Cells(v, cells=12, sample=200)
    assert sorted(r["id"] for r in spark.read.parquet(cells.path).select("id").collect()) == list(range(600))
    asked = v.filter("id % 50 = 0")
    rows = lambda t: sorted((r["id"], r["rank"], r["other"], r["sim"]) for r in t.collect())
    exact = rows(similarity.top_neighbours(v, asked, 7))
    assert rows(cells.nearest(asked, 7, probes=12)) == rows(cells.nearest(asked, 7, probes=12, per_block=20)) == exact
    probes = cells.probes_for(0.95, 7)
    assert 1 <= probes <= 12
    some = rows(cells.nearest(asked, 7, probes))
    assert len({(a, o) for a, _, o, _ in some} & {(a, o) for a, _, o, _ in exact}) >= 0.9 * len(exact)


def test_a_search_goes_on_to_close_spellings_only_where_words_find_little(spark, items, path):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit(40))], "id long, v array<double>")
    cells, ask = indexes.Cells(v, cells=4), unit(40)[1].tolist()
    tiers = lambda words, **k: {(r["doc_id"], r["tier"]) for r in indexes.searched(items, "doc_id", path, cells, words, ask, **k).collect()}
    many, few = tiers(["enfants"], meaning=0), tiers(["enfantz"], meaning=0)
    assert many == {(1, 0), (3, 0), (10, 0)}  # three hits: no close spellings
    assert (13, 0) in few and {t for _, t in few} == {0, 1} and (1, 1) in few
    near = [r for r in indexes.searched(items, "doc_id", path, cells, ["zzzz"], ask).collect()]
    assert near and {r["tier"] for r in near} == {2} and len(near) <= 8 and near[0]["doc_id"] == 1 and all(1 - r["closeness"] <= indexes.MEANING for r in near)


@pytest.mark.parametrize("title, many", [
    ("Debrief for the crew", False), ("Midweek in review", False), ("Newsletter to the editor", False), ("Brief for the crew", True), ("The week in review: storms", True), ("Letters to the editor", True), ("Live updates: vote", True), ("Olive: a tree", False),
    ("The latest on the storm", True), ("The latestest", False), ("World - storm", True), ("A world - storm", False), ("World news today", True), ("My world news", False), ("Evening news brief", True), ("WHAT TO KNOW TODAY", True), (None, False), ("", False),
])
def test_headlines_of_pages_on_many_stories(spark, title, many):
    from tidings.operators.joins import roundup

    assert spark.createDataFrame([(title,)], "t string").select(roundup(F.col("t"))).first()[0] is many

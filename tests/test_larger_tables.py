"""What only larger tables show: several blocks, ties of rounding, many places in a cell, long lists of names."""

import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.functions.geo import haversine_km
from tidings.functions.scoring import channel_score
from tidings.functions.text import folded, trigrams
from tidings.llm import near_texts
from tidings.operators import cluster, histories, indexes, joins, names, search, similarity, tracks
from tidings.plans import all_queries


def test_neighbours_are_found_across_several_blocks(spark):
    m = np.random.default_rng(3).standard_normal((300, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, v array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as tables of some MB are dealt
    try:
        found = similarity.top_neighbours(v, v.filter("id % 10 = 0"), 5, per_block=64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sim = np.round(m @ m.T, 6)
    for i in range(0, 300, 10):
        best = sorted((-sim[i, j], j) for j in range(300) if j != i)[:5]
        assert [r["other"] for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])] == [j for _, j in best]


def test_channel_scores_round_as_their_sql_does(spark):
    """1000 * s and 100 * s * 10 are not the same number where s lies on the edge of a rounding."""
    def s(p, r, f, c, e, y):
        return 0.35 * (c + 1) / (e + 4) + 0.35 * (y + 0.5) / (c + 3) + 0.2 * (r + 1) / (p + 3) + 0.1 * (1 - f / p)

    def told(x):
        return np.floor(1000.0 * x + 0.5) / 10.0

    g = np.stack(np.meshgrid(*[np.arange(1, 13), *[np.arange(8)] * 5], indexing="ij")).reshape(6, -1).astype(float)
    x = s(*g)
    edge = np.flatnonzero(told(x) != np.floor(100 * x * 10.0 + 0.5) / 10.0)
    assert len(edge)
    rows = g[:, edge].T.astype(int).tolist()
    names = ["posts", "routed", "forwarded", "corroborated", "evaluable", "early"]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} long" for n in names))
    found = df.select(*names, channel_score(*[F.col(n) for n in names]).alias("score")).collect()
    assert all(r["score"] == told(s(*[r[n] for n in names])) for r in found)


def test_rows_at_one_spot_meet_once(spark):
    """30,000 points and as many places at one spot: 900 million pairs of rows, one pair of spots."""
    at = lambda key, lat, lon: spark.range(30_000).select(F.col("id").alias(key), F.lit(10.0).alias(lat), F.lit(20.0).alias(lon))
    begin = time.monotonic()
    near = joins.nearest_in_cell(at("id", "lat", "lon"), at("place", "lat", "lon"), 30.0, haversine_km, "id")
    within = joins.nearest_within(at("id", "lat", "lon"), at("r_id", "r_lat", "r_lon"), 500.0, haversine_km, "id", "r_id")
    for t, key in ((near, "place"), (within, "r_id")):
        assert t.agg(F.count("*"), F.max(key), F.max("km")).first() == (30_000, 0, 0.0)
    assert time.monotonic() - begin < 30


def test_stories_reach_a_spot_once(spark):
    spots = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 60.0, 20.0)], "spot long, lat double, lon double")
    stories = spark.createDataFrame([(7, 10.5, 20.0), (8, None, None)], "story long, lat double, lon double")
    places = spark.createDataFrame([(7, 10.0, 20.5, 0.9), (8, 10.0, 20.0, 0.9), (8, 60.0, 20.0, 0.05)], "story long, lat double, lon double, weight double")
    got = joins.stories_at(spots, stories, places, 100.0, haversine_km)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_aims_that_need_more_towns_than_the_first(spark):
    rng = np.random.default_rng(5)
    towns = [(int(i % 3), i, float(p)) for i, p in enumerate(np.round(rng.random(900) ** 3 * 1e4, 2))] + [(2, 2000, 0.0), (3, 3000, 5.0)]
    arrows = [(a, a * 10 + k) for a in range(5) for k in range(10)]
    off, km = (F.col("arrow") * 11 + F.col("town") * 5) % 50, F.abs(F.col("arrow") * 7 - F.col("town") * 3) % 60
    best = {}
    for area, arrow in arrows:
        for own, town, p in towns:
            o, k = (arrow * 11 + town * 5) % 50, abs(arrow * 7 - town * 3) % 60
            if own == area and 2 <= k <= 40 and o <= 35:
                best[arrow] = max(best.get(arrow, (-9e9, 0)), (round(np.log10(p + 10.0) - o / 60 - k / 80, 9), -town))
    frames = spark.createDataFrame(arrows, "area long, arrow long"), spark.createDataFrame(towns, "area long, town long, population double")
    for first in (4, 2048):
        got = tracks.aims(*frames, off, km, first).collect()
        assert {r["arrow"]: (round(r["score"], 9), -r["town"]) for r in got} == best and len(got) == len(best)


def test_near_dedup_links_close_fingerprints_by_their_blocks(spark):
    """Nodes without any band: what operator 3's buckets find, chains and equal fingerprints included."""
    prints = [0, 3, 15, 15, 1 << 40, (1 << 40) + 1, 7 << 50]
    nodes = spark.createDataFrame([(i, fp) for i, fp in enumerate(prints)], "node long, fp long")
    got = {tuple(r) for r in near_texts.close_prints(nodes).collect()}
    root = list(range(len(prints)))
    for a, b in got:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert root == [0, 0, 0, 0, 0, 0, 6]


def test_names_with_one_first_word_meet_no_place_in_vain(spark, monkeypatch):
    """3,000 names and 3,000 texts, all full of one word: the names of a first word times its places would be 900 million rows."""
    monkeypatch.setattr(names, "BLOCK", 100_000)  # several blocks
    texts = spark.range(3000).select("id", F.concat(F.lit("the w"), "id", F.lit(" x. "), F.repeat(F.lit("the "), 100)).alias("text"))
    known = spark.range(3000).select(F.concat(F.lit("the w"), "id", F.lit(" x")).alias("name"))
    begin = time.monotonic()
    got = names.named_in(texts, known.union(spark.createDataFrame([("the the the",)], "name string")))
    assert sorted(map(tuple, got.filter("name <> 'the the the'").collect())) == [(i, 0, f"the w{i} x") for i in range(3000)]
    assert got.filter("name = 'the the the'").groupBy("id").count().filter("count = 33").count() == 3000
    assert time.monotonic() - begin < 60


def test_asks_of_one_spot_share_their_answer(spark):
    """400,000 asks of one spot and a day with 50 marks on each of 40 days: each ask met all marks."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    maps = spark.range(40).select(F.lit(1).cast("long").alias("track"), day.alias("day"))
    marks = maps.join(spark.range(50).select((50 + F.col("id") / 1000.0).alias("lat"), F.lit(30.0).alias("lon")))
    asks = spark.range(400_000).select(F.col("id").alias("ask"), F.lit(1).cast("long").alias("track"), F.lit("2024-02-09").cast("date").alias("day"), F.lit(50.0).alias("lat"), F.lit(30.0).alias("lon"))
    begin = time.monotonic()
    got = histories.persistence(asks, maps, marks).groupBy("run_days", "at_least", "maps_last_year", "marked_last_year").count().collect()
    assert [tuple(r) for r in got] == [(40, True, 40, 40, 400_000)]
    assert time.monotonic() - begin < 40


def test_merges_hold_what_they_have_changed_only(spark):
    """One component of 200,000 pairs, of which few can merge; the order of pairs is that of one pass."""
    n = 2000
    pairs = spark.range(200_000).select((F.col("id") % n).alias("a"), ((F.col("id") * 7919 + F.floor(F.col("id") / n)) % n).alias("b"), (0.4 + F.pmod(F.col("id") * 48271, F.lit(99_991)) / 1e6).alias("sim")).filter("a < b").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    sizes = spark.range(n).select("id", (F.col("id") % 40 + 1).alias("n"))
    count, gone, want = {i: i % 40 + 1 for i in range(n)}, set(), {}
    for r in sorted(pairs.collect(), key=lambda r: (r["sim"], r["a"], r["b"]), reverse=True):
        a, b = r["a"], r["b"]
        if a not in gone and b not in gone and r["sim"] >= cluster.merge_needs_of(0.4, min(count[a], count[b])):
            keep, drop = (a, b) if count[a] >= count[b] else (b, a)
            count[keep] += count[drop]
            gone.add(drop)
            want[drop] = keep
    last = lambda x: last(want[x]) if x in want else x
    got = {r["gone"]: r["kept"] for r in cluster.greedy_merges(pairs, sizes, 0.4, most=n).collect()}
    assert got == {g: last(g) for g in want} and len(got) > 100


def test_groups_that_share_one_entity_make_no_pairs(spark):
    """Small groups: pairs of entities; large groups: pairs of groups. Both say the same as all pairs do."""
    rng = np.random.default_rng(9)
    small = {(int(g), int(e)) for g, e in zip(rng.integers(0, 300, 900), rng.integers(0, 40, 900))}
    large = {(int(g), int(e)) for g, e in zip(rng.integers(0, 12, 400), rng.integers(0, 300, 400))}
    for rows in (small, large):
        of = {}
        for g, e in rows:
            of.setdefault(e, set()).add(g)
        fits = {e for e, gs in of.items() if 2 <= len(gs) <= 40}
        own = {g: sorted(e for x, e in rows if x == g and e in fits) for g in {g for g, _ in rows}}
        want = {(a, b): sorted(set(own[a]) & set(own[b])) for a in own for b in own if a < b}
        for least in (1, 2, 3):
            got = joins.co_occurring(spark.createDataFrame(list(rows), "g long, e long"), "g", "e", 2, 40, least, evidence=5).collect()
            assert {(r["a"], r["b"]): (r["shared"], r["evidence"]) for r in got} == {k: (len(v), v[:5]) for k, v in want.items() if len(v) >= least}


def test_reports_of_a_track_without_a_silence_hold_live_events_only(spark):
    """40,000 reports a minute apart, each far from those of the last hours: every report met all events of its track."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("track"), "id", F.timestamp_seconds(F.col("id") * 60).alias("at"), ((F.col("id") * 7) % 120 - 60).cast("double").alias("lat"), ((F.col("id") * 11) % 300 - 150).cast("double").alias("lon"))
    begin = time.monotonic()
    got = tracks.grouped_reports(rows, 1, 6.0)
    assert got.agg(F.count("*"), F.count_if(F.col("event") == F.col("id"))).first() == (40_000, 40_000)
    assert time.monotonic() - begin < 60


def test_lists_of_trigrams_are_those_of_each_text_in_any_blocks(spark, monkeypatch):
    """Blocks of one text, of several and of all; letters of two and four bytes; more letters than a table of their trigrams has room for."""
    some = ["", None, " x ", "a", "Été, étés; été!", "ab_c 12 \U00010400\U0001d400z", "".join(chr(c) for c in range(0x4E00, 0x5400)), "\u0391\u0398 " * 50, "the the", "-- .", "nai\u0308ve"]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "id long, text string").coalesce(1)
    words = {r["id"]: [w for w in (r["t"] or "").split(" ") if w] for r in texts.select("id", F.regexp_replace(folded(F.col("text")), r"[^\p{L}\p{N}_]+", " ").alias("t")).collect()}
    want = sorted((i, g) for i, ws in words.items() for g in {g for w in ws for g in trigrams(w)})
    for block in (1, 30, 1_000_000):
        monkeypatch.setattr(indexes, "BLOCK", block)
        assert sorted((r["id"], r["trigram"]) for r in spark.read.parquet(indexes.trigram_index(texts, "id")).collect()) == want


def test_searches_read_texts_once_and_fold_candidates_only(spark, capsys):
    """Spark took the look at the folded text below the join with the candidates, and each search read all texts."""
    rows = [(i, f"word{i} tion ing er") for i in range(50)]
    texts = spark.createDataFrame(rows, "id long, text string")
    path = indexes.trigram_index(texts, "id")
    indexes.spelled(texts, path, "id", ["word7"], fuzzy=False).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines()
    assert not any("translate" in x for x in plan[next(k for k, x in enumerate(plan) if "Join" in x) + 1 :])
    asked = [["word7"], ["tion", "word1"], ["er"], ["nowhere"], ["a"], ["w", "word49"]]
    for fuzzy in (False, True):
        got = indexes.spelled_all(texts, path, "id", asked, fuzzy=fuzzy)
        one = [(k, r["id"]) for k, words in enumerate(asked) for r in indexes.spelled(texts, path, "id", words, fuzzy=fuzzy).collect()]
        assert sorted((r["search"], r["id"]) for r in got.collect()) == sorted(one) and (0, 7) in one and (5, 49) in one
        assert fuzzy or sorted(one) == sorted((k, i) for k, words in enumerate(asked) for i, x in rows if all(w in x for w in words))


def test_close_spellings_by_arrays_are_those_of_each_text():
    """Random texts of few letters, with runs that repeat: the same number as by following every run."""
    rng = np.random.default_rng(4)
    made = lambda letters, n: "".join(rng.choice(list(letters), n))
    for _ in range(400):
        word, some = made("abc", rng.integers(0, 9)), [made("abcé _-", n) for n in rng.choice([0, 1, 5, 30, 150], 4)] + [made("ab ", 4) * rng.integers(1, 40)]
        for least in (0.4, 0.55):
            want = [s if (s := text.word_similarity(word, t)) >= least else 0.0 for t in some]
            assert text.word_similarities(word, some, least).tolist() == want


def test_close_spellings_in_many_long_texts(spark):
    """20,000 texts of 300 words, each of which shares trigrams with the word: every run of each text was followed."""
    word = F.conv((F.pmod(F.xxhash64("id", F.col("i")), F.lit(2000)) * 9973).cast("string"), 10, 36)
    texts = spark.range(20_000).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(300)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(F.concat(F.when(F.col("i") % 4 == 0, "eau").when(F.col("i") % 4 == 1, "ux").otherwise(""), F.lower(word)))).alias("text"))
    texts = texts.localCheckpoint()
    begin = time.monotonic()
    assert texts.agg(F.count_if(search.close_spelling("eaueuxe", F.col("text")) >= 0.4)).first()[0] > 0
    assert time.monotonic() - begin < 15


def test_searches_together_find_what_each_finds_alone(spark):
    texts = spark.createDataFrame([(i, f"enfants {i} perdus" if i % 3 else f"entants {i} rouge") for i in range(60)] + [(60, "un rouje"), (61, None)], "doc_id long, text string")
    v = np.random.default_rng(2).standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    path, cells = indexes.trigram_index(texts, "doc_id"), indexes.Cells(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), cells=4)
    asked = [["enfants"], ["rouje"], ["enfantz", "perdus"], ["zzzz"], ["un"]]
    got = [tuple(r) for r in indexes.searched_all(texts, "doc_id", path, cells, asked, [v[k].tolist() for k in range(5)]).select("search", "doc_id", "tier", "closeness").collect()]
    for k, words in enumerate(asked):
        alone = indexes.searched(texts, "doc_id", path, cells, words, v[k].tolist()).select("doc_id", "tier", "closeness").collect()
        assert [r[1:] for r in got if r[0] == k] == [tuple(r) for r in alone]
    assert {r[2] for r in got if r[0] == 2} >= {1} and sum(r[0] == 0 and r[2] == 0 for r in got) == 25


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """A folder of 4,000 vectors that are all alike, 8 million pairs of about 0.5, and events of none of them; the similarities."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((4000, 64))
    m[:, 0] = np.sqrt((m[:, 1:] ** 2).sum(axis=1))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    folder = str(tmp_path_factory.mktemp("alike"))
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(-1,)], "user_id long").write.parquet(f"{folder}/events.parquet")
    sim = np.zeros((4000, 4000))
    for k in range(64):  # as SQL adds up
        sim += np.outer(m[:, k].astype(float), m[:, k].astype(float))
    return folder, sim


def merged_of(sim):
    """gone -> kept of the registered rule, all stories of size 1."""
    n, gone, into, by_sim = np.ones(len(sim), int), set(), {}, 0
    a, b = np.triu_indices(len(sim), 1)
    s = np.round(sim[a, b], 6)
    order = np.lexsort((b, a, s))[::-1]
    pairs = [(None, a, a + 5) for a in range(0, len(sim) - 5, 50)]
    for s, a, b in itertools.chain(pairs, zip(s[order].tolist(), a[order].tolist(), b[order].tolist())):
        if (a + b) % 7 == 0 or a in gone or b in gone or (s is not None and s < cluster.merge_needs_of(0.35, min(n[a], n[b]))):
            continue
        keep, drop = (a, b) if n[a] >= n[b] else (b, a)
        n[keep] += n[drop]
        gone.add(drop)
        into[drop] = keep
        by_sim += s is not None
        if by_sim == 500:
            break
    last = lambda x: last(into[x]) if x in into else x
    return {g: last(g) for g in into}


def test_absorbed_pairs_of_vectors_that_are_all_alike(spark, alike):
    """8 million pairs went one after the other through the pass of merges, were made three times and shuffled twice."""
    folder, sim = alike
    begin = time.monotonic()
    got = all_queries()["cl4_absorbed"](spark, folder).agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b"))).first()
    assert time.monotonic() - begin < 80
    story = np.arange(len(sim))
    for gone, kept in merged_of(sim).items():
        story[gone] = kept
    a, b = np.nonzero(np.triu(sim >= 0.35, 1))
    x, y = np.minimum(story[a], story[b]), np.maximum(story[a], story[b])
    code = np.unique((x * len(sim) + y)[x != y])
    a, b = np.divmod(code, len(sim))
    assert tuple(got) == (len(a), a.sum(), b.sum(), (a * b).sum())


def test_rows_of_one_story_meet_others_once(spark):
    """1,500 rows end in one story, more than a tile has; some in stories of two; a vector is missing."""
    m = np.random.default_rng(12).standard_normal((3000, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)] + [(3000, None)], "id long, v array<double>")
    merges = spark.createDataFrame([(i, 2) for i in range(1500) if i != 2] + [(i, i + 1) for i in range(2000, 2400, 2)], "gone long, kept long")
    want = cluster.rekeyed_pairs(similarity.similar_pairs(v, 0.8, 4).select("a", "b"), merges).collect()
    got = cluster.absorbed_pairs(v, 0.8, merges).collect()
    assert len(got) == len(set(got)) and set(got) == set(want) and len(got) > 5000
    assert cluster.absorbed_pairs(v.filter("id < 0"), 0.8, merges).count() == 0


def test_merges_of_vectors_that_are_all_alike(spark, alike):
    """500 merges rest on few of the 8 million pairs."""
    folder, sim = alike
    begin = time.monotonic()
    got = {r["gone"]: r["kept"] for r in all_queries()["cl3b_greedy_merges"](spark, folder).collect()}
    assert time.monotonic() - begin < 80
    assert got == merged_of(sim) and len(got) > 500


def test_first_merges_look_further_where_few_pairs_may_merge(spark, monkeypatch):
    """All but one pair in 97 are split, so the most similar ones hold no merge: more of them are taken, at last all."""
    rng = np.random.default_rng(13)
    m = rng.standard_normal((300, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, v array<double>")
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 250))], "id long, n long")
    confirmed = spark.createDataFrame([(3, 94), (50, 7)], "a long, b long")
    apart = lambda t: t.filter("(a + b) % 97 <> 0")
    pairs = similarity.similar_pairs(v, 0.35)
    want = set(cluster.greedy_merges(pairs, sizes, 0.35, confirmed, apart(pairs.select("a", "b").union(confirmed)), most=6).collect())
    assert len(want) == 7 and set(cluster.first_merges(v, sizes, 0.35, confirmed, apart, 6).collect()) == want
    monkeypatch.setattr(cluster, "RANKED", 100)
    assert set(cluster.first_merges(v, sizes, 0.35, confirmed, apart, 6).collect()) == want


def test_merge_candidates_travel_as_vectors(spark, tmp_path):
    """Sizes meet vectors, not pairs: 4.5 million pairs were shuffled for each end's size."""
    rng = np.random.default_rng(14)
    m = rng.standard_normal((3000, 64))
    m[:, 0] = np.sqrt(0.48 * (m[:, 1:] ** 2).sum(axis=1))  # similarities of about 0.32
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    n = rng.integers(0, 60, 3000)
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i,) for i in np.repeat(np.arange(3000), n).tolist()], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sizes are too many for a broadcast
    try:
        df = all_queries()["cl3_merge_candidates"](spark, str(tmp_path))
        above = re.split("MapInArrow|FlatMapGroups", df._jdf.queryExecution().executedPlan().toString())[0]
        assert "Exchange" not in above and "Join" not in above
        got = df.agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum("keep"), F.sum("sim")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n, sim = np.maximum(n, 1), np.zeros((3000, 3000))
    for k in range(64):  # as SQL adds up
        sim += np.outer(m[:, k].astype(float), m[:, k].astype(float))
    a, b = np.nonzero(np.triu(sim >= 0.3, 1))
    s, low = np.round(sim[a, b], 6), np.minimum(n[a], n[b])
    keep = s >= np.array([cluster.merge_needs_of(0.3, k) for k in range(61)])[low]
    a, b, s = a[keep], b[keep], s[keep]
    assert tuple(got)[:4] == (len(a), a.sum(), b.sum(), np.where(n[a] >= n[b], a, b).sum()) and abs(got[4] - s.sum()) < 1e-3 and len(a) > 100_000

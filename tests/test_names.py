"""The dictionary of place names against the rules, and its search against a regular expression."""

import random
import re

import pytest

from tidings.operators import names

CITIES = [
    ("gn:1", "Kyiv", "Kyiv", "UA", 2_900_000, True), ("gn:2", "Washington", "Washington", "US", 600_000, True), ("gn:3", "New York City", "New York City", "US", 8_000_000, False), ("gn:4", "Saint Petersburg", "Saint Petersburg", "RU", 5_000_000, False),
    ("gn:5", "Moscow", "Moscow", "RU", 11_000_000, True), ("gn:6", "Moscow", "Moscow", "US", 25_000, False), ("gn:7", "St. Paul", "St. Paul", "US", 300_000, False), ("gn:8", "Saint Paul", "Saint Paul", "BR", 10, False), ("gn:9", "Nice", "Nice", "FR", 340_000, False),
    ("gn:10", "São Tomé", "Sao Tome", "ST", 70_000, True), ("gn:11", "Ufa", "Ufa", "RU", 1_000_000, False), ("gn:12", "Mali", "Mali", "GN", 5_000, False), ("gn:13", "New York", "New York", "GB", 100, False), ("gn:14", "Bo City", "Bo City", "SL", 100, False), ("gn:15", "Kinshasa", "Kinshasa", "CD", 9_000_000, True),
]
COUNTRIES = [("UA", "Ukraine"), ("US", "United States"), ("RU", "Russia"), ("FR", "France"), ("ST", "São Tomé and Príncipe"), ("ML", "Mali"), ("CD", "Democratic Republic of the Congo"), ("CG", "Congo"), ("GE", "Georgia")]
SHORT = [("US", "American"), ("US", "U.S."), ("RU", "Russian"), ("UA", "Ukrainian"), ("CD", "DR Congo"), ("XX", "Nowhere"), ("ML", "Malian"), ("FR", "French")]


@pytest.fixture(scope="module")
def table(spark):
    return names.name_table(
        spark.createDataFrame(CITIES, "key string, name string, plain string, country string, population long, capital boolean"), spark.createDataFrame(COUNTRIES, "iso string, name string"), spark.createDataFrame(SHORT, "iso string, name string"),
        spark.createDataFrame([("the Kremlin", "RU"), ("Elysée", "FR")], "name string, iso string"), spark.createDataFrame([("Kiev", "Kyiv"), ("Washington, D.C.", "Washington"), ("Lost", "Gone")], "name string, canonical string"),
        skip_countries=["Georgia"], skip_cities=["Nice"]).cache()


def test_which_place_a_name_means(table):
    got = {r["name"]: r["key"] for r in table.collect()}
    want = {
        "Kyiv": "gn:1", "Kiev": "gn:1", "Washington, D.C.": "gn:2", "the Kremlin": "gn:5", "American": "cc:US", "Americans": "cc:US", "Malians": "cc:ML", "Ukrainians": "cc:UA", "U.S.": "cc:US", "Mali": "cc:ML", "Moscow": "gn:5",
        "New York": "gn:3", "New York City": "gn:3", "St. Petersburg": "gn:4", "St Petersburg": "gn:4", "Saint Paul": "gn:7", "St. Paul": "gn:7", "St Paul": "gn:8", "Sao Tome": "gn:10", "São Tomé": "gn:10", "DR Congo": "cc:CD"}
    assert {k: got.get(k) for k in want} == want
    assert not {"Georgia", "Nice", "Ufa", "Elysée", "Lost", "Nowhere", "Frenchs", "Bo"} & set(got)


TEXTS = [
    (1, "The Democratic Republic of the Congo and Congo met in New York City, not New York."), (2, "Washington, D.C. is in the U.S. and not Washington, D.C.x"), (3, "St. Petersburg; St Petersburg's Saint Petersburgs"), (4, None), (5, ""), (6, "kyiv KYIV Kyiv"),
    (7, "Kyiv, Kiev, Ukraine, Russia, Moscow, American, Malians"), (8, "New York City New York City"), (9, "in the U.S."), (10, "U.S.A. and U.S. and"), (11, "New  York"), (12, "Sao Tome\nSão Tomé and Príncipe"), (13, "the Kremlin"), (14, "the  Kremlin atthe Kremlin"),
]


def by_pattern(texts, known):
    """Longest names first, whole words, from left to right."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
    return sorted((i, m.group(0)) for i, t in texts for m in pattern.finditer(t or ""))


def test_names_are_found_like_a_pattern_finds_them(spark, table):
    known = [r["name"] for r in table.collect()]
    got = names.named_in(spark.createDataFrame(TEXTS, "id long, text string"), table)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == by_pattern(TEXTS, known)
    assert names.named_in(spark.createDataFrame([], "id long, text string"), table).count() == 0


def test_many_overlapping_names(spark):
    draw = random.Random(8)
    word = lambda: draw.choice(["a", "b", "c", "d.", "e-f"])
    known = sorted({" ".join(word() for _ in range(draw.randint(1, 7))) for _ in range(60)})
    texts = [(i, " ".join(word() for _ in range(draw.randint(0, 60)))) for i in range(60)]
    got = names.named_in(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert sorted((r["id"], r["name"]) for r in got.collect()) == by_pattern(texts, known)


def test_cities_come_first_and_hide_their_country(spark, table):
    got = {}
    for r in names.places_named(spark.createDataFrame(TEXTS, "id long, text string"), table).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["key"])
    assert got[7] == ["gn:1", "gn:5", "cc:US", "cc:ML"] and got[1] == ["gn:3", "cc:CD", "cc:CG"] and got[2] == ["gn:2"] and got[13] == ["gn:5"]

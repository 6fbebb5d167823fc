"""The whole decision by rules, pasted text, and evidence of shared actors."""

import pytest
from pyspark.sql import functions as F

from tidings.functions import text as tx
from tidings.operators import joins, triage

DESKS = [{"key": "war", "priority": 1, "phrases": ["strike", "front line", "drone"], "themes": ["KILL", "ARMED"], "countries": ["UA"]}, {"key": "law", "priority": 2, "phrases": ["court", "bill"], "themes": ["LEGIS"]}]
OUT = [{"key": "sport", "phrases": ["match", "goal"], "urls": ["/sport/"]}, {"key": "stars", "phrases": ["celebrity"]}]
KIND = "story_id long, text string, themes array<string>, countries array<string>, urls array<string>, tiers array<string>"
CASES = [
    # text, themes, countries, urls, tiers -> desk, routed, reason, significance, relevance, confidence
    ("Drone strike at the front line", ["ARMEDCONFLICT", "KILL"], ["UA"], [], ["A"], ("war", True, None, 4.15, 0.95, 0.9)),
    ("A strike", [], [], [], [], ("war", False, "no_desk_match", 1.4, 0.1, 0.45)),
    ("A strike", ["KILL"], [], [], [], ("war", True, None, 2.35, 0.3, 0.45)),
    ("A court and a bill", [], [], [], ["B"], ("law", True, None, 1.8, 0.4, 0.6)),
    ("A court and a bill", [], [], ["http://x/sport/1"], [], ("law", False, "sport", 1.8, 0.2, 0.45)),  # 3 against 2
    ("A court, a match and a celebrity", [], [], [], [], ("law", False, "sport", 1.4, 0.1, 0.7)),  # ties go to the exclusion that stands first
    ("Nothing of note", ["KILL"], ["UA"], [], [], (None, False, "no_desk_match", 1.75, 0.0, 0.45)),
    ("Nothing of note", [], [], [], [], (None, False, "no_desk_match", 1.0, 0.0, 0.9)),
    (None, None, None, None, None, (None, False, "no_desk_match", 1.0, 0.0, 0.9)),
]


def test_decisions_by_rules(spark):
    stories = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(CASES)], KIND)
    got = {r["story_id"]: r for r in triage.decided(stories, DESKS, OUT, ["nuclear"], ["KILL"]).collect()}
    for k, c in enumerate(CASES):
        r = got[k]
        assert (r["desk"], r["routed"], r["reason"], r["significance"], r["relevance"], r["confidence"]) == pytest.approx(c[5]), c[0]


def test_pasted_text_is_composed(spark):
    import unicodedata

    texts = ["cafe\u0301 au lait", "a\u0323\u030a and A\u030a and \u2126", "\u1112\u1161\u11ab\u1100\u1173\u11af letters", "plain line", "zero\u200bwidth", "\uf900 and \u05d9\u05b4", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.pasted(F.col("t"))).collect()]
    assert got == [t and unicodedata.normalize("NFC", t).replace("\u200b", "") for t in texts]


def test_every_letter_that_composes_is_sent_on(spark):
    """No character outside the pattern changes under NFC."""
    import unicodedata

    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    rows = spark.createDataFrame([(f"abc {c} abc",) for c in odd], "t string")
    assert [r[0] for r in rows.select(tx.pasted(F.col("t"))).collect()] == [unicodedata.normalize("NFC", f"abc {c} abc") for c in odd]


def test_pairs_come_with_the_first_names_they_share(spark):
    rows = [(g, e) for g in (1, 2) for e in "kjihgfedcba"] + [(3, "a"), (3, "z")]
    got = joins.co_occurring(spark.createDataFrame(rows, "g long, e string"), "g", "e", 2, 3, 2, evidence=8).collect()
    assert [(r["a"], r["b"], r["shared"], r["evidence"]) for r in got] == [(1, 2, 11, list("abcdefgh"))]

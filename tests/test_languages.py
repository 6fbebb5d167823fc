from tidings.operators import languages
from tidings.tables import Tables


def test_languages_of_held_out_documents(spark):
    docs = Tables(spark, "/root/testdata/sf0.01").documents
    known = languages.profiles(docs.filter("doc_id % 4 <> 2").select("lang", "text"))
    out = docs.filter("doc_id % 4 = 2").join(languages.detected(docs.filter("doc_id % 4 = 2").select("doc_id", "text"), "doc_id", known), "doc_id")
    told = [(r["lang"], r["language"]) for r in out.filter("lang is not null and language is not null").collect()]
    assert len(told) > 150 and sum(a == b for a, b in told) >= 0.95 * len(told)


def test_languages_of_odd_texts(spark):
    known = languages.profiles(spark.createDataFrame([("en", "the cat and the dog sat"), ("ru", "это просто текст"), (None, "zz zz zz zz zz"), ("xx", None), ("yy", "")], "lang string, text string"))
    assert {r["lang"] for r in known.select("lang").distinct().collect()} == {"en", "ru"}
    texts = [(1, None), (2, ""), (3, "the cat"), (4, "1234 5678 9012 34"), (5, "THE DOG AND THE CAT"), (6, "это текст, просто"), (7, "日本語の文章です、そうです日本"), (8, "the " * 20_000)]
    got = {r["id"]: r["language"] for r in languages.detected(spark.createDataFrame(texts, "id long, text string"), "id", known).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6, 8)} == {1: None, 2: None, 3: None, 4: None, 5: "en", 6: "ru", 8: "en"} and got[7] in ("en", "ru")
    assert languages.detected(spark.createDataFrame([], "id long, text string"), "id", known).count() == 0


def test_texts_are_not_shuffled_to_be_told(spark, capsys):
    """Grams were rows of a join before: each met the profiles after a shuffle of all of them, or as a copy for each language."""
    known = languages.profiles(spark.createDataFrame([("en", "the cat and the dog sat"), ("ru", "это просто текст")], "lang string, text string"))
    texts = spark.createDataFrame([(1, "the cat 𐐨𐐩 sat on it"), (2, "the"), (3, "это текст " * 300_000)], "id long, text string")
    out = languages.detected(texts, "id", known)
    assert {r["id"]: r["language"] for r in out.collect()} == {1: "en", 2: None, 3: "ru"}
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Exchange" not in plan and "Generate" not in plan

"""The pipeline's stages on a small input, and the queries' SQL."""

import pytest
from parity import compared
from pyspark.sql import functions as F

import corpus_pipeline
from tidings.llm import queries
from tidings.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        assert docs.columns == (columns if name != "tokens" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


def test_pipeline_equals_brute_force(spark):
    """The stages one after the other in plain Python: rules by their SQL, all pairs of documents, all alignments with all items."""
    from collections import Counter

    import numpy as np
    from parity import duck
    from tokenizers import Tokenizer

    from tidings.llm import decontaminate, mixing, quality_rules, token_files

    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    kept = set(duck(SF).sql(quality_rules.ORACLE).df().query("kept")["doc_id"])

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = {d: shingles(rows[d]["text"]) for d in kept}, {d: d for d in kept}
    for a in kept:
        for b in kept:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    kept = {d for d, x in label.items() if d == x}

    items = [decontaminate.word_hashes(r["text"].encode()) for r in table(spark, SF, "benchmark").collect()]

    def overlaps(text):
        h = decontaminate.word_hashes(text.encode())
        for item in items:
            shifts = {int(p - k) for k, x in enumerate(item) for p in np.flatnonzero(h == x)}
            if any(decontaminate.enough(decontaminate.best_run(h, item, s)[0], len(item)) for s in shifts):
                return True
        return False

    kept = {d for d in kept if not overlaps(rows[d]["text"])}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(table(spark, SF, "documents").filter(F.col("doc_id").isin(sorted(kept)))).collect()}
    lib, want, start = Tokenizer.from_file(token_files.default_tokenizer()), Counter(), 0
    for d in sorted(kept):
        n = len(lib.encode(rows[d]["text"], add_special_tokens=False).ids) + 1
        for _ in range(copies[d]):
            want[d, start, n] += 1
            start += n
    assert Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()) == want and len(kept) > 50


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_stages_on_odd_tables(spark):
    """Null ids and texts, repeated rows and ids, clashing names: each stage keeps the columns and its defined rows."""
    good = [f"Sentence number {i} speaks of the {w} that came down to the old harbour on a quiet morning in {i + 3} ways" for i, w in enumerate("river lantern mountain violin".split())]
    rows = [(1, good[0], "s"), (1, good[0], "s"), (1, good[1], "s"), (None, good[2], None), (None, good[2], None), (3, good[3], "t"), (4, None, "t"), (5, "", "t"), (6, "x " * 500, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({k: F.lit(k) for k in ("ka", "keep_id", "mixed_id", "s", "v", "size", "label", "rep", "node", "bad", "copies")})
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        got[name] = docs = written(stage(spark, docs, SF), f"odd-{name}")
        if name != "tokens":
            assert len(docs.columns) == 14 and docs.filter("ka <> 'ka' or copies <> 'copies'").count() == 0
    ids = {k: sorted((r["doc_id"] or -1) for r in v.collect()) for k, v in got.items()}
    assert ids["quality"] == [-1, -1, 1, 1, 1, 3] and ids["near_dedup"] == [-1, 1, 1, 3] and ids["no_benchmark"] == [-1, 1, 1, 3]
    assert set(ids["mix"]) == {-1, 1, 3} and ids["tokens"] == ids["mix"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compared(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)

"""Cross-tokenizer alignment, suffix-array dedup and hard negatives against brute force, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from parity import duck, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidings.llm import alignment, hard_negatives, near_texts, simhash, suffix_dedup
from tidings.llm.common import WordHash

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"
CLASH = ("m", "k", "u", "d", "c", "p", "n", "start", "suffix", "block", "pairs", "q", "rank", "score", "qid", "n_a")


def clashing(frame):
    """With extra columns whose names the operators use."""
    return frame.withColumns({c: F.lit(1) for c in CLASH})


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- alignment ---------------------------------------------------------------------------------


def aligned_by_brute_force(table):
    a_lib, b_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    value = alignment.byte_values()
    found = []
    for doc, text in table:
        found.append((doc, None))
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_bytes = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in raw]).tolist(), ids)) for raw, ids in ((a_bytes, a), (b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [[[i for e, i in side.items() if lo < e <= hi] for side in ends] for lo, hi in zip([0, *cuts], cuts)] if len(cuts) < 300 else None
        if parts is None:  # the same, walked once
            parts, at = [], [iter(sorted(side.items())) for side in ends]
            for cut in cuts:
                own = []
                for side in at:
                    taken = []
                    for e, i in side:
                        taken.append(i)
                        if e == cut:
                            break
                    own.append(taken)
                parts.append(own)
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in parts)
        found[-1] = (doc, (len(a), len(b), len(parts), [(ends[0][c], ends[1][c]) for c in cuts], hashlib.sha256(shown.encode()).hexdigest()))
    count = Counter(pair for _, x in found if x for pair in x[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    full = [(d, *x[:3], len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) if x else (d, 0, 0, 0, 0, 0, 0, "") for d, x in found]
    return Counter(full)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "x ▁ y"), (6, "<|endoftext|> a </s> <s>"), (7, "日本 é ö́ x"), (None, "no id"), (None, "no id"), (8, "a\n b\tc  \n  d"), (9, "ab" * 5000),
    (10, " ".join(f"w{i}" for i in range(3000))), (11, "\x00 a\x1c b"), (12, "Don't we'll  I'M x's"), (12, "don't"), (13, "a  b 　c"), (14, "ﬁ ① ½"),
]


def test_alignment_equals_brute_force_on_odd_texts(spark):
    got = alignment.aligned(clashing(spark.createDataFrame(ODD, TEXTS)))
    assert got.columns == [x.split()[0] for x in alignment.RESULT.split(", ")]
    assert counted(got) == aligned_by_brute_force(ODD)
    assert alignment.aligned(spark.createDataFrame([], TEXTS)).count() == 0


def test_alignment_equals_brute_force_on_documents(docs):
    want = aligned_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert counted(alignment.aligned(docs.repartition(5))) == want


def test_blocks_keep_cuts_and_counts_apart():
    align, own = alignment.aligner(*alignment.default_paths()), alignment.Block()
    align.forget()
    align.learn(["some", "words", "▁"])
    for doc, parts in ((1, ["some", "words", "some"]), (2, ["some", "▁"]), (3, ["words"]), (4, [])):
        own.add(doc, parts, 10, align)
    block = own.row(7, align).to_pylist()[0]
    assert [d["n_groups"] for d in block["docs"]][1] == 0 and np.frombuffer(block["lengths"], "<u4").tolist() == [3, 0, 1, 0]
    assert sum(block["times"]) == sum(d["n_groups"] for d in block["docs"])


@pytest.mark.parametrize("few", [0, 100])
def test_transducer_closes_groups_where_nothing_dangles(few):
    """In step and one by one."""
    walk = alignment.Transducer({1: b"ab", 2: b"c", 3: b"de"}, {5: b"a", 6: b"bcd", 7: b"e", 8: b"ab"})
    walk.FEW = few
    a, b = [[1, 2, 3], [1, 2, 3, 1], [1], [2], [1], [], [2, 3], [1]], [[5, 6, 7], [5, 6, 7, 8], [5], [5], [8, 5], [], [], [8]]
    fits, pair, x, y = walk.groups(alignment.flat(a), alignment.flat(b))
    assert fits.tolist() == [True, True, False, False, False, True, False, True]
    assert list(zip(pair.tolist(), x.tolist(), y.tolist())) == [(0, 3, 3), (1, 6, 6), (1, 7, 7), (7, 13, 12)]


# --- suffix-array dedup -------------------------------------------------------------------------


def stripped_by_brute_force(table):
    first, out, width = {}, Counter(), suffix_dedup.WIDTH
    for d, t in table:
        b = (t or "").encode()
        for i in range(len(b) - width + 1 if d is not None else 0):
            first[b[i : i + width]] = min(first.get(b[i : i + width], (d, i)), (d, i))
    for d, t in table:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1 if d is not None else 0):
            if first[b[i : i + width]] < (d, i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def copied():
    """Passages in many contexts, periodic texts, repeated ids and rows, boundaries of many equal strings."""
    draw = random.Random(3)
    some = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passages = [some(draw.randint(60, 400)) for _ in range(12)]
    table = [(draw.randint(1, 150), "".join(draw.choice([some(draw.randint(0, 120)), draw.choice(passages)]) for _ in range(draw.randint(0, 8)))) for _ in range(200)]
    table += [(7, None), (8, ""), (9, "a" * 1000), (10, "ab" * 700), (10, "ab" * 700), (11, "a" * 99), (12, "a" * 100), (None, passages[0] * 3), (None, "a" * 500), (13, "é日" * 90), (14, "x" + "é日" * 90)]
    return table + [(0, passages[3] * 2), (15, (some(300) + passages[2]) * 3)] + [(200 + i, some(30) + passages[5] + some(30)) for i in range(100)]


@pytest.mark.parametrize("bucket", [10**6, 50])
def test_suffix_dedup_equals_brute_force(spark, copied, bucket):
    """With buckets of 50 suffixes, one string goes on over several of them."""
    table = clashing(spark.createDataFrame(copied, TEXTS)).repartition(5)
    assert counted(suffix_dedup.stripped(table, bucket=bucket)) == stripped_by_brute_force(copied)


def test_suffix_dedup_of_slices_and_empty_tables(spark, copied, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 150)
    found = [t.encode() for _, t in copied if t]
    for text in found:  # runs cover each window of each text once, with its own gram
        starts = [(int(p) + i, int(m)) for runs in suffix_dedup.runs_of([text]) for p, n, m in zip(runs.p, runs.n, runs.m) for i in range(n)]
        assert sorted(s for s, _ in starts) == list(range(max(0, len(text) - suffix_dedup.WIDTH + 1)))
    assert suffix_dedup.stripped(spark.createDataFrame([], TEXTS)).count() == 0


def test_kept_bytes_are_the_text_without_its_spans(spark):
    a, b = "x" * 40 + "".join(map(chr, range(40, 126))) * 2, "".join(map(chr, range(126, 40, -1)))
    got = {r["doc_id"]: r for r in suffix_dedup.stripped(spark.createDataFrame([(1, a), (2, b + a + b)], TEXTS), with_text=True).collect()}
    assert bytes(got[2]["kept"]).decode() == b + b and got[2]["n_spans"] == 1 and got[2]["n_removed"] == len(a) and bytes(got[1]["kept"]).decode() == a


def test_multikey_order_is_the_order_of_the_rows():
    draw = np.random.default_rng(5)
    symbols = draw.integers(0, 3, (500, 4)).astype(np.uint64)
    order, same = suffix_dedup.multikey_order(symbols)
    ordered = symbols[order].tolist()
    assert ordered == sorted(symbols.tolist()) and same.tolist() == [i > 0 and ordered[i] == ordered[i - 1] for i in range(500)]


def test_suffix_dedup_equals_its_sql(docs):
    assert rows(suffix_dedup.stripped(docs).toPandas()) == rows(duck(SF).sql(suffix_dedup.ORACLE).df())


# --- hard negatives --------------------------------------------------------------------------------


def mined_by_brute_force(table):
    big = (1 << 63) - 1
    some = []
    for i, v, label in table:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            some.append((i, (label + 1) % 10 if i % 7 == 0 else label, [max(-big - 1, min(big, int(np.floor(256 * x)))) for x in v]))
    out = Counter()
    for i, label, v in (x for x in some if x[0] % 100 == 0):
        found = [(-max(-big - 1, min(big, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in some if j != i]
        for ps, p, _ in sorted(x for x in found if x[2] == label)[:5]:
            negatives = sorted((s, j) for s, j, other in found if other != label and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out.update((i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(negatives, 1))
    return out


VECTORS = "vec_id long, embedding array<double>, label int"


def test_hard_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    table = [(k if k % 11 else k // 200 * 100, [float(x) for x in draw.normal(size=draw.integers(0, 5))], int(draw.integers(0, 3))) for k in range(700)]
    table += [(None, [1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (300, [float("-inf")], 1), (400, [1.0], None), (900, [], 1)]
    table += [(2000 + k, [1.0, 2.0], k % 3) for k in range(300)]  # ties, more than a block of them would hold
    got = hard_negatives.mined(clashing(spark.createDataFrame(table, VECTORS)).repartition(3))
    assert counted(got) == mined_by_brute_force(table)
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0


def test_hard_negatives_of_huge_components(spark):
    table = [(100, [1e300, 1.0], 1), (101, [1e300, 0.0], 1), (102, [3e15, 2.0], 1), (103, [1e15, 2.0], 2), (105, [-1e300, 2.0], 2), (200, [1e15, 1.0], 3), (201, [2e14, 1.0], 3), (202, [1e14, 1.0], 2)]
    assert counted(hard_negatives.mined(spark.createDataFrame(table, VECTORS))) == mined_by_brute_force(table)


def test_blocks_hold_each_row_once_and_in_order(spark, monkeypatch):
    data = spark.read.parquet(f"{SF}/embeddings.parquet")
    made = hard_negatives.prepared(data)
    v = hard_negatives.matrix(made.select("v").toArrow().column(0).combine_chunks())
    space = spark.sparkContext.broadcast(hard_negatives.Space(v[:200], float((v.astype(float) ** 2).sum(axis=1).max())))
    blocks = hard_negatives.indexed(made, space).collect()
    assert sorted(i for b in blocks for i in np.frombuffer(b["ids"], "<i8").tolist()) == sorted(r["vec_id"] for r in data.collect())
    for b in blocks:
        own = np.frombuffer(b["vectors"], "<i4").reshape(-1, b["width"])
        key = space.value.keys(own)
        assert (key.argmin(axis=1) == b["pivot"]).all() and np.allclose(np.sort(key[:, b["pivot"]]), key[:, b["pivot"]]) and b["lo"] <= key[:, b["pivot"]].min() + 1e-9 and key[:, b["pivot"]].max() <= b["hi"] + 1e-9


def test_hard_negatives_equal_their_sql(spark):
    assert rows(hard_negatives.mined(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()) == rows(duck(SF).sql(hard_negatives.ORACLE).df())


# --- near copies: rows without an id, and pages with one template -----------------------------------


def test_links_through_rows_without_an_id_join_components(spark, monkeypatch):
    """Fingerprints in chains of two bits; every second one has no row with an id."""
    prints = [(1, 0), (None, 3), (2, 15), (None, 63), (7, 255), (9, (1 << 40) + (7 << 30)), (None, 7 << 50), (None, (7 << 50) + (3 << 20)), (5, 15)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    got = simhash.near_copies(spark.createDataFrame(prints, "doc_id long, fp long"))
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got.collect()) == Counter(
        [(1, 0, 1), (None, 3, 1), (2, 15, 1), (None, 63, 1), (7, 255, 1), (9, (1 << 40) + (7 << 30), 9), (None, 7 << 50, None), (None, (7 << 50) + (3 << 20), None), (5, 15, 1)])


def pages_of(n, own=60, template=140):
    return [(i, " ".join([f"t{k}" for k in range(template)] + [f"p{i}w{k}" for k in range(own)])) for i in range(n)]


def test_rare_pairs_hold_every_similar_pair():
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(6)]
    sets_ = []
    for k in range(120):
        own = base[k % 6].copy()
        own[: k % 17] = draw.integers(0, 1 << 62, k % 17).astype(np.uint64)
        sets_.append(np.unique(own[: 60 - k % 3]))
    fp = np.array([near_texts.set_print(x) for x in sets_], np.int64).view(np.uint64)
    met = {(int(i), int(j)) for a, b in near_texts.rare_pairs(sets_, fp) for i, j in zip(a, b)}
    close = {(min(i, j), max(i, j)) for a, b in near_texts.close_pairs(fp, near_texts.RADIUS) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if near_texts.similar(sets_[i], sets_[j])} & close
    assert want and want <= met and len(met) < 120 * 119 / 2


def test_pages_with_a_template_stay_and_their_copies_go(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "MANY", 20)
    pages = pages_of(300)
    copies = [(1000 + i, t.replace("t70 ", "other ", 1)) for i, t in pages[:40]] + [(None, pages[50][1].replace("t9 ", "x ", 1)), (None, "of its own " + " ".join(f"z{k}" for k in range(50)))]
    kept = simhash.one_each(spark.createDataFrame(pages + copies, TEXTS).repartition(3))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect()) == [(False, i) for i in range(300)] + [(True, None)]


def test_template_pages_make_few_pairs():
    """Ten times the pages make about ten times the pairs."""
    made = []
    for n in (50, 500):
        hashes = WordHash()
        sets_ = [near_texts.shingles(t.encode().split(), hashes) for _, t in pages_of(n)]
        made.append(sum(len(i) for i, _ in near_texts.rare_pairs(sets_, np.zeros(n, np.uint64))))
    assert made[1] <= 12 * made[0] + n

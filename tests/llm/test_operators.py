"""Each training-data operator against a brute-force version, and on odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidings.llm import decontaminate, fm_index, language, lines, mixing, passages, quality_model, quality_rules, simhash, token_files, toxicity

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i * i % 83}" for i in range(30_000))
ODD = [
    (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3),
    (6, LONG, "en", "t", len(LONG)), (7, LONG, "en", "t", len(LONG)), (8, "x " * 400, "de", "t", 800), (9, "<|endoftext|> a  b\x1c é日本 ", "fr", "u", 9), (None, "a row without an id but with words", "en", "u", 9), (10, "---- !!!", "en", "u", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators also use."""
    return spark.createDataFrame(ODD, KIND).withColumns({"m": F.lit(1), "size": F.lit("x"), "h": F.lit(None).cast("string"), "kept": F.lit(0), "id": F.lit(3), "y": F.lit("y")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]


# --- decontamination -------------------------------------------------------------------------


def test_decontamination_tolerates_substitutions(spark):
    item = [f"tok{i}" for i in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    base = [f"bg{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:100] + item + base[100:])), (3, " ".join(base[:50] + changed).upper()), (4, " ".join(item[:6])), (5, None), (6, " ".join(base[:9] + item[10:24])), (7, " ".join(item[10:24]))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(item))], "item_id long, text string")
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (2, 3, 6, 7) for i in (1, 4)}
    assert {r["n_equal"] for r in got if r["doc_id"] == 2} == {40} and {r["doc_start"] for r in got if r["doc_id"] == 2} == {100}


def test_decontamination_equals_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in docs.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, t in text.items() if " ".join(r["text"].lower().split()) in t}
    got = decontaminate.overlaps(docs, items)
    assert want <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_decontamination_of_odd_tables(spark, odd, none):
    clash = {k: F.lit("x") for k in ("first", "words", "seeds", "ka", "ia", "item", "item_id", "bad", "shift")}
    odd = odd.withColumns(clash)
    items = spark.createDataFrame([(None, LONG[5000:9000]), (1, LONG[5000:9000]), (2, "without an id but with"), (3, "one"), (4, None), (5, "")], "item_id long, text string").withColumns({"doc_id": F.lit(1), "h": F.lit(2)})
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(odd, items).collect())
    assert got == Counter({(6, None): 1, (6, 1): 1, (7, None): 1, (7, 1): 1, (None, 2): 1})
    assert all(r["n_equal"] >= r["item_words"] - 2 for r in decontaminate.overlaps(odd, items).filter("item_id = 1").collect())  # the slice cuts two words
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 5, 8, 9, 10]
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(odd, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == len(ODD)


def test_whole_copies_of_long_items_are_counted_whole(spark):
    item = [f"q{i}" for i in range(9000)]
    docs = spark.createDataFrame([(1, " ".join(["pre"] * 300 + item + ["post"] * 300))], "doc_id long, text string")
    r = decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(x["n_equal"], x["doc_start"], x["run_words"]) for x in r] == [(9000, 300, 9000)]


def test_decontamination_finds_substituted_passages(spark):
    """Recall against brute-force alignment: passages of 16 to 60 words with every eighth word replaced, at random places."""
    rng = np.random.default_rng(8)
    items = [[f"i{x}" for x in rng.integers(0, 3000, rng.integers(16, 60))] for _ in range(40)]
    rows, want = [], set()
    for d in range(120):
        w = [f"b{x}" for x in rng.integers(0, 3000, 200)]
        if d % 2:
            k = int(rng.integers(len(items)))
            part = [x if rng.random() > 0.08 else "zzz" for x in items[k]]
            w[50:50] = part
            if sum(a == b for a, b in zip(part, items[k])) >= 0.8 * len(part):
                want.add((d, k))
        rows.append((d, " ".join(w)))
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert len(want & got) >= 0.97 * len(want) and all(d % 2 for d, _ in got)


# --- language --------------------------------------------------------------------------------


def test_language_code_lengths_equal_brute_force(docs):
    """Against the definition: escapes from the longest known context down, by dictionaries of counts."""
    import pandas as pd

    sample = [(r["lang"], r["text"]) for r in docs.filter("lang is not null").limit(40).collect()]
    counts = Counter()
    for lang, text in sample:
        b = text.encode()
        for n in range(1, language.ORDER + 2):
            counts.update((lang, n, int.from_bytes(b[i : i + n], "big")) for i in range(len(b) - n + 1))
    most = 300
    m = language.Model(pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["lang", "n", "gram", "times"]), most)
    follow = {}
    for (lang, n, gram), times in counts.items():
        g = gram.to_bytes(n, "big")
        follow.setdefault(lang, {}).setdefault(g[:-1], {})[g[-1]] = times
    kept = {}
    for lang, tree in follow.items():
        order = sorted(tree, key=lambda c: (-sum(tree[c].values()), len(c), int.from_bytes(c, "big")))
        kept[lang] = {c: tree[c] for c in order[:most]}

    def cost(tree, context, byte):
        known = [context[len(context) - k :] for k in range(min(len(context), language.ORDER), -1, -1)]
        known = [c for c in known if c in tree]
        bits = 0.0
        for c in known:
            total, kinds = sum(tree[c].values()), len(tree[c])
            if byte in tree[c]:
                return bits - np.log2(tree[c][byte] / (total + kinds))
            bits -= np.log2(kinds / (total + kinds))
        return bits + 8

    texts = [sample[0][1].encode()[:1500], b"", sample[1][1].encode()[:3], "żółw 日本".encode()]
    got = m.lengths(texts)
    for t, row in zip(texts, got):
        for lang, bits in zip(m.langs, row):
            assert abs(sum(cost(kept[lang], t[:i], t[i]) for i in range(len(t))) - bits) < 1e-2 + 1e-5 * bits
    assert (got[1] == 0).all()


def test_training_rows_are_bounded_and_keep_rare_languages(spark):
    rows = [(4, f"a text of one id, number {i}", "en") for i in range(1000)] + [(i, "gu", f"l{i % 97}") for i in range(1000, 3000)]
    got = Counter(r["lang"] for r in language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20).collect())
    assert got["en"] == 20 and len(got) == 98 and max(got.values()) == 20
    pred = language.predicted(spark.createDataFrame([(1, "one two three", "en"), (2, "x", "rare"), (4, "x", None)], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in pred if r["doc_id"] == 4} == {"rare"}


def test_language_is_right_on_held_out_documents(docs):
    r = language.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r["a"] >= 0.95


def test_language_tells_200_languages(spark):
    rng = np.random.default_rng(7)
    names = [f"l{k:03d}" for k in range(200)]
    spare = "".join(chr(c) for c in range(0xC0, 0x180))  # so that texts have about 140 distinct bytes
    lexicon = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for x in names}
    rows = [(200 * r + k, " ".join(rng.choice(lexicon[x], 40)) + " " + spare, x) for r in range(12) for k, x in enumerate(names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predicted(frame).filter("held_out").collect()
    want = {r[0]: r[2] for r in rows}
    assert len({r["lang_pred"] for r in got}) > 100
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert all(language.contexts(w, language.per_group(w, n)) >= language.CONTEXTS for w in (30, 200, 258) for n in (1, 4, 20, 50, 140, 1000))


def test_language_of_odd_texts(odd, none):
    r = language.predicted(odd).collect()
    assert len(r) == len(ODD) and all(x["lang_pred"] == "und" and x["score"] == 0 for x in r if x["doc_id"] in (1, 2, 3, 10))
    assert language.predicted(none).count() == 0


# --- SimHash ---------------------------------------------------------------------------------


def brute_print(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(odd, none, docs):
    for frame in (docs, odd):
        rows = frame.select("doc_id", "text").collect()
        got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.near_copies(frame).collect())
        assert got == Counter((r["doc_id"], f"{brute_print(r['text']):016x}") for r in rows)
    assert simhash.near_copies(none).count() == 0


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist()) | {int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(6)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for heavy in (50_000, 3):  # buckets dealt once, and dealt again
        found = simhash.links(nodes, heavy)
        assert found.count() < 12 * len(fps)
        label = {r["u"]: r["label"] for r in simhash.components(found).collect()}
        assert [label.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_hot_buckets_are_dealt_again(spark):
    """2,000 fingerprints that share 32 bits, whichever these are: no bucket holds them all."""
    rng = np.random.default_rng(9)
    for pair in simhash.PAIRS:
        free = sum(0xFFFF << s for s in {0, 16, 32, 48} - set(pair))
        fps = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) & np.uint64(free)).view(np.int64).tolist()
        nodes = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
        assert simhash.buckets(nodes, 500).groupBy("key").count().agg(F.max("count")).first()[0] < 100


def test_components_of_a_path_in_falling_order(spark):
    path = [0, *range(119, 0, -1)]  # labels that walk one link a round need 119 rounds
    found = spark.createDataFrame(list(zip(path, path[1:])), "u long, v long")
    assert {r["u"]: r["label"] for r in simhash.components(found).collect()} == {i: 0 for i in range(120)}
    with pytest.raises(RuntimeError):
        simhash.components(found, rounds=2)


def test_simhash_keeps_one_of_each_group(odd):
    kept = simhash.one_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 6, 8, 9, 10]


def test_near_copies_by_words_equal_brute_force(spark, odd, none):
    """Planted copies with edits, a hot group, a chain, and documents that share passages only."""
    rng = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(30)]
    for k in range(30):
        for edits in (0, 1, 2, 3, 4, 6, 9):
            t = list(texts[k])
            for at in rng.choice(200, edits, replace=False):
                t[at] = f"e{rng.integers(1 << 30)}"
            texts.append(t)
    for _ in range(60):  # of one text: most have 0.8 beside it, few beside each other
        t = list(texts[0])
        for at in rng.choice(200, 4, replace=False):
            t[at] = f"h{rng.integers(1 << 30)}"
        texts.append(t)
    chain = list(texts[1])
    for step in range(20):
        chain = chain[:step * 9] + ["c"] + chain[step * 9 + 1 :]
        texts.append(chain)
    texts += [texts[2][:120] + texts[3][120:], texts[4][:3], texts[4][:4], []]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_each(frame).collect()}
    assert kept == set(root) and len(kept) < len(texts) / 2
    assert sorted(r["doc_id"] for r in simhash.one_each(odd).collect() if r["doc_id"] is not None) == [1, 4, 6, 8, 9, 10]
    assert simhash.one_each(none).count() == 0


def test_stage_drops_near_copies(spark):
    text = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:150] + ["other"] + text[151:])), (3, " ".join(text[:150] + [f"x{i}" for i in range(150)]))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


# --- token files -----------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 6, 15, 16, 17, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (token_files.unpack(data, bits, 1003) == ids).all()


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (1, 0, 70_000, 5, 32_768, 3)]
    w = token_files.TokenWriter(open(tmp_path / "a", "wb"), 16)
    for k, ids in enumerate(docs):
        w.add(k * 7, ids)
    w.close()
    with open(tmp_path / "a", "rb") as f:
        t = token_files.TokenFile(f)
        assert t.doc_ids.tolist() == [k * 7 for k in range(6)]
        for k in (4, 0, 2, 1, 5, 3):
            assert (t.ids(k) == docs[k]).all()


def test_token_rows_equal_the_library(odd, none, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.default_tokenizer())
    for frame in (odd, docs):
        rows = sorted(frame.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        want, start = Counter(), 0
        for r in rows:
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want[r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            start += len(ids)
        assert Counter(map(tuple, token_files.token_rows(frame).collect())) == want
    assert token_files.token_rows(none).count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """Where a splitting pattern doesn't break at spaces, chunks of a text would get other ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    lib = Tokenizer(models.BPE({"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4, "é": 5, "<unk>": 6}, [("a", " "), ("a ", "b")], unk_token="<unk>"))
    lib.save(str(tmp_path / "plain.json"))
    lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(), pre_tokenizers.ByteLevel()])
    lib.save(str(tmp_path / "digits.json"))
    for name in ("plain", "digits"):
        enc = token_files.Encoder(str(tmp_path / f"{name}.json"))
        assert enc.whole
        want = [enc.lib.encode(t, add_special_tokens=False).ids + [2] for t in ("a b a", "", "a b")]
        assert [x.tolist() for x in enc.encode(["a b a", "", "a b"])] == want
    assert not token_files.encoder(token_files.default_tokenizer()).whole


# --- mixing ----------------------------------------------------------------------------------


def brute_targets(sizes: dict):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def brute_multiplier(sizes, target, cap=2.0):
    z = np.array([x for x in sizes if x], float)
    mean = sum(sizes) / len(sizes)
    lo, hi = -60.0, 60.0
    for _ in range(200):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if (z * np.minimum(cap, np.exp(np.minimum(50, lam * z / mean)))).sum() < target else (lo, lam)
    return lam, mean


def test_mix_meets_its_targets(spark, docs, odd, none):
    for frame in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        rows = mixing.mixed(frame).collect()
        assert len(rows) == frame.count()
        own = {}
        for r in rows:
            own.setdefault(r["source"], []).append(r)
            assert 0 <= r["copies"] <= 2
        sizes = {s: sum(r["size"] for r in rs) for s, rs in own.items()}
        goal = brute_targets(sizes)
        for s, rs in own.items():
            for r in rs:
                assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) <= 1e-6 * max(1.0, goal[s])
            lam, mean = brute_multiplier([r["size"] for r in rs], goal[s])
            if 0 < goal[s] < 2 * sizes[s]:
                assert all(abs(r["rate"] - (min(2, np.exp(lam * r["size"] / mean)) if r["size"] else 0)) < 1e-3 for r in rs)
            miss = abs(sum(r["copies"] * r["size"] for r in rs) - goal[s])
            free = [r["size"] for r in rs if r["rate"] % 1]
            assert miss <= max(0.01 * goal[s], min(free, default=0) / 2, 1)
    assert mixing.mixed(none).count() == 0


def test_gaps_close_by_few_documents():
    size = np.array([3, 10, 90, 600])
    for gap in (0.4, 7.0, 95.0, -95.0, 512.0, -3000.0, 1e6):
        up, down = np.array([2, 3, 1, 2]), np.array([1, 0, 4, 1])
        add, cut = mixing.turns(size, up, down, gap)
        assert (0 <= add).all() and (add <= up).all() and (0 <= cut).all() and (cut <= down).all()
        left = gap - (size * (add - cut)).sum()
        nets = np.stack(np.meshgrid(*[np.arange(-d, u + 1) for u, d in zip(up, down)]), axis=-1).reshape(-1, 4)
        assert abs(left) <= np.abs(gap - nets @ size).min() + 3, (gap, left)


def test_mix_without_ids_and_with_repeated_rows(spark):
    rows = [(None, f"{k} " * (k % 40 + 1), f"s{k % 3}") for k in range(300)] + [(7, "one two three", "s0")] * 9 + [(7, "one two", "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mixed(frame).collect():
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in mixing.mix(frame).collect())
    assert got == Counter({k: v for k, v in want.items() if v}) and max(Counter((r["text"], r["source"]) for r in mixing.mix(frame).collect() if r["doc_id"] is None).values()) <= 2


def test_mix_repeats_rows_and_reruns_agree(docs):
    once = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    again = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect()}
    assert all(once.get(k, 0) == v for k, v in again.items())


# --- lines -----------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark):
    rows = [(i, f"https://{'big' if i % 3 else 'small'}.example/{i}", f"<nav>Menu</nav><p>Text {i}<br>Text {i % 4}<!-- x --></p><script>y</script>" if i != 5 else None) for i in range(20)] + [(99, None, "<p>a</p><p>a</p>"), (98, "https://big.example/1", "<nav>Menu</nav>")]
    got = {r["page_id"]: r for r in lines.without_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 22 and got[1]["text"] == "Text 1\nText 1" and got[98]["n_dropped"] == 1 and got[5]["n_lines"] == 0 and got[99]["text"] == "a\na"
    assert lines.without_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_dedup_of_odd_pages(spark):
    """Small hosts, clashing columns, nulls and a very long page."""
    rows = [(1, "https://a.example/1", "<p>same</p><p>one</p>"), (2, "https://a.example/2", "<p>same</p><p>two</p>"), (3, "https://alone.example/", "<p>only</p>"), (None, "no url", "<p>x</p>" * 20_000), (5, None, ""), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit("y") for k in ("host", "lines", "drop", "kept", "n", "h", "pages")})
    got = Counter((r["page_id"], r["n_lines"], r["n_dropped"], r["text"][:5]) for r in lines.without_boilerplate(pages).collect())
    assert got == Counter({(1, 2, 1, "one"): 1, (2, 2, 1, "two"): 1, (3, 1, 0, "only"): 1, (None, 20_000, 0, "x\nx\nx"): 1, (5, 0, 0, ""): 2})


# --- passages --------------------------------------------------------------------------------


def brute_strip(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    out = Counter()
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                keep[k : k + 50] = [False] * 50
        kept = b" ".join(x for x, ok in zip(w, keep) if ok)
        out[d, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_passages_equal_brute_force(spark, docs, odd, none):
    rng = np.random.default_rng(2)
    texts = []
    shared = [f"p{i}" for i in range(73)]
    for d in range(60):
        w = [f"v{x}" for x in rng.integers(0, 400, rng.integers(0, 260))]
        if d % 3 == 0:
            w[20:20] = shared[: 45 + d % 28]
        if d % 5 == 1 and texts:
            w = texts[-1][1].split(" ")
            if len(w) > 60:
                w[rng.integers(len(w))] = "changed"
        if d % 7 == 2:
            w += ["same"] * 130
        texts.append((d, " ".join(w)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for heavy in (passages.HEAVY_WORDS, 300, 0):  # keys stay whole, some are dealt again, and all are dealt down to windows
        assert Counter(map(tuple, passages.stripped(frame, heavy=heavy).collect())) == brute_strip(texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, passages.stripped(docs).collect())) == brute_strip(rows)
    known = [(d, t) for d, t, *_ in ODD if d is not None]
    assert Counter(map(tuple, passages.stripped(odd.filter("doc_id is not null")).collect())) == brute_strip(known)
    assert passages.stripped(odd).count() == len(ODD) and passages.stripped(none).count() == 0


def test_passages_of_repeated_ids(spark):
    """Rows that share an id keep their own words; a later id loses what stands in any of them."""
    a, b = (" ".join(f"{x}{i}" for i in range(70)) for x in "ab")
    rows = [(1, a), (1, b), (1, a), (2, "x " + b), (3, a + " y"), (3, "z " + b), (None, a)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.stripped(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 70, 0): 3, (2, 71, 70): 1, (3, 71, 70): 2, (None, 70, 0): 1})


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(4)
    for _ in range(20):
        s = np.r_[rng.integers(1, 5, 80), 0]
        index = fm_index.FMIndex(s, np.zeros(len(s), np.int32))
        for n in (1, 2, 5):
            p = rng.integers(1, 5, n)
            lo, hi = np.zeros(1, np.int64), np.array([index.n])
            for c in p[::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((s[i : i + n] == p).all() for i in range(len(s) - n + 1))


# --- quality rules ---------------------------------------------------------------------------


def test_quality_rules_equal_brute_force(docs, odd, none):
    for frame in (docs, odd):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judged(frame).collect())
        want = Counter()
        for r in frame.collect():
            t = r["text"] or ""
            w = [x.decode() for x in words(t)]
            grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            rep = len({i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)})
            ls = [x for x in t.split("\n") if words(x)]
            want[r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), rep, len(w) < 10 or 100 * rep > 20 * len(w)] += 1
        assert got == want
        kept = Counter(r["doc_id"] for r in quality_rules.judged(frame).filter("kept").collect())
        filtered = quality_rules.filtered(frame)
        assert filtered.columns == frame.columns and Counter(r["doc_id"] for r in filtered.collect()) == kept
    assert quality_rules.judged(none).count() == 0


def test_cascade_stops_at_the_first_rejection(spark, odd):
    boom = quality_rules.Rule("boom", lambda t, w, s: F.raise_error(F.lit("a later rule ran")).cast("boolean"))
    all_, no = (quality_rules.Rule(str(x), lambda t, w, s, x=x: F.lit(x)) for x in (True, False))
    run = lambda *rules: odd.select(quality_rules.verdict(rules, F.col("text")).alias("v")).collect()
    assert {r["v"] for r in run(no, all_, boom)} == {"True"}
    with pytest.raises(Exception, match="a later rule ran"):
        run(no, boom)


def test_rules_stand_in_the_order_of_rejections_per_cost(docs):
    nothing = quality_rules.Rule("nothing", lambda t, w, s: F.lit(False))
    order = quality_rules.measured_order(docs, (nothing, *quality_rules.BASE, *quality_rules.MORE))
    assert order[-1].name != "short" and order[0].name != "nothing" and len(order) == 12


# --- classifiers -----------------------------------------------------------------------------


@pytest.mark.parametrize("model,label,k,hold", [(quality_model, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers(docs, labels, odd, none, model, label, k, hold):
    r = model.scored(docs, labels).collect()
    assert len(r) == docs.count() and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % k == hold) for x in r)
    assert model.scored(odd, labels).count() == len(ODD) and model.scored(none, labels).count() == 0
    assert model.scored(odd, labels.filter("doc_id < 0")).count() == len(ODD)


def test_quality_scores_on_held_out_documents(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality_model.scored(d, l).join(l, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r >= 0.95


def test_toxic_documents_are_found_on_held_out_documents(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.scored(d, l).join(l, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {x["toxic"]: x["p"] for x in r}
    assert share[1] >= 0.9 and share[0] <= 0.01


def test_quality_scores_equal_densities(docs, labels):
    """The same model by covariance matrices, their inverses and determinants."""
    rows = quality_model.labelled_sample(docs, labels, "quality", quality_model.held_out(), 10_000).collect()
    x, y = np.array([quality_model.features(r["text"].encode()) for r in rows]), np.array([r["y"] for r in rows])
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    model, logit = quality_model.fit(x, y.astype(float)), np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for c, sign in ((0, -1), (1, 1)):
        own = z[y == c]
        cov = np.einsum("ni,nj->ij", own - own.mean(axis=0), own - own.mean(axis=0)) / len(own)
        cov = 0.95 * (0.8 * cov + 0.2 * np.einsum("ni,nj->ij", z, z) / len(z)) + 0.05 * np.eye(z.shape[1])
        gap = z - own.mean(axis=0)
        logit += sign * (-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(quality_model.score(model, x), 1 / (1 + np.exp(-np.clip(logit, -50, 50))), atol=1e-6)


def test_labelled_sample_takes_documents_at_hand(spark, docs):
    """Labels far beyond the documents, and a thousand rows of one id on both sides."""
    ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
    rows = [(10**9 + i, i % 2) for i in range(50_000)] + [(i, i % 2) for i in ids] + [(ids[0], 1)] * 1000 + [(None, 1), (ids[1], None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    many = docs.select("doc_id", "text").union(docs.filter(F.col("doc_id") == ids[0]).select("doc_id", "text").crossJoin(spark.range(1000)).select("doc_id", "text"))
    got = quality_model.labelled_sample(many, labels, "quality", F.lit(False), 100_000).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids) and [r["y"] for r in got if r["doc_id"] == ids[0]] == [1]
    few = quality_model.labelled_sample(many, labels, "quality", F.lit(False), 30).collect()
    assert len(few) == 30 and few == quality_model.labelled_sample(many, labels, "quality", F.lit(False), 30).collect()


def test_levenshtein_lexicon_equals_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = step(row, i, x, b)
        return row[-1]

    def step(row, i, x, b):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        return new

    rng = np.random.default_rng(6)
    terms = ["".join(rng.choice(list("abc"), rng.integers(3, 8))) for _ in range(25)]
    lex = toxicity.Lexicon(terms)
    for _ in range(400):
        w = "".join(rng.choice(list("abc"), rng.integers(3, 9)))
        near = [(distance(w, t), t) for t in set(terms) if distance(w, t) <= lex.bound(len(t))]
        want = (min(near)[1], min(near)[0]) if near else None
        assert lex.nearest(w) == want


def test_quotations_count_apart():
    m = toxicity.Matcher(toxicity.Lexicon(["scoundrel"]))
    said, meant = m.features('she called him a “scoundrel” again'.encode()), m.features(b"you scoundrl, you SCOUNDREL!")
    assert said[2] > 0 and said[0] == 0 and meant[0] > 0 and meant[1] > 0 and meant[2] == 0

"""Each operator against a plain rule, on whole small tables with odd rows and on empty ones."""

import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sentence
from wayfold.llm import arrays, hilbert, langid, lm, mixing, neardup, packing, quality, tokens, topk, trie, vectors
from wayfold.session import checkpoint_dir


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_split_words_of_a_slice():
    import pyarrow as pa
    texts = ["é" * 50 + " ÀB\x0bc "] * 3000 + ["xà Y", None, "", "  "]
    sizes, at, known = arrays.split_words(pa.array(texts).slice(2900))
    assert [[known[i] for i in part] for part in np.split(at, np.cumsum(sizes)[:-1])] == [words_of(t) for t in texts[2900:]]


def test_trie_finds_exactly_its_rows():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 60, (30000, 3)) ** 2, axis=0)
    codes = rng.integers(1, 65535, len(rows)).astype(np.uint16)
    t = trie.Trie.open(np.frombuffer(trie.Trie.of(rows, codes).save(), np.uint8))
    assert (t.positions(rows) == np.arange(len(rows))).all() and (t.codes == codes).all()
    asked = np.unique(rng.integers(0, 3600, (20000, 3)), axis=0)
    there = {tuple(r) for r in rows.tolist()}
    assert [(p >= 0) for p in t.positions(asked)] == [tuple(r) in there for r in asked.tolist()]
    empty = trie.Trie.of(rows[:0], codes[:0])
    assert (empty.positions(asked) == -1).all()


def brute_lm(docs, weight, order=3):
    grams = [Counter() for _ in range(order + 1)]
    for text, train in docs:
        if train:
            w = ["<s>"] + words_of(text) + ["\n"]
            for k in range(1, order + 1):
                grams[k].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    uni = Counter({g[0]: c for g, c in grams[1].items() if g[0] != "<s>"})
    total, kinds = sum(uni.values()), len(uni)

    def p(context, w):
        if not context:
            return (uni[w] + 1) / (total + kinds + 1)
        lower, h = p(context[1:], w), grams[len(context)][tuple(context)]
        return weight * grams[len(context) + 1][(*context, w)] / h + (1 - weight) * lower if h else lower

    out = []
    for text, _ in docs:
        w = ["<s>"] + words_of(text) + ["\n"]
        out.append((len(w) - 1, sum(math.log10((uni[x] + 1) / (total + kinds + 1)) for x in w[1:]), sum(math.log10(p(w[max(0, i - order + 1):i], w[i])) for i in range(1, len(w)))))
    return total, out


def test_lm_equals_plain_counts(spark, messy, none):
    taught = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    rows = messy.select("doc_id", "text", taught.alias("t")).collect()
    total, want = brute_lm([(r["text"], r["t"]) for r in rows], lm.WEIGHT)
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    got = lm.score(messy, taught, hot=20, save=path).collect()
    key = lambda v: tuple(round(x, 2) for x in v)
    assert all(r["train_tokens"] == total for r in got)
    a = sorted((r["n_tokens"], r["base_score"], r["score"]) for r in got)
    b = sorted(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-6 and abs(x[2] - y[2]) < 0.002 * x[0] + 0.01, (x, y)
    again = lm.score(messy, model=path).collect()
    assert sorted(key((r["n_tokens"], r["score"])) for r in again) == sorted(key((r["n_tokens"], r["score"])) for r in got)
    assert lm.score(none).collect() == []
    assert all(abs(r["base_score"]) < 1e-9 for r in lm.score(messy, F.lit(False)).collect())


def test_mix_meets_targets(spark, messy, none):
    rows = spark.createDataFrame([(i, f"s{0 if i < 600 else 1 + i % 4}", "w " * (1 + i % 5)) for i in range(1000)], "doc_id long, source string, text string")
    out = mixing.mix(rows, entropy_share=0.97).collect()
    w = {r["source"]: r["weight"] for r in out}
    assert -sum(v * math.log(v) for v in w.values()) == pytest.approx(0.97 * math.log(5), abs=1e-6)
    spent, have = Counter(), Counter()
    for r in out:
        spent[r["source"]] += r["tokens"]
    for r in rows.collect():
        have[r["source"]] += len(r["text"].split())
    total = sum(have.values())
    assert all(0 <= spent[s] - math.floor(w[s] * total + 1e-6) < 5 for s in w)
    once = mixing.mix(rows, budget_share=0.8, max_repeats=1.0).collect()
    assert len({r["doc_id"] for r in once}) == len(once) and {r["epoch"] for r in once} == {0}
    limit = max(0.8 * total * r["weight"] / have[r["source"]] for r in once)
    assert limit == pytest.approx(1.0, abs=1e-6)
    # Whole passes contain every document once.
    many = Counter((r["doc_id"], r["epoch"]) for r in out)
    assert set(many.values()) == {1}
    odd = mixing.mix(messy.drop("tokens")).collect()
    assert len(odd) == messy.count() - 0 and {r["exponent"] for r in odd} == {1.0}
    assert mixing.mix(none.drop("tokens"), entropy_share=0.9, max_repeats=2.0).collect() == []


def test_even_sources_lose_nothing(spark):
    import corpus_pipeline
    left = lambda sizes: Counter(r["source"] for r in corpus_pipeline.mixture_stage(
        spark, spark.createDataFrame([(100 * s + i, f"s{s}", "w " * 10) for s, n in enumerate(sizes) for i in range(n)], "doc_id long, source string, text string"), "").collect())
    assert left([40] * 4) == {f"s{s}": 40 for s in range(4)}
    some = left([72, 30, 24, 24])  # a little too uneven: a little is given up
    assert 0.9 * 150 <= sum(some.values()) < 150 and some["s0"] < 72 and some["s3"] == 24
    much = left([97, 3])
    assert 90 <= sum(much.values()) <= 92


def test_quality_learns_and_scores_all(spark, messy, none):
    good = [(i, sentence(i, 60)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 60).split())) for i in range(200)]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (5002, "word " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (3, None), (77777, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels, F.col("doc_id") % 2 == 0).collect()}
    assert all(out[i]["predicted"] == int(i < 1000) for i, _ in good + bad)
    assert out[5000]["score"] == out[5001]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["score"] for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).collect() == []
    taken = quality.classify(docs.withColumn("score", F.lit("own")).withColumn("score_", F.lit(2)).withColumn("Predicted", F.lit(3)), labels)
    assert taken.columns[-5:] == ["score__", "score_", "Predicted_", "score", "predicted"] and taken.select("score__").distinct().collect() == [("own",)]


def test_gam_uses_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def longest_alignment(a, b):
    """Words in the longest common subsequence, a bit per word of ``b``."""
    masks = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for w in a:
        grown = row & masks.get(w, 0)
        row = ((row + grown) | (row - grown)) & full
    return len(b) - row.bit_count()


def near_copies(a, b):
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and longest_alignment(a, b) >= 0.8 * max(len(a), len(b))


def brute_classes(rows):
    sets = {d: words_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and near_copies(sets[a], sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def test_near_copies_equal_brute_force(spark, messy, none):
    def edited(text, *at):
        w = text.split()
        for i in at:
            w[i] = f"new{i}"
        return " ".join(w)
    base = sentence(1, 200)
    rows = [(i, sentence(i, 150)) for i in range(10, 30)] + [(100 + i, edited(base, *range(i, 200, 67))) for i in range(60)] + [(i + 200, base) for i in range(5)]
    rows += [(300 + i, base[:300] + " " + sentence(40 + i, 100)) for i in range(20)] + [(400, edited(base, 3)), (401, " ".join(reversed(base.split()))), (402, "one two"), (403, "One  two")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    odd = neardup.classes(messy).collect()
    by = {r["doc_id"]: r for r in odd}
    assert len(odd) == messy.count() and by[106]["class_id"] == 6 and by[100]["class_id"] == 100 and by[102]["kept"] and by[None]["kept"]
    assert neardup.classes(none).collect() == []


def test_near_copies_by_edits(spark):
    """Words replaced, inserted and left out, and a passage moved: the alignment decides, whatever it costs in shingles."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs, strangers = [], [], []
    for k in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(90, 400))]
        rate, kind = rng.choice([0.02, 0.04, 0.06, 0.08, 0.1]), rng.randint(0, 3)
        other = []
        for w in text:
            if rng.random() < rate:
                other += {0: [rng.choice(vocabulary)], 1: [w, rng.choice(vocabulary)], 2: [], 3: [w]}[kind]
            else:
                other.append(w)
        if kind == 3:
            cut, size = rng.randint(0, len(text) // 2), int(len(text) * 0.12)
            other = text[:cut] + text[cut + size:cut + 3 * size] + text[cut:cut + size] + text[cut + 3 * size:]
        if k % 10 == 0:
            other = text[len(text) // 2:] + text[:len(text) // 2]  # all shingles but two, no alignment
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        (pairs if near_copies(text, other) else strangers).append(2 * k)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[a + 1] for a in pairs)
    assert len(pairs) > 120 and found >= 0.95 * len(pairs), (found, len(pairs))
    assert all(got[a] != got[a + 1] for a in strangers) and len(strangers) >= 10


def test_one_id_on_two_texts(spark):
    import corpus_pipeline
    a, b = sentence(1, 80), sentence(2, 80)
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (8, b + " more", "u"), (None, a, None), (9, None, "v"), (9, None, "v"), (9, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    out = {(r["doc_id"], r["text_key"]): (r["class_id"], r["kept"]) for r in neardup.classes(docs).withColumn("text_key", F.col("text_key").substr(1, 4)).collect()}
    key = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()[:4]
    assert out[1, key(a)] == (1, True) and out[7, key(a)] == (1, False) and out[7, key(b)] == (7, True) and out[8, key(b + " more")] == (7, False)
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["text_key"] or "") for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect())
    assert [(d, t) for d, t, _ in kept] == sorted([(1, a), (7, b), (0, a), (9, "")])


def test_alignment_needs_order():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2 ** 40, 300).astype(np.uint64)
    assert neardup.similar(a, np.delete(a, [50, 170]), 5, 0.8)
    assert not neardup.similar(a, np.concatenate((a[150:], a[:150])), 5, 0.8)  # same shingles, other order
    assert not neardup.similar(a, a[:200], 5, 0.8)


def test_repeated_passages_align(spark):
    rng = np.random.default_rng(11)
    repeated = lambda same, own, n: [w for i in range(n) for w in [*(f"r{j}" for j in range(same)), *(f"u{same}x{i}x{j}" for j in range(own))]]
    codes = lambda words: np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    rows = []
    for k, (same, own, n) in enumerate([(15, 15, 12), (30, 30, 10), (60, 60, 8)]):
        a = repeated(same, own, n)
        b = a[same:]  # the first of the equal passages is missing
        assert neardup.similar(codes(a), codes(b), 5, 0.8) and neardup.similar(codes(b), codes(a), 5, 0.8)
        assert not neardup.similar(codes(a), codes(a[len(a) // 2:] + a[:len(a) // 2]), 5, 0.8)
        rows += [(10 * k + 1, " ".join(a)), (10 * k + 2, " ".join(b)), (10 * k + 3, " ".join(a[:same + own] + a[:same] + a[same + own:]))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {d: d // 10 * 10 + 1 for d, _ in rows}

    def plain(a, b, width, band):
        step = min(width, len(a), len(b))
        pairs = {(p + k, q + k) for p in range(len(a) - step + 1) for q in range(len(b) - step + 1) if a[p:p + step] == b[q:q + step] and (len(a) >= width <= len(b) or len(a) == len(b)) for k in range(step)}
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p in range(len(a)):
            for q in range(len(b)):
                best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + 1 if (p, q) in pairs and abs(p - q) <= band else 0)
        return best[-1][-1]
    for _ in range(400):
        a = rng.integers(1, rng.integers(2, 6), rng.integers(1, 40)).tolist()
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.7 else rng.integers(1, 4, rng.integers(1, 40)).tolist()
        b[rng.integers(0, len(b) + 1):0] = a[:rng.integers(0, 9)]
        width, band = int(rng.integers(2, 6)), int(rng.integers(0, 30))
        if b:
            assert neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), width, band) == plain(a, b, width, band)


def test_language_words_then_grams(spark, messy, none):
    en, de = "the house and the garden with water".split(), "das haus und der garten mit wasser".split()
    docs = [(i, " ".join(en[(i + j * j) % 7] for j in range(12)), "en") for i in range(40)] + [(100 + i, " ".join(de[(i + j * j) % 7] for j in range(12)), "de") for i in range(40)]
    probes = [(500, "gardens housewater", "zz"), (501, "gärten haeuser wasserhaus", None), (502, None, "en"), (503, "1234 !!", None), (504, "", "de"), (505, "the " * 100000, None)]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(docs + probes, "doc_id long, text string, lang string"), F.col("doc_id") < 500).collect()}
    assert all(out[d]["lang_pred"] == lang for d, _, lang in docs)
    assert [out[d]["lang_pred"] for d in (500, 501, 502, 503, 504, 505)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    taken = langid.identify(messy.withColumn("score", F.lit("own")).withColumn("said", F.lit(1)).withColumn("row", F.lit(2)))
    assert taken.select("score_", "score", "said", "row").head()["score_"] == "own"
    odd = langid.identify(messy.drop("n", "label")).collect()
    assert len(odd) == messy.count()
    assert {r["lang_pred"] for r in langid.identify(messy, F.lit(False)).collect()} == {"und"} and langid.identify(none).collect() == []


def test_hilbert_curve_steps_by_one_cell(spark):
    n = 8
    cells = spark.createDataFrame([(x, y, z) for x in range(n) for y in range(n) for z in range(n)], "x int, y int, z int")
    order = cells.select("*", hilbert.index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in order] == list(range(n ** 3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(order, order[1:]))


def test_hilbert_shards_are_even(spark, messy, none):
    dims = {"source": F.col("source"), "size": F.octet_length("text").cast("bigint")}
    rows = hilbert.shard(messy, dims, shards=4).collect()
    assert len(rows) == messy.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert sorted(r["size"] for r in rows) == sorted(len((r["text"] or "").encode()) + 8 for r in messy.collect())
    assert hilbert.shard(none, dims).collect() == []
    # Long names with a common beginning lie apart on the curve.
    years = spark.createDataFrame([(i, "x", f"common_crawl_{2000 + i % 4}") for i in range(400)], "doc_id long, text string, source string")
    by = {}
    for r in hilbert.shard(years, {"source": F.col("source")}, shards=4, keep=["source"]).collect():
        by.setdefault(r["shard"], set()).add(r["source"])
    assert sorted(map(sorted, by.values())) == [[f"common_crawl_{2000 + i}"] for i in range(4)]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24)) * (1 + 5 * (rng.random((300, 1)) > 0.9))
    x[50:60] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 24), (None, [1.0] * 24), (904, [2.0, 3.0]), (905, [])]
    got = topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7).collect()
    whole = np.floor(64 * x)
    want = []
    for q in range(0, 300, 20):
        s = (whole @ whole[q]).astype(int)
        best = sorted((-s[i], i) for i in range(300) if i != q)[:7]
        want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).collect() == []


def test_buckets_are_optimal(spark, messy, none):
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 60, 12))
    counts = rng.integers(1, 9, len(lengths))
    from itertools import combinations
    cost = lambda ends: sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts))
    best = min(cost((*c, lengths[-1])) for k in range(4) for c in combinations(lengths[:-1].tolist(), k))
    assert cost(packing.borders(lengths, counts, 4)) == best
    rows = packing.pack(messy, buckets=4, budget=256).collect()
    assert len(rows) == messy.count() and all(r["n_tokens"] <= r["padded"] for r in rows)
    held = Counter((r["batch"], r["row"]) for r in rows)
    assert set(held.values()) == {1} and {b for b, _ in held} == set(range(len({b for b, _ in held})))
    assert all(r["row"] < r["batch_rows"] and (r["batch_rows"] == 1 or r["batch_rows"] * r["padded"] <= 256 or r["padded"] == 0) for r in rows)
    assert packing.pack(none).collect() == []


def test_one_long_text_leaves_the_buckets_optimal(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 50, 300):
        lengths, counts = np.sort(rng.choice(5000, n, replace=False)), rng.integers(1, 40, n)
        plain = [0] + [math.inf] * n  # the programme over every pair of bounds
        for _ in range(min(8, n)):
            plain = [0] + [min([plain[j]] + [plain[i] + int(counts[i:j].sum()) * int(lengths[j - 1]) for i in range(j)]) for j in range(1, n + 1)]
        ends = packing.borders(lengths, counts, 8)
        assert ends[-1] == lengths[-1] and sum(int(c) * min(e for e in ends if e >= x) for x, c in zip(lengths, counts)) == plain[-1]
    sizes = [int(x) for x in rng.integers(1, 400, 500)]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes + [1_000_000])], "doc_id long, text string")
    kinds = sorted(Counter(sizes).items())
    plain = [0] + [math.inf] * len(kinds)
    for _ in range(7):  # the long text has a bucket of its own
        plain = [0] + [min([plain[j]] + [plain[i] + sum(c for _, c in kinds[i:j]) * kinds[j - 1][0] for i in range(j)]) for j in range(1, len(kinds) + 1)]
    assert packing.pack(docs).agg(F.sum("padded")).head()[0] == plain[-1] + 1_000_000


def test_varint_round_trip():
    rng = np.random.default_rng(6)
    values = (2.0 ** rng.uniform(0, 31.9, 5000)).astype(np.uint32)
    sizes = np.array([0, 1, 3, 4, 5, 0, 7, 4980])
    at = 0
    for n, (control, data) in zip(sizes, zip(*tokens.encode(values, sizes))):
        assert len(control) == -(-n // 4) and (tokens.decode(control, data, n) == values[at:at + n]).all()
        at += n


def test_token_files_hold_the_tokenizers_ids(spark, messy, none):
    file = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(file)
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    tokens.write(messy, path, file)
    ids = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    got = tokens.documents(spark, path).collect()
    assert sorted(r["ids"] for r in got) == sorted(ids(r["text"]) for r in messy.collect())
    by = {r["doc_id"]: r for r in got}
    assert by[108]["ids"] == ids(messy.filter("doc_id = 108").head()["text"])
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    crc = {r["doc_id"]: r["ids_crc32"] for r in tokens.read(spark, path).collect()}
    assert crc[1] == zlib.crc32(np.array(by[1]["ids"], "<u4").tobytes())
    empty = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    tokens.write(none, empty, file)
    assert tokens.read(spark, empty).collect() == []


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((700, 32))
    for i in range(200, 400):  # chains and clumps of near copies
        x[i] = x[rng.integers(0, 20)] + 0.25 * rng.standard_normal(32)
    x[400:420] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("inf")] * 32), (903, [1.0] * 5), (904, [2.0] * 5), (905, [])]
    got = {r["vec_id"]: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    true = {(i, j) for i, j in zip(*np.nonzero(link))}
    assert sum(got[i]["n_links"] for i in range(700)) >= 0.98 * len(true)
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(700))
    for i, j in true:
        assert got[i]["component_id"] == got[j]["component_id"]
    assert got[904]["component_id"] == 903 and got[903]["n_links"] == 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 905))
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_rotation_estimates_are_unbiased():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2, 64))
    x[1] = x[0] + 0.3 * x[1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    errors, inside = [], 0
    for seed in range(300):
        guess, bound = vectors.estimates(x, x @ vectors.rotation(64, seed).T)
        errors.append(guess[0, 1] - x[0] @ x[1])
        inside += abs(errors[-1]) <= bound[0]
    assert abs(np.mean(errors)) < 0.02 and inside == 300


def test_stages_take_odd_rows(spark, messy, none, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (messy, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    kept = [r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, messy, "").collect()]
    assert len(kept) == len(set(kept)) and None in kept and 106 not in kept and 5 in kept
    assert {101, 102, 103}.isdisjoint(r["doc_id"] for r in corpus_pipeline.language_stage(spark, messy, "").collect())


def test_words_and_other_tokenizers(spark, messy):
    path = pytest.importorskip("public_tokenizers").path
    from tokenizers import Tokenizer
    rng = random.Random(6)
    marks = [*"abzAZ019.,'!-_\"()<|>", "'s", "'re", chr(0xE9), chr(0xC0), chr(0xD7), chr(0xF7), chr(0xAA), chr(0xB5), chr(0xDF), chr(0x130), chr(0x301), chr(0x65E5), "<|endoftext|>"]
    words = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 7))) for _ in range(8000)]
    made, tok = tokens.WordEncoder(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    for _ in range(2):  # once anew, once remembered
        ids, sizes = made.table(words)
        assert [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in words]
    other = Tokenizer.from_file(path("byte_bpe_50k.json"))
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    tokens.write(messy, folder, path("byte_bpe_50k.json"), end=50256)
    assert sorted(r["ids"] for r in tokens.documents(spark, folder).collect()) == sorted(other.encode(r["text"] or "", add_special_tokens=False).ids + [50256] for r in messy.collect())

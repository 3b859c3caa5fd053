"""Best-fit packing: ids equal the library's, places are gapless, bounds never exceed the optimum."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import bestfit, bytepairs
from wayfold.llm.queries import packing_tokenizer


def library(text):
    from tokenizers import Tokenizer
    global _TOK
    try:
        tok = _TOK
    except NameError:
        tok = _TOK = Tokenizer.from_file(packing_tokenizer())
    return tok.encode(text, add_special_tokens=False).ids


#: White space of several kinds, and characters that other rules take for it.
SPACES = [chr(c) for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2003, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n\n  b\t\tc ", "don't  it's 'S 's", " 's 've", "12 345,678.9", "<|endoftext|> a <|endoftext|>b", "na\xefve Stra\xdfe caf" + "e" + chr(0x301) + " " + chr(0x65E5) * 3 + chr(0x1F600),
       "\r\n\r\n x\r\ny", "!!! ... --- ###", "\x00 a\x00", "x" * 5000, "y" * 9000 + " z", " " * 3000, "ab1" * 40000, " " * 100000 + "x", "ab " * 4000, *[f"{s}a{s}{s}b {s}c{s} d {s} {s}" for s in SPACES]]


def test_ids_equal_the_library():
    rng = random.Random(4)
    alphabet = [*"ab'sZ19.,!-<|>", "\xe9", chr(0x65E5), chr(0x1F600), chr(0x301), *SPACES, " ", " ", " "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    made = bytepairs.TextEncoder(packing_tokenizer())
    assert made.merges
    ids, sizes = made.encode(texts)
    for text, run in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert run.tolist() == library(text), repr(text)


def test_other_tokenizers_take_the_whole_path():
    import public_tokenizers
    from tokenizers import Tokenizer
    file = public_tokenizers.path("word_bpe_49k.json")
    made, tok = bytepairs.TextEncoder(file), Tokenizer.from_file(file)
    ids, sizes = made.encode(ODD)
    assert not made.merges
    assert [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


def sequential(lengths, room):
    """Best-fit decreasing piece by piece: the free room of all sequences."""
    free = []
    for size in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free[free.index(min(fits))] -= size
        else:
            free.append(room - size)
    return sorted(free)


def optimum(lengths, room):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= room and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        go(i + 1, bins + [lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_best_fit_and_bounds():
    rng = random.Random(9)
    met = 0
    for trial in range(300):
        room = rng.choice([10, 17, 30, 64])
        lengths = [rng.randint(1, rng.choice([room, room // 2, 5])) for _ in range(rng.randint(0, 11))]
        bins, places, free = bestfit.best_fit(np.array(lengths, np.int64), room)
        assert sorted(free.tolist()) == sequential(lengths, room)
        for b in range(len(free)):
            at = 0
            for i in sorted(np.flatnonzero(bins == b), key=lambda i: places[i]):
                assert places[i] == at
                at += lengths[i]
            assert at + free[b] == room
        bound, true = bestfit.least(np.bincount(lengths, minlength=room + 1) if lengths else np.zeros(room + 1), room), optimum(lengths, room)
        assert bound <= true <= len(free)
        met += bound == true
    assert met > 270
    assert bestfit.least(np.bincount([700] * 300, minlength=2049), 2048) == 150  # plain sums say 103


def gapless(rows, room):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return by


@pytest.mark.parametrize("kind", ["mixed", "equal", "large", "short"])
def test_exchange_comes_close_to_the_bound(spark, kind):
    rng = random.Random(3)
    draw = {"mixed": lambda: rng.randint(1, 200), "equal": lambda: 70, "large": lambda: rng.randint(101, 200), "short": lambda: rng.randint(1, 5)}[kind]
    rows = [(i, p, draw()) for i in range(1500) for p in range(2)]
    items = spark.createDataFrame(rows, "row long, piece int, length long")
    report = []
    placed = bestfit.place(items, 200, 100, report).collect()
    by = {(r, p): n for r, p, n in rows}
    assert sorted((r["row"], r["piece"]) for r in placed) == sorted(by)
    found = gapless([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": by[r["row"], r["piece"]]} for r in placed], 200)
    bound = bestfit.least(np.bincount([n for *_, n in rows], minlength=201), 200)
    assert bound <= len(found) <= bound + max(2, bound // 100), (len(found), bound, report)
    assert len(found) < report[0][2] or report[0][2] == bound  # the exchange gained, or nothing was left to gain


def test_pack_whole_texts(spark, messy, none):
    room = 64
    docs = messy.select(F.col("doc_id"), "text", F.lit(1).alias("row"), F.lit("x").alias("piece"), F.lit(2).alias("ids"), F.lit(0).alias("length"))
    got = bestfit.pack(docs, packing_tokenizer(), room).collect()
    gapless(got, room)
    want = []
    for r in docs.collect():
        ids = library(r["text"] or "") + [0]
        first = len(ids) % room or room
        cuts = [0, *range(first, len(ids), room), len(ids)] if len(ids) > room else [0, len(ids)]
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert bestfit.pack(none, packing_tokenizer(), room).collect() == []
    cut = bestfit.pieces(docs, packing_tokenizer(), room)
    whole = bestfit.sequences(cut, bestfit.place(cut.select("row", "piece", "length"), room)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(w[3] for w in want) and all(len(r["ids"]) <= 4 * room for r in whole)


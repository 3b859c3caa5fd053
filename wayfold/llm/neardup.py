"""Near-duplicate documents by Order MinHash.

A text's five-word shingles are labelled with their occurrence (first, second, ... time in the
text). A sketch takes the labelled shingles with the smallest hash values and keeps the order in
which they stand in the text, so it agrees for texts with a small edit distance and not for texts
that only share a set of shingles. Texts with an equal sketch are candidates; a candidate pair is
verified by aligning their words in a band around the diagonal: near copies are texts whose longest
alignment covers the least share of the longer one. Shingles find candidates only; one changed word
costs five of them and one word of the alignment.

Equal texts count once. In each bucket all texts are compared with the most central one first;
what these links leave in different groups is compared inside the bucket's tasks, which return the
links that join groups and no list of pairs. A group of thousands of near copies costs one
comparison each that way, and no link between groups is lost.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import array_of, by_value, ragged, slices, split_words
from wayfold.llm.storage import put
from wayfold.operators.graph import components

by_value(__name__)

#: Words in a shingle, least share of the longer text that an alignment covers, sketches of a text,
#: shingles in a sketch. Texts that share a part j of their shingles share a sketch with a chance of
#: about j^2: with one word in 25 changed (j about 0.69) all 24 miss with 1e-7, with one in ten
#: (0.42) with 0.01, with one in five (0.2) with 0.38.
SHINGLE, SIMILAR, SKETCHES, SAMPLED = 5, 0.8, 24, 2
#: Sketches and share of their shingles that texts of one bucket but different groups must have in
#: common to be aligned, texts of a bucket compared in one piece.
SHARED, ALIKE, PIECE = 2, 0.15, 1024
MIX, MIX2, LABEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX2
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, sizes: np.ndarray, width: int, labelled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, ``labelled`` with their occurrence in the text, and their
    number per text. A text with fewer words than ``width`` is one shingle; one without has none."""
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    begin = np.cumsum(sizes) - sizes
    at = ragged(begin, counts)
    ends = np.repeat(begin + sizes, counts)
    h = np.full(len(at), np.uint64(17))
    padded = np.concatenate((words, np.zeros(1, np.uint64)))
    for j in range(width):
        h = mixed(h * MIX + padded[np.where(at + j < ends, at + j, len(words))])
    if not labelled:
        return h, counts
    text = np.repeat(np.arange(len(sizes)), counts)
    order = np.lexsort((h, text))
    same = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1]))) if len(h) else np.empty(0, bool)
    if same.any():
        place = np.arange(len(h))
        seen = place - np.maximum.accumulate(np.where(same, 0, place))
        label = np.empty(len(h), np.uint64)
        label[order] = seen.astype(np.uint64)
        h = np.where(label > 0, mixed(h + label * LABEL), h)
    return h, counts


def sketches(h: np.ndarray, counts: np.ndarray, number: int, sampled: int) -> np.ndarray:
    """One row of sketches per text with shingles."""
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    out = np.zeros((len(counts), number), np.uint64)
    top = np.uint64(2 ** 64 - 1)
    for i in range(number):
        v = mixed(h ^ np.uint64((i + 1) * int(MIX) % 2 ** 64))
        chosen = []
        for _ in range(sampled):
            least = np.minimum.reduceat(v, first) if len(first) else np.empty(0, np.uint64)
            hit = np.flatnonzero(v == np.repeat(least, counts))
            place = hit[np.searchsorted(hit, first)] if len(first) else hit
            chosen.append(np.where(least == top, len(h), place))  # a short text may have fewer
            v[place] = top
        places = np.sort(np.stack(chosen, axis=1), axis=1) if len(first) else np.empty((0, sampled), np.int64)
        padded = np.append(h, np.uint64(0))
        value = np.full(len(counts), np.uint64(i))
        for j in range(places.shape[1]):
            value = mixed(value * MIX + padded[places[:, j]])
        out[:, i] = value
    return out.view(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes, at, known = split_words(texts)
    hashed = pd.util.hash_array(np.array(known, object), categorize=False) if known else np.empty(0, np.uint64)
    return sizes, hashed[at]


def similar(a: np.ndarray, b: np.ndarray, width: int, least: float) -> bool:
    """Whether two texts (hashes of their words) are near copies: an alignment of their words covers a
    share of ``least`` of the longer text."""
    longer = max(len(a), len(b))
    need = least * longer
    if min(len(a), len(b)) < need:
        return False
    # No alignment has more pairs than the texts have words in common.
    known, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    if np.minimum(np.bincount(code[:len(a)], minlength=len(known)), np.bincount(code[len(a):], minlength=len(known))).sum() < need:
        return False
    band = int((1 - least) * longer)  # an alignment that covers enough strays no further from the diagonal
    # Where the labelled shingles in common make a chain that covers enough, it is such an alignment.
    ha, _ = shingles(a, np.array([len(a)]), width)
    hb, _ = shingles(b, np.array([len(b)]), width)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    if len(ib) > 1 and (np.diff(ib) <= 0).any():
        chain = ascending(ib)
        ia, ib = ia[chain], ib[chain]
    step = min(width, len(a))
    if len(ia) and len(a) >= width <= len(b) and int(np.minimum(np.minimum(np.diff(ia), np.diff(ib)), step).sum()) + step >= need:
        return True
    return aligned(a, b, 1, band, need) >= need


def aligned(a: np.ndarray, b: np.ndarray, width: int, band: int, enough: float = 0) -> int:
    """Words in the longest alignment of two texts: pairs of equal words, ascending in both texts, at
    most ``band`` places apart, each pair inside a shingle that both texts have there. Below
    ``enough`` it may be an upper bound.

    The dynamic programme keeps a row as the bits of one whole number: a bit is 0 where the
    alignment grows by a word of ``b``."""
    ha, _ = shingles(a, np.array([len(a)]), width, False)
    hb, _ = shingles(b, np.array([len(b)]), width, False)
    if not len(ha) or not len(hb):
        return 0
    step, big = min(width, len(a), len(b)), len(a) + len(b)
    _, code = np.unique(np.concatenate((ha, hb)), return_inverse=True)
    ca, place = code[:len(ha)], np.arange(len(ha))
    keys = np.sort(code[len(ha):] * big + np.arange(len(hb)))  # places in b, shingle by shingle
    first = np.searchsorted(keys, ca * big + np.maximum(place - band, 0))
    there = np.append(keys, np.iinfo(np.int64).max)[first] <= ca * big + np.minimum(place + band, big - 1)
    begin, end = np.searchsorted(keys, ca * big), np.searchsorted(keys, (ca + 1) * big)
    reach = np.unique(np.add.outer(place[there], np.arange(step)))
    if len(reach) < enough:
        return len(reach)

    @lru_cache(4096)
    def bits(lo, hi):
        at = np.zeros(len(b), np.uint8)
        at[keys[lo:hi] % big] = 1
        return int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")

    def same(x, y):  # words that two texts begin with alike, if they are a shingle or more
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        n = int(differ[0]) if len(differ) else n
        return n if n >= width else 0

    # A common beginning and end belong to some longest alignment.
    head = same(a, b)
    tail = same(a[head:][::-1], b[head:][::-1]) if abs(len(a) - len(b)) <= band else 0
    full = (1 << (len(b) - tail - head)) - 1
    window = (1 << (2 * band + 1)) - 1
    row, recent = full, []
    for p in range(max(0, head - step + 1), len(a) - tail):
        found = 0
        if p < len(ha) and there[p]:
            lo, hi = int(begin[p]), int(end[p])
            found = 1 << int(keys[lo] % big) if hi - lo == 1 else bits(lo, hi)
        recent = [found, *recent[:step - 1]]
        if p < head or not any(recent):
            continue
        match = 0
        for k, x in enumerate(recent):
            match |= x << k
        match = ((match & (window << (p - band) if p >= band else window >> (band - p))) >> head) & full
        grown = row & match
        row = ((row + grown) | (row ^ grown)) & full
    return head + tail + (len(b) - tail - head) - row.bit_count()


def ascending(values: np.ndarray) -> np.ndarray:
    """Positions of a longest ascending chain."""
    tails, ends, before = [], [], np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        tails[k:k + 1], ends[k:k + 1] = [v], [i]
        before[i] = ends[k - 1] if k else -1
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return np.array(chain[::-1])


def sketched(docs: DataFrame, width: int, number: int) -> DataFrame:
    """doc_id, key (of the exact text), n (shingles; 0: the text has no word) and sketch."""
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = array_of(part.column("text"))
                sizes, words = word_hashes(texts)
                h, counts = shingles(words, sizes, width)
                made = iter(sketches(h, counts, number, SAMPLED).tolist())
                keys = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "key": keys, "n": counts, "sketch": [next(made) if n else None for n in counts]}, schema=arrow)

    return docs.mapInArrow(run, "doc_id bigint, key binary, n bigint, sketch array<bigint>")


def texts_of(nodes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """node and w (a 32-bit hash of each word) of the texts named in ``nodes``. Only these texts are
    moved; they are found by id and checksum, as an id may stand on several texts."""
    wanted = texts.join(nodes.distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), F.lower(F.hex("key")).alias("key"))
    found = docs.withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(wanted, ["doc_id", "key"])

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                sizes, words = word_hashes(array_of(part.column("text")))
                small, ends = (words >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "w": pa.array([small[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())})

    return put(found.select("node", "text").mapInArrow(hashed, "node bigint, w binary").dropDuplicates(["node"]))


def words_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.uint64)


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are near copies."""
    pairs = put(pairs)
    words = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, docs)

    def check(batches):
        for batch in batches:
            a, b = batch.column("wa").to_pylist(), batch.column("wb").to_pylist()
            good = [similar(words_of(x), words_of(y), width, least) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    both = (pairs.join(words.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a")
            .join(words.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb"))
    return put(both.mapInArrow(check, "a bigint, b bigint"))


def common(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the texts ``left`` with the texts ``right``: products of their
    0/1 rows, some thousand shingles at a time."""
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[code] > 1)
    shared = shared[np.argsort(code[shared], kind="stable")]
    name = np.cumsum(np.concatenate(([0], np.diff(code[shared]) > 0))) if len(shared) else shared
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(name[-1]) + 1 if len(name) else 0, 4096):
        lo, hi = np.searchsorted(name, [begin, begin + 4096])
        x = np.zeros((len(rows), 4096), np.float32)
        x[owner[shared[lo:hi]], name[lo:hi] - begin] = 1
        out += x[left] @ x[right].T
    return out


def joining(ids, labels, sketch, words, place: int, sides, width: int, least: float) -> list[tuple[int, int]]:
    """Links that join the groups of one bucket (or of two pieces of it, told apart by ``sides``).

    Looked at are pairs of different groups that share ``SHARED`` sketches, this bucket's being the
    first of them. Once two groups are joined, no more of their pairs are."""
    n = len(ids)
    root = {int(x): int(x) for x in labels}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    counts = np.zeros(n, np.int64)
    rows: list = []
    for begin in range(0, n, 256):
        block = slice(begin, min(n, begin + 256))
        agree = np.zeros((block.stop - begin, n), np.int8)
        early = np.zeros(agree.shape, bool)
        for t in range(sketch.shape[1]):
            same = sketch[block, t][:, None] == sketch[:, t][None, :]
            agree += same
            if t < place:
                early |= same
        mask = (agree >= SHARED) & ~early & (labels[block][:, None] != labels[None, :])
        mask &= (ids[block][:, None] < ids[None, :]) if sides is None else (~sides[block][:, None] & sides[None, :])
        i = np.flatnonzero(mask.any(1))
        j = np.flatnonzero(mask.any(0))
        if not len(i):
            continue
        if not rows:
            rows = [shingles(w, np.array([len(w)]), width)[0] for w in words]
            counts = np.array([len(r) for r in rows])
        both = common(rows, i + begin, j)
        alike = both / (counts[i + begin][:, None] + counts[j][None, :] - both)
        a, b = np.nonzero(mask[np.ix_(i, j)] & (alike >= ALIKE))
        pairs += zip((-alike[a, b]).tolist(), (i[a] + begin).tolist(), j[b].tolist())
    out = []
    for _, a, b in sorted(pairs):
        x, y = top(int(labels[a])), top(int(labels[b]))
        if x != y and similar(words[a], words[b], width, least):
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, least: float = SIMILAR, number: int = SKETCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id reached over links), kept (the row has
    the text that stands for its class) and text_key (MD5 of the text).

    Texts link when they are equal, or near copies by ``similar``. Null texts and texts without
    words link with nothing, and neither do rows with a null id (class null, kept). Rows that repeat
    an id belong to one class each by their text. For a class stands, of the texts with its smallest
    id, that of the smallest checksum; rows that repeat both id and text are all kept. Runs several
    jobs. An empty table gives no rows."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = put(sketched(docs, width, number))
    live = table.filter("n > 0 and doc_id is not null")
    texts = put(live.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    spread = texts.select("node", "n", "sketch", F.posexplode("sketch").alias("i", "s"))
    sizes = spread.groupBy("i", "s").agg(F.count("*").alias("c")).filter("c > 1")
    members = put(spread.join(sizes, ["i", "s"]))
    # The text whose sketches are most common stands in the middle of its near copies.
    fame = members.groupBy("node").agg(F.sum("c").alias("fame"))
    known = members.join(fame, "node")
    centre = put(known.groupBy("i", "s").agg(F.max(F.struct("fame", (-F.col("node")).alias("m"), F.col("n").alias("cn"))).alias("x")).select("i", "s", (-F.col("x.m")).alias("hub"), F.col("x.cn").alias("hn")))
    close = lambda x, y: F.least(x, y) + width >= F.greatest(x, y) * least
    stars = members.join(centre, ["i", "s"]).filter((F.col("node") != F.col("hub")) & close(F.col("n"), F.col("hn"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = verified(stars, texts, docs, width, least)
    labels = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), [])
    # Second round, inside buckets whose texts are still in different groups; large ones in pieces.
    placed = members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = placed.groupBy("i", "s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("i", "s", F.ceil(F.col("c") / PIECE).cast("int").alias("p"))
    rest = put(placed.drop("c").join(open_, ["i", "s"]))
    own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    pieces = (rest.join(texts_of(rest.select("node"), texts, docs), "node").withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, p - 1)")))
              .select("i", "s", "node", "label", "sketch", "w", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")))

    def joined(group: pa.Table) -> pa.Table:
        sketch = np.array(group.column("sketch").to_pylist(), np.int64)
        lo, hi, mine = (group.column(c).to_numpy() for c in ("lo", "hi", "own"))
        found = joining(group.column("node").to_numpy(), group.column("label").to_numpy(), sketch, [words_of(w) for w in group.column("w").to_pylist()], group.column("i")[0].as_py(),
                        None if lo[0] == hi[0] else mine == hi[0], width, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    extra = put(pieces.groupBy("i", "s", "lo", "hi").applyInArrow(joined, "a bigint, b bigint"))
    if not extra.isEmpty():
        labels = components(edges.unionByName(extra).select(F.col("a").alias("src"), F.col("b").alias("dst")), [])
    named = texts.select("key", "node", "rep").join(labels.select("node", "label"), "node", "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    chosen = named.groupBy("label").agg(F.min(F.struct("rep", "key")).alias("m")).select("label", F.col("m.rep").alias("class_id"), F.col("m.key").alias("shown"))
    linked = live.select("doc_id", "key").join(named.drop("rep").join(chosen, "label"), "key").select("doc_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("shown"))).alias("kept"), "key")
    alone = table.filter("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "key")
    return linked.unionByName(alone).select("doc_id", "class_id", "kept", F.lower(F.hex("key")).alias("text_key"))

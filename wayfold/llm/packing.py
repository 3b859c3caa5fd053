"""Packing by optimal length buckets.

The global histogram of exact lengths is cut into buckets by dynamic programming, so that padding every
document to the longest of its bucket costs as few tokens as possible. Inside a bucket documents
are shuffled and dealt into batches that keep to a budget of padded tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import ragged
from wayfold.llm.mixing import words
from wayfold.operators.ordered import ordinals
from wayfold.session import cut

#: Documents of a bucket that are ordered in one task.
PART_DOCS = 20000


def borders(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padded total.

    ``longest`` are the ascending distinct lengths, ``counts`` their documents.
    The padded total of a bucket is its documents times its upper bound. Ties: shorter bounds."""
    n = len(longest)
    if not n:
        return []
    sums = np.concatenate(([0], np.cumsum(counts))).astype(float)
    lengths = longest.astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        cost, i = cheapest(best, sums, lengths)
        better = cost < best[1:]
        back.append(np.concatenate(([-1], np.where(better, i, -1))))
        best = np.concatenate((best[:1], np.where(better, cost, best[1:])))
    out, j = [], n
    for came in reversed(back):
        if j and came[j] >= 0:
            out.append(int(longest[j - 1]))
            j = int(came[j])
    return out[::-1]


def cheapest(best: np.ndarray, sums: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j = 1..n of a last bucket that holds the lengths i..j-1: its least total, and the
    first i that gives it.

    That i never falls as j grows, so the middle j of a range halves the starts left for the others:
    n log n totals instead of n^2, one level of halves at a time."""
    n = len(lengths)
    cost, start = np.empty(n + 1), np.empty(n + 1, np.int64)
    lo, hi, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(mid - 1, most) - least + 1
        at, first = ragged(least, sizes), np.cumsum(sizes) - sizes
        total = best[at] + (np.repeat(sums[mid], sizes) - sums[at]) * np.repeat(lengths[mid - 1], sizes)
        cost[mid] = np.minimum.reduceat(total, first)
        hit = np.flatnonzero(total == np.repeat(cost[mid], sizes))
        start[mid] = at[hit[np.searchsorted(hit, first)]]
        lo, hi, least, most = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (least, start[mid]), (start[mid], most)))
        open_ = lo <= hi
        lo, hi, least, most = lo[open_], hi[open_], least[open_], most[open_]
    return cost[1:], start[1:]


def pack(docs: DataFrame, buckets: int = 8, budget: int = 8192, doc_id: str = "doc_id", text: str = "text", length: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, padded (tokens after padding), batch
    (number from 0 over all buckets), row (place in the batch) and batch_rows (its capacity).

    Length is the number of words unless given. A batch holds budget / padded documents, one at
    least, so a document longer than the budget is a batch by itself; the last batch of a bucket
    may be smaller. Null and empty texts have length 0. Rows that repeat an id are separate
    documents. An empty table gives no rows."""
    count = words(F.col(text)) if length is None else length.cast("bigint")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), count.alias("n_tokens")))
    # Distinct lengths are at most sqrt(2 * all tokens) rows: 1.4 million for 10^12 tokens.
    kinds = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    longest, counts = kinds.column("n_tokens").to_numpy(), kinds.column("n").to_numpy()
    ends = borders(longest, counts, buckets)
    sizes = [int(counts[(longest > lo) & (longest <= hi)].sum()) for lo, hi in zip([-1, *ends], ends)]
    room = [max(1, budget // max(1, e)) for e in ends]
    first = np.concatenate(([0], np.cumsum([-(-s // r) for s, r in zip(sizes, room)]))).tolist()
    if not ends:
        ends, sizes, room = [0], [0], [1]

    def pick(values):
        return F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col("_b") + 1)

    bucket = sum([(F.col("n_tokens") > e).cast("int") for e in ends[:-1]], F.lit(0))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = rows.withColumn("_b", bucket).select("*", pick(ends).alias("padded"), pick(room).alias("batch_rows"), pick(first).alias("_first"), key.alias("_key"),
                                                       pick([-(-s // PART_DOCS) for s in sizes]).alias("_parts"))
    # md5 is uniform: its leading digits split a bucket into parts that follow the order of the key.
    part = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("_parts"))
    ranked = ordinals(placed.withColumn("_part", part), ["_b"], ["_key", "n_tokens"], F.col("_part"), "_rank")
    return ranked.select("doc_id", "n_tokens", F.col("_b").alias("bucket"), "padded", (F.col("_first") + F.floor((F.col("_rank") - 1) / F.col("batch_rows"))).alias("batch"),
                         ((F.col("_rank") - 1) % F.col("batch_rows")).alias("row"), "batch_rows")

"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are normalised and turned by one random rotation; the signs of the turned components are
the code. A stored correction factor (the inner product of a vector with its own code) makes
code-against-vector products unbiased estimates of the cosine, with a bound on their error that
holds with high confidence. Where the estimate plus its bound stays below the threshold the pair is
done; all others are recomputed in double precision.

Pairs to look at come from tables keyed by a few code bits of further rotations, so vectors far
apart rarely meet. Equal vectors are collapsed first and counted by weight; links are counted and
joined inside each bucket, so no list of pairs leaves a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value
from wayfold.llm.topk import usable
from wayfold.operators.graph import components
from wayfold.session import cut

by_value(__name__)

#: Confidence of the error bound in standard deviations, chance to miss a pair exactly at the
#: threshold, vectors in a bucket on average, rows of a bucket compared in one piece.
SIGMAS, MISS, BUCKET, PIECE = 4.0, 0.002, 200, 2048


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables for the chance ``MISS`` at the threshold."""
    bits = min(24, max(0, round(math.log2(max(rows, 1) / BUCKET))))
    same = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same ** bits))) if bits else 1


def estimates(x: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all rows (code) with all rows (vector), and the bound of each row's error."""
    dims = x.shape[1]
    code = np.where(turned >= 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dims))
    factor = (code * turned).sum(1)  # at least 1 / sqrt(dims)
    bound = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor * SIGMAS / math.sqrt(max(dims - 1, 1))
    return code @ turned.T.astype(np.float32) / factor[:, None], bound


def links(ids, weights, x, turned, buckets, table, threshold, other=None):
    """Links among the rows of a piece, or between two pieces: per row its linked weight, and the
    smallest id it reaches inside the piece. ``buckets`` (rows, tables) tells in which tables two
    rows meet; a link counts in the first of them only."""
    first = np.arange(len(ids)) if other is None else np.flatnonzero(~other)
    second = first if other is None else np.flatnonzero(other)
    guess, bound = estimates(np.concatenate((x[first], x[second])) if other is not None else x, np.concatenate((turned[first], turned[second])) if other is not None else turned)
    if other is not None:
        guess, bound = guess[:len(first), len(first):], bound[:len(first)]
    i, j = np.nonzero(guess + bound[:, None] >= threshold - 1e-6)
    i, j = first[i], second[j]
    if other is None:
        keep = i < j
        i, j = i[keep], j[keep]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[a:a + 65536]], x[j[a:a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)])
    keep = exact >= threshold
    i, j = i[keep], j[keep]
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= buckets[i, t] != buckets[j, t]
    n = np.bincount(i[fresh], weights[j[fresh]], len(ids)) + np.bincount(j[fresh], weights[i[fresh]], len(ids))
    low = ids.copy()
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == before).all():
            break
    return n.astype(np.int64), low


def near(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    Two vectors link when their cosine in double precision is at least ``threshold``; component_id
    is the smallest id reached over links, kept is true for it. Null, empty or zero vectors and
    those with null or non-finite components link with nothing, like vectors of other lengths.
    Rows that repeat an id are separate vectors (and link when they are equal). A pair exactly at
    the threshold is missed with a chance of ``MISS``, a closer one more rarely; no false link is
    made. An empty table gives no rows."""
    rows = cut(vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.when(usable(vector), F.transform(vector, lambda v: v.cast("double"))).alias("v")))
    live = rows.filter(F.coalesce(F.exists("v", lambda v: v != 0), F.lit(False)) & F.col("id").isNotNull())
    # Equal vectors are one node, named by its smallest id and weighing their number.
    member = live.withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda v: (v + 0.0).cast("string"))), 256))
    nodes = cut(member.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("w"), F.first("v").alias("v")))
    bits, tables = plan(nodes.count(), threshold)

    def keyed(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, begin = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                x = flat[begin[own][:, None] + np.arange(dims)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                held = np.zeros((len(own), tables), np.int64)
                turns = -(-bits * tables // int(dims)) if bits else 0
                signs = np.concatenate([x @ rotation(int(dims), seed + 1 + r).T >= 0 for r in range(turns)], axis=1) if turns else None
                for t in range(tables if bits else 0):
                    held[:, t] = signs[:, t * bits:(t + 1) * bits] @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").take(pa.array(own)), "w": batch.column("w").take(pa.array(own)), "dims": pa.array(np.full(len(own), dims), pa.int32()),
                                                  "x": pa.array([r.tobytes() for r in x], pa.binary()), "held": pa.array(list(held), pa.list_(pa.int64()))})

    coded = cut(nodes.select("node", "w", "v").mapInArrow(keyed, "node bigint, w bigint, dims int, x binary, held array<bigint>"))
    spread = coded.select("*", F.posexplode("held").alias("t", "b"))
    # Buckets above the piece size are cut into pieces; every two pieces meet once.
    full = spread.groupBy("dims", "t", "b").agg(F.count("*").alias("n")).filter("n > 1").select("dims", "t", "b", F.ceil(F.col("n") / PIECE).cast("int").alias("p"))
    own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    pieces = (spread.join(full, ["dims", "t", "b"]).withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, p - 1)")))
              .select("node", "w", "x", "held", "dims", "t", "b", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")))

    def compare(group: pa.Table) -> pa.Table:
        ids, w = group.column("node").to_numpy(), group.column("w").to_numpy().astype(float)
        dims, table = group.column("dims")[0].as_py(), group.column("t")[0].as_py()
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), float).reshape(-1, dims)
        held = np.array(group.column("held").to_pylist(), np.int64).reshape(len(ids), -1)
        lo, hi, mine = (group.column(c).to_numpy() for c in ("lo", "hi", "own"))
        n, low = links(ids, w, x, x @ rotation(dims, seed).T, held, table, threshold, None if lo[0] == hi[0] else mine == hi[0])
        keep = (low != ids) | (n > 0)
        return pa.table({"node": pa.array(ids[keep]), "n": pa.array(n[keep], pa.int64()), "low": pa.array(low[keep])})

    found = cut(pieces.groupBy("dims", "t", "b", "lo", "hi").applyInArrow(compare, "node bigint, n bigint, low bigint"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.filter("low <> node").select(F.col("low").alias("src"), F.col("node").alias("dst")).distinct()
    roots = components(edges, [])
    classes = nodes.select("key", "node", "w").join(counts, "node", "left").join(roots.select("node", "label"), "node", "left")
    named = member.select("id", "key").join(classes.select("key", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("label", "node").alias("c")), "key").select("id", "n", "c")
    alone = rows.filter(~F.coalesce(F.exists("v", lambda v: v != 0), F.lit(False)) | F.col("id").isNull()).select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("c"))
    return named.unionByName(alone).select(F.col("id").alias(vec_id), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))

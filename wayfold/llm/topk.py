"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie in blocks, dimension after dimension. A query adds its products one block of
dimensions at a time; what the remaining dimensions can still add is at most the product of the
remaining lengths of both vectors (Cauchy-Schwarz). Candidates whose partial sum plus that bound
stays below the k-th best so far are dropped, and only survivors are carried to the next block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value
from wayfold.session import cut

by_value(__name__)

#: Vectors in a block of candidates and of queries, and dimensions added at a time.
CANDIDATES, QUERIES, STEP = 8192, 2048, 8


def search(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, candidate id, score) arrays of each query's k best other candidates.

    Whole numbers stay exact: float64 below 2^53, 64-bit integers beyond."""
    dims = vectors.shape[1]
    peak = (np.abs(vectors).max(initial=0) + 1.0) * (np.abs(queries).max(initial=0) + 1.0) * max(dims, 1)
    if peak >= 2.0 ** 53:
        vectors, queries = vectors.astype(np.int64), queries.astype(np.int64)
    order = np.argsort(-(vectors.astype(float) ** 2).sum(0), kind="stable")  # heaviest dimensions first
    columns = np.ascontiguousarray(vectors[:, order].T)
    turned = queries[:, order]
    edges = list(range(0, dims, STEP)) + [dims]
    rest = [np.sqrt((columns[e:].astype(float) ** 2).sum(0)) * (1 + 1e-9) for e in edges[1:]]
    left = [np.sqrt((turned[:, e:].astype(float) ** 2).sum(1)) * (1 + 1e-9) for e in edges[1:]]
    out = []
    start = turned[:, :edges[1]] @ columns[:edges[1]] if dims else np.zeros((len(turned), len(ids)))
    for q in range(len(turned)):
        alive = np.flatnonzero(ids != qids[q])
        part = start[q, alive]
        for s in range(1, len(edges)):
            bound = rest[s - 1][alive] * left[s - 1][q]
            if len(alive) > k:
                least = part - bound
                floor = np.partition(least, len(least) - k)[len(least) - k]
                stay = part + bound >= floor - 1e-6 * abs(floor) - 1e-6
                alive, part = alive[stay], part[stay]
            if s < len(edges) - 1:
                part = part + turned[q, edges[s]:edges[s + 1]] @ columns[edges[s]:edges[s + 1], alive]
        best = np.lexsort((ids[alive], -part))[:k]
        out.append((np.full(len(best), qids[q]), ids[alive[best]], part[best].astype(np.int64)))
    return [np.concatenate(v) if out else np.empty(0, np.int64) for v in (zip(*out) if out else ((), (), ()))]


def usable(vector: str = "embedding") -> Column:
    """The vector is there, has components, and none is null or non-finite."""
    x = F.col(vector)
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def top(vectors: DataFrame, chosen: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best others.

    Components become floor(scale * x). Queries are the rows where ``chosen`` holds. Ties go to the
    smaller id; with fewer others all are returned. Null ids, null vectors and vectors with null or
    non-finite components take no part; vectors of different lengths are not compared; rows that
    repeat an id are separate candidates, but never a query's own, and ask once if they are equal.
    Empty vectors take no part. An empty table gives no rows."""
    whole = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = cut(vectors.filter(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.coalesce(chosen, F.lit(False)).alias("asks"), whole.alias("v")))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q"))
    sizes = cut(sizes.select("dims", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cb"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERIES)).cast("int").alias("qb")).filter("qb > 0"))
    sized = rows.withColumn("dims", F.size("v")).join(F.broadcast(sizes) if sizes.count() < 10000 else sizes, "dims")

    def block(n, seed):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.col(n)).cast("int")

    # Every block of queries meets every block of candidates once; blocks are copied, not pairs.
    left = sized.filter("asks").dropDuplicates(["id", "v"]).select("id", "v", "dims", block("qb", 1).alias("q"), F.explode(F.expr("sequence(0, cb - 1)")).alias("c"))
    right = sized.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("dims").alias("dims2"), block("cb", 2).alias("c2"), F.explode(F.expr("sequence(0, qb - 1)")).alias("q2"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        def matrix(t, end=""):
            n = t.num_rows
            flat = t.column(f"v{end}").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t.column(f"id{end}").to_numpy().astype(np.int64), flat.reshape(n, -1) if n else flat.reshape(0, 0)
        ids, x = matrix(held, "2")
        qids, y = matrix(asked)
        found = search(ids, x, qids, y, k) if len(qids) and len(ids) else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    parts = left.groupBy("dims", "q", "c").cogroup(right.groupBy("dims2", "q2", "c2")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

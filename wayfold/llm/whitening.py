"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers; the distinct ones are the fit list. Each step multiplies the centred
rows with a vector and the product with the transposed rows again, in one distributed pass that
returns one number per dimension. Left vectors are never stored: each is the centred rows times a
short vector kept on the driver, so reorthogonalising against all of them needs only what the pass
returned. Right vectors are reorthogonalised on the driver. The singular values of the small
bidiagonal matrix give the deviations, its singular vectors the components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value
from wayfold.llm.storage import put
from wayfold.llm.topk import usable

by_value(__name__)

#: Bytes of vectors in one block. Steps made at least (all of them where there are fewer
#: dimensions, so repeated deviations are told apart too); relative residual that ends the steps
#: after that; relative size below which a length counts as zero, and a deviation as none.
BLOCK, STEPS, RESIDUAL, ZERO, RANK = 4 << 20, 64, 1e-14, 1e-12, 1e-10


@dataclass
class Whitening:
    """``n`` vectors of the fit list, their ``sums`` (whole numbers), ``components`` as columns,
    ``variances`` along them, the ``trace`` of the covariance and the ``identity_error``."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): vectors as whole numbers floor(scale * c). Vectors that are null or empty, hold
    null or non-finite entries, or have another length than most (ties: the longer) go."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.filter(usable(vector)).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return rows.filter(F.size("x") == (sizes["d"] if sizes else 0))


def blocks(rows: DataFrame) -> DataFrame:
    """(rows, data): each distinct x once, many to a row of the table."""
    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            if not len(lists):
                continue
            flat = lists.flatten().to_numpy().astype(np.int64)
            d = len(flat) // len(lists)
            most = max(1, BLOCK // (8 * d))
            for a in range(0, len(lists), most):
                part = flat[a * d:(a + most) * d]
                yield pa.RecordBatch.from_pydict({"rows": pa.array([len(part) // d], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    return put(rows.select("x").distinct().mapInArrow(run, "rows int, data binary"))


def totals(table: DataFrame, part) -> dict[int, float]:
    """Sums over all blocks of the numbers ``part`` makes of one; one row per number reaches the driver."""
    def run(batches):
        held = None
        for batch in batches:
            for n, data in zip(batch.column("rows").to_pylist(), batch.column("data")):
                now = part(np.frombuffer(data.as_buffer(), np.int64).reshape(n, -1))
                held = now if held is None else held + now
        if held is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(held)), "v": held})

    kind = "double" if part.__name__ != "counts" else "bigint"
    return {r["i"]: r["v"] for r in table.mapInArrow(run, f"i bigint, v {kind}").groupBy("i").agg(F.sum(F.col("v") if kind == "double" else F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def sums(table: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension; halves of 32 bits keep a task's sums exact."""
    def counts(x):
        return np.concatenate(([len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)))

    found = totals(table, counts)
    d = (len(found) - 1) // 2
    return int(found.get(0, 0)), [(int(found[1 + i]) << 32) + int(found[1 + d + i]) for i in range(d)]


def product(table: DataFrame, mean: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, float]:
    """For p = (centred rows) t: the transposed centred rows times p, and the squared length of p."""
    def both(x):
        centred = x - mean
        p = centred @ t
        return np.append(centred.T @ p, p @ p)

    found = totals(table, both)
    out = np.array([found[i] for i in range(len(found))])
    return out[:-1], out[-1]


def bidiagonal(multiply, dims: int, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest singular values and right singular vectors (columns) of a matrix X with
    ``dims`` columns; ``multiply(t)`` returns X'Xt and |Xt|^2.

    Step k has Xv = beta u_before + alpha u and X'u = alpha v + beta v_next. A length that vanishes
    means an invariant subspace; a fresh direction orthogonal to all right vectors goes on."""
    rng = np.random.default_rng(seed)
    right = np.zeros((dims, 0))  # v
    weights, images = np.zeros((dims, 0)), np.zeros((dims, 0))  # u = X weights, images = X'u
    matrix = np.zeros((dims, dims))

    def fresh():
        v = rng.standard_normal(dims)
        for _ in range(2):
            v -= right @ (right.T @ v)
        return v / np.linalg.norm(v)

    v, beta, largest = fresh(), 0.0, 0.0
    for k in range(dims):
        right = np.column_stack((right, v))
        t = v - beta * weights[:, -1] if beta else v
        image, square = multiply(t)
        # Reorthogonalise p = Xt against all u = Xw: u'p = w'(X'p), and u itself has length 1.
        across = weights.T @ image
        t, image = t - weights @ across, image - images @ across
        alpha = float(np.sqrt(max(square - across @ across, 0)))
        largest = max(largest, alpha, beta)
        if alpha <= ZERO * largest or not largest:
            weights, images = np.column_stack((weights, np.zeros(dims))), np.column_stack((images, np.zeros(dims)))
            rest = np.zeros(dims)
        else:
            matrix[k, k] = alpha
            weights, images = np.column_stack((weights, t / alpha)), np.column_stack((images, image / alpha))
            rest = images[:, -1] - alpha * v
            for _ in range(2):
                rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        done = k + 1 == dims
        if k + 1 >= min(STEPS, dims) and not done:
            left, values, _ = np.linalg.svd(matrix[:k + 1, :k + 1])
            done = bool((beta * np.abs(left[-1, :count]) <= RESIDUAL * max(values[0], 1e-300)).all())
        if done:
            _, values, turned = np.linalg.svd(matrix[:k + 1, :k + 1])
            return values[:count], right @ turned[:count].T
        if beta <= ZERO * largest:
            v, beta = fresh(), 0.0
        else:
            v = rest / beta
            matrix[k, k + 1] = beta
    return np.zeros(0), np.zeros((dims, 0))


def fit(rows: DataFrame, count: int = 4) -> Whitening | None:
    """Up to ``count`` components of the distinct vectors of ``rows`` (x); fewer where the covariance
    has a smaller rank, None where there is no vector."""
    table = blocks(rows)
    n, total = sums(table)
    if not n:
        return None
    mean = np.array([s / n for s in total])

    def spread(x):
        centred = x - mean
        return np.array([(centred * centred).sum()])

    trace = totals(table, spread)[0] / n
    values, vectors = bidiagonal(lambda t: product(table, mean, t), len(mean), count)
    live = values > RANK * max(values[0], 1e-300) if trace > 0 else np.zeros(len(values), bool)
    vectors, variances = vectors[:, live], values[live] ** 2 / n
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.shape[1] else vectors
    k = len(variances)

    def moments(x):
        y = (x - mean) @ vectors / np.sqrt(variances)
        return np.concatenate((y.sum(0), (y.T @ y).ravel()))

    error = 0.0
    if k:
        found = totals(table, moments)
        flat = np.array([found[i] for i in range(k + k * k)]) / n
        error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())
    return Whitening(n, total, vectors, variances, trace, error)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): every row's squared distance from the mean times n squared, exact
    (null where it passes 64 bits), and its whitened vector, one entry per component."""
    n, total, mean, turn = model.n, model.sums, model.mean, model.components / np.sqrt(model.variances)
    kind = dict((f.name, f.dataType.simpleString()) for f in rows.schema)["vec_id"]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)
            bound = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, total))
            if len(total) * bound ** 2 < 1 << 63:
                off = x * n - np.array(total, np.int64)
                far = (off * off).sum(1).tolist()
            else:
                far = [sum((v * n - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
                far = [f if f < 1 << 63 else None for f in far]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(far, pa.int64()), pa.array(list((x - mean) @ turn), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, count: int = 4, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1, by falling variance), n,
    deviation, whitened, explained (share of the trace) and identity_error.

    Vectors that ``whole`` drops give no rows. The fit list holds each distinct vector once, so
    repeated rows change no component; each of them still gets its own rows. Ids may repeat or be
    null. Where the fit list has no spread, or no vector, there are no rows."""
    rows = put(whole(vectors, vec_id, vector, scale))
    model = fit(rows, count)
    if model is None or not len(model.variances):
        kind = dict((f.name, f.dataType.simpleString()) for f in rows.schema)["vec_id"]
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    long = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.element_at(explained, F.col("_at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))

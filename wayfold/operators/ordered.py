"""Ordered computations that never need a whole group in one task.

Every helper cuts a group into blocks of its order column. Rows are shuffled by (keys, block), so a
key holding a large share of all rows spreads over many tasks; what has to cross a block border is
either copied into the neighbouring block (fixed-width frames) or carried by one summary row per
block (running aggregates and ordinals).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def blocked(df: DataFrame, seq: str = "seq", before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds ``_blk`` and ``_own``; rows within ``before``/``after`` of a border also enter the
    neighbouring block as context (``_own`` false). ``seq`` must be dense within a group."""
    home = F.floor(F.col(seq) / block)
    offset = F.pmod(F.col(seq), F.lit(block))
    blocks = F.concat(F.array(home),
                      F.when((offset < after) & (F.col(seq) >= block), F.array(home - 1)).otherwise(F.array().cast("array<bigint>")),
                      F.when(offset >= block - before, F.array(home + 1)).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_own", F.col("_blk") == F.floor(F.col(seq) / block))


def neighbours(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, int]], seq: str = "seq",
               block: int = BLOCK) -> DataFrame:
    """Adds columns of nearby rows: ``{"lat2": ("lat", 1)}`` is the next row's latitude."""
    shifts = [shift for _, shift in columns.values()]
    before, after = max(0, -min(shifts)), max(0, max(shifts))
    frame = Window.partitionBy(*keys, "_blk").orderBy(seq)
    out = blocked(df, seq, before, after, block)
    out = out.select("*", *[F.lead(source, shift).over(frame).alias(name) if shift >= 0
                            else F.lag(source, -shift).over(frame).alias(name) for name, (source, shift) in columns.items()])
    return out.filter("_own").drop("_blk", "_own")


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: Sequence, values: dict[str, tuple], bucket: Column,
            backward: bool = False, exclusive: bool = False, totals: bool = False) -> DataFrame:
    """Running sum, max or min of each group in ``order``.

    ``values`` maps names to (expression, how) or (expression, how, reading backward). ``bucket``
    must be non-decreasing in ``order``; only one row per bucket crosses buckets. With ``totals``
    the group's total comes along as ``<name>_total``. ``df`` is read twice: once for one narrow
    partial aggregate per bucket, once for the rows."""
    base = df.withColumn("_bucket", bucket)
    names = list(values)
    back = {n: v[2] if len(v) > 2 else backward for n, v in values.items()}
    base = base.select("*", *[v[0].alias(f"_v_{n}") for n, v in values.items()])
    fold = {n: _FOLD[v[1]] for n, v in values.items()}

    def across(n):
        step = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc() if back[n] else F.col("_bucket"))
        return fold[n](f"_b_{n}").over(step.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}")

    sums = base.groupBy(*keys, "_bucket").agg(*[fold[n](f"_v_{n}").alias(f"_b_{n}") for n in names])
    whole = [fold[n](f"_b_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in names] if totals else []
    carried = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), *map(across, names), *whole)
    match = F.col("_bucket").eqNullSafe(F.col("_k_bucket"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    joined = base.join(carried, match, "left")

    def combined(n):
        ends = [o if isinstance(o, Column) else F.col(o) for o in order]
        frame = Window.partitionBy(*keys, "_bucket").orderBy(*ends)
        inside = frame.rowsBetween(1 if exclusive else 0, Window.unboundedFollowing) if back[n] and not backward else \
            frame.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        local, carry = fold[n](f"_v_{n}").over(inside), F.col(f"_c_{n}")
        if values[n][1] == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.greatest(local, carry) if values[n][1] == "max" else F.least(local, carry)

    return joined.select(*df.columns, *[combined(n).alias(n) for n in names], *([f"{n}_total" for n in names] if totals else []))


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, name: str = "ord",
             descending: bool = False) -> DataFrame:
    """Row number of each group in ``order``, counted per bucket and offset by earlier buckets."""
    return running(df, keys, order, {name: (F.lit(1).cast("bigint"), "sum")}, bucket, backward=descending)

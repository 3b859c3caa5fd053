"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are cut into equally filled steps, the cell of a row on that grid gets its
index on the Hilbert curve, and the order along the curve is cut into runs of equal row counts.
Neighbours on the curve are neighbours in every dimension, so each shard covers a small box and
filters on any of the columns skip most shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.ordered import ordinals, running
from wayfold.session import cut

BITS = 5
#: Rows of one cell that are ordered in one task.
CELL_ROWS = 50000


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the values of a string column replaced by their rank by rows: how many rows have a
    smaller value. Whole values are compared; null stays null."""
    kinds = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    # Ranges of the sorted values are summed apart, so no task sees them all.
    parted = cut(kinds.repartitionByRange(name).select(F.col(name).alias("_value"), "_n", F.lit(1).alias("_one"), F.spark_partition_id().alias("_range")))
    summed = running(parted, ["_one"], ["_value"], {"_rank": (F.col("_n"), "sum")}, F.col("_range"), exclusive=True)
    return rows.join(summed.select("_value", "_rank"), F.col(name) == F.col("_value"), "left").drop("_value").withColumn(name, F.col("_rank")).drop("_rank")


def index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Hilbert index of a cell with coordinates in [0, 2^bits): neighbouring indexes are
    neighbouring cells. Computed by undoing the curve's reflections bit by bit."""
    n = len(cells)
    state = F.array(*[c.cast("bigint") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x, step):
        q, i = step["q"], step["i"]
        first, here, low = x[0], x[i], q - 1
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        ahead = here.bitwiseAND(q) != 0
        head = F.when(ahead, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, head).when((k == i) & ~ahead, v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, state, undo)
    # Gray code across the coordinates, then the bits interleaved from the top.
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(x[i - 1])).otherwise(v))) if n > 1 else turned
    flips = F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def parity(x):
        return F.aggregate(flips, F.lit(0).cast("bigint"), lambda t, q: F.when(x[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    done = F.transform(F.array(gray), lambda x: F.struct(x.alias("x"), parity(x).alias("t")))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.transform(done, lambda d: F.aggregate(places, F.lit(0).cast("bigint"), lambda h, p: h * 2 + F.expr("1L").bitwiseAND(
        F.call_function("shiftright", d["x"][p["i"]].bitwiseXOR(d["t"]), p["b"]))))[0]


def curve(rows: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """``rows`` with _h, the index of each row's cell. ``dims`` are number columns; a null lies
    below every value. The borders of the cells are approximate quantiles."""
    steps = 1 << bits
    marks = [i / steps for i in range(1, steps)]
    cuts = rows.agg(*[F.percentile_approx(d, marks, 100000).alias(d) for d in dims]).head()

    def cell(d):
        borders = sorted(set(cuts[d] or []))
        return F.when(F.col(d).isNull(), 0).otherwise(sum([(F.col(d) > b).cast("int") for b in borders], F.lit(0)))

    # The cells become columns first, so that the index expression names each of them once.
    placed = rows.select("*", *[cell(d).alias(f"_c{i}") for i, d in enumerate(dims)])
    return placed.select(*rows.columns, index([F.col(f"_c{i}") for i in range(len(dims))], bits).alias("_h"))


def shard(docs: DataFrame, dims: dict[str, Column], shards: int = 24, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``keep`` columns, size (UTF-8 bytes of the text plus
    8), text_crc32 (null for a null text), shard, slot (from 0 in each shard) and _h. Dimensions are
    numbers or strings; whole strings are ranked.

    Shards are runs of the curve whose row counts differ by one at most. Rows of one cell are
    ordered by a hash of the id, the id and the text's checksum. With fewer rows than shards some
    shards stay empty."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")
    names = [f"_d{i}" for i in range(len(dims))]
    narrow = cut(docs.select(F.col(doc_id).alias("doc_id"), *[F.col(k) for k in keep], size.alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
                             *[c.alias(n) for n, c in zip(names, dims.values())]))
    for name in [f.name for f in narrow.schema if f.name in names and f.dataType.simpleString() == "string"]:
        narrow = cut(ranked(narrow, name))
    total = narrow.count()
    placed = cut(curve(narrow, names).drop(*names))
    # At most 2^(bits * dims) cells, whatever the number of rows.
    cells = placed.groupBy("_h").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(cells.select("_h", before.alias("_before"), F.ceil(F.col("_n") / CELL_ROWS).alias("_parts")))
    ready = placed.join(offsets, "_h").withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("_parts")))
    numbered = ordinals(ready, ["_h"], ["_part", "doc_id", "text_crc32"], F.col("_part"), "_rank")
    place = F.col("_before") + F.col("_rank") - 1
    at = F.floor(place * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    return (numbered.withColumn("_place", place.cast("bigint")).withColumn("shard", at)
            .withColumn("slot", F.expr(f"_place - (shard * {total}L + {shards - 1}) div {shards}").cast("bigint"))
            .select("doc_id", *keep, "size", "text_crc32", "shard", "slot", "_h"))

"""Encoded polylines (precision 5) as jobs over columns of strings and of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import ordered

# Fixed values of the format: printable offset, continuation bit, bits per chunk and the scale.
OFFSET, MORE, BITS, SCALE = 63, 0x20, 5, 1e5
# Fixed pattern: characters with the continuation bit, then one without.
CHUNK = r"[\x5f-\x7f]*[\x3f-\x5e]"


def decode(df: DataFrame, column: str = "encoded", keys=("athlete_id", "activity_id")) -> DataFrame:
    """Points (keys..., seq from 0, lat, lon); a truncated tail is ignored.

    A pattern cuts the string into chunks that become signed deltas inside the row; the running
    position over deltas is summed in blocks of the line."""
    keys = list(keys)
    def value(chunk):
        total = F.aggregate(F.filter(F.split(chunk, ""), lambda c: c != ""), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("unit")),
                            lambda acc, c: F.struct((acc["v"] + (F.ascii(c) - OFFSET).bitwiseAND(MORE - 1) * acc["unit"]).alias("v"), (acc["unit"] * MORE).alias("unit")),
                            lambda acc: acc["v"])
        return F.when(total % 2 == 1, -((total + 1) / 2).cast("bigint")).otherwise((total / 2).cast("bigint"))

    deltas = F.transform(F.regexp_extract_all(F.col(column), F.lit(CHUNK), F.lit(0)), value)
    rows = df.filter(F.col(column).isNotNull()).select(*keys, deltas.alias("deltas"))
    both = F.arrays_zip(F.filter("deltas", lambda d, i: i % 2 == 0).alias("dlat"), F.filter("deltas", lambda d, i: i % 2 == 1).alias("dlon"))
    pairs = rows.select(*keys, both.alias("b")).select(*keys, F.posexplode("b").alias("seq", "p")).select(*keys, "seq", "p.dlat", "p.dlon").filter("dlon is not null")
    summed = ordered.running(pairs, keys, ["seq"], {"ilat": (F.col("dlat"), "sum"), "ilon": (F.col("dlon"), "sum")}, F.floor(F.col("seq") / ordered.BLOCK))
    return summed.select(*keys, "seq", (F.col("ilat") / SCALE).alias("lat"), (F.col("ilon") / SCALE).alias("lon"))


def _text(delta):
    """Characters of one signed delta: zig-zag, then five-bit groups, lowest first."""
    zigzag = F.when(delta < 0, -2 * delta - 1).otherwise(2 * delta)
    groups = F.when(zigzag == 0, F.lit(1)).otherwise(F.ceil(F.length(F.bin(zigzag)) / BITS)).cast("int")

    def char(g):
        chunk = F.floor(zigzag / F.pow(F.lit(2.0), g * BITS)).cast("bigint").bitwiseAND(MORE - 1)
        return F.char(chunk + OFFSET + F.when(g < groups - 1, F.lit(MORE)).otherwise(F.lit(0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), char), "")


def encode(points: DataFrame, keys=("athlete_id", "activity_id")) -> DataFrame:
    """One encoded string per line; ``seq`` is dense. Blocks are joined first, then lines."""
    keys = list(keys)
    scaled = points.select(*keys, "seq", F.rint(F.col("lat") * SCALE).cast("bigint").alias("ilat"), F.rint(F.col("lon") * SCALE).cast("bigint").alias("ilon"))
    before = ordered.neighbours(scaled, keys, {"plat": ("ilat", -1), "plon": ("ilon", -1)})
    text = F.concat(_text(F.col("ilat") - F.coalesce("plat", F.lit(0))), _text(F.col("ilon") - F.coalesce("plon", F.lit(0))))

    def joined(column):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda s: s[column]), "")

    blocks = (before.select(*keys, F.floor(F.col("seq") / ordered.BLOCK).alias("blk"), F.col("seq").alias("o"), text.alias("t"))
              .groupBy(*keys, "blk").agg(joined("t").alias("part")))
    return blocks.withColumn("o", F.col("blk")).groupBy(*keys).agg(joined("part").alias("encoded"))

"""Decoded device messages folded into one activity per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import activity as fa

# Message numbers, and (field, invalid value, unit) of what is read from sessions.
RECORD, FILE_ID, SPORT, LAP, SESSION = 20, 0, 12, 19, 18
SESSION_FIELDS = {"distance": (9, 0xFFFFFFFF, 100.0), "elapsed": (7, 0xFFFFFFFF, 1000.0), "timer": (8, 0xFFFFFFFF, 1000.0),
                  "ascent": (22, 0xFFFF, 1.0), "descent": (23, 0xFFFF, 1.0), "power": (20, 0xFFFF, 1.0)}
FIRST_FIELDS = {"sport_code": (SESSION, 5, 0xFF), "start": (SESSION, 2, 0xFFFFFFFF), "manufacturer": (FILE_ID, 1, 0xFFFF)}
EPOCH_S = 631_065_600


def fold(messages: DataFrame) -> DataFrame:
    """Messages (file, seq, global, field, value) to one activity row per file.

    Session values pivot per message and then add up per file; both steps aggregate partially."""
    value = F.col("value")

    def field(number, invalid):
        return F.max(F.when((F.col("field") == number) & (value != invalid), value))

    per_session = (messages.filter(F.col("global") == SESSION).groupBy("file", "seq")
                   .agg(*[(field(n, bad) / unit).alias(name) for name, (n, bad, unit) in SESSION_FIELDS.items()]))
    powered = (F.col("power") > 0) & (F.col("timer") > 0)
    totals = per_session.groupBy("file").agg(
        F.sum("distance").alias("distance_m"), F.sum("elapsed").alias("elapsed_s"), F.sum("timer").alias("moving_s"), F.sum("ascent").alias("ascent_m"), F.sum("descent").alias("descent_m"),
        (F.sum(F.when(powered, F.col("power") * F.col("timer"))) / F.sum(F.when(powered, F.col("timer")))).alias("avg_power_w"))

    def first(which):
        return F.min_by("value", F.when(which, F.col("seq")))

    named = [first((F.col("global") == g) & (F.col("field") == n) & (value != bad)).alias(name) for name, (g, n, bad) in FIRST_FIELDS.items()]
    sub = first(((F.col("global") == SPORT) & (F.col("field") == 1) | (F.col("global") == SESSION) & (F.col("field") == 6)) & (value != 0xFF)).alias("sub_sport")
    header = messages.groupBy("file").agg(*named, sub)
    out = header.join(totals, "file", "left")
    return out.select("file", fa.sport_from_code("sport_code").alias("sport"), F.timestamp_seconds(F.col("start") + EPOCH_S).alias("start_ts"), "distance_m", "elapsed_s", "moving_s",
                      "ascent_m", "descent_m", "avg_power_w", fa.is_virtual(sub_sport="sub_sport", manufacturer="manufacturer").alias("is_virtual"),
                      F.coalesce(F.col("manufacturer") == 260, F.lit(False)).alias("is_zwift"))


def positions(messages: DataFrame) -> DataFrame:
    """Track points (file, seq, lat, lon) of each file: records, else lap ends, else session start.

    Lap positions within a metre of the one before are dropped; a file has few laps, so these are
    compared with their predecessor only."""
    from wayfold.operators import ordered, tracks
    value = F.col("value")

    def pair(lat, lon):
        return F.struct(F.max(F.when(F.col("field") == lat, value)).alias("lat_semi"), F.max(F.when(F.col("field") == lon, value)).alias("lon_semi"))

    rows = (messages.groupBy("file", "seq", "global").agg(pair(0, 1).alias("record"), pair(3, 4).alias("start"), pair(5, 6).alias("end")))
    kinds = F.when(F.col("global") == RECORD, F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("part"), F.col("record").alias("p")))) \
        .when(F.col("global") == LAP, F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).alias("part"), F.col("start").alias("p")), F.struct(F.lit(1).alias("rank"), F.lit(1).alias("part"), F.col("end").alias("p")))) \
        .when(F.col("global") == SESSION, F.array(F.struct(F.lit(2).alias("rank"), F.lit(0).alias("part"), F.col("start").alias("p"))))
    flat = rows.select("file", "seq", F.explode(kinds).alias("k")).select("file", "seq", "k.rank", "k.part", "k.p.lat_semi", "k.p.lon_semi")
    valid = tracks.semicircle_positions(flat)
    best = valid.groupBy("file").agg(F.min("rank").alias("rank"))
    chosen = valid.join(best, ["file", "rank"]).withColumn("_o", F.col("seq") * 2 + F.col("part")).drop("seq", "part", "lat_semi", "lon_semi")
    numbered = ordered.ordinals(chosen, ["file"], ["_o"], F.floor(F.col("_o") / ordered.BLOCK), "seq")
    near = ordered.neighbours(numbered, ["file"], {"plat": ("lat", -1), "plon": ("lon", -1)})
    from wayfold.functions import geo
    apart = F.col("plat").isNull() | (geo.distance_m("plat", "plon", "lat", "lon") > 1)
    return tracks.reindex(near.filter((F.col("rank") == 0) | apart).select("file", "seq", "lat", "lon"), ["file"])

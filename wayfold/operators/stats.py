"""Totals, Eddington numbers and activity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import ordered


def sport_totals(activities: DataFrame, year: int | None = None, tz: str = "UTC") -> DataFrame:
    """Count, metres and seconds per athlete and sport, with the total (null sport)."""
    rows = activities if year is None else activities.filter(F.year(fa.local_time("start_ts", tz)) == year)
    seconds = F.coalesce("moving_s", "elapsed_s", F.lit(0.0))
    out = (rows.groupingSets([["athlete_id", "sport"], ["athlete_id"]], "athlete_id", "sport")
           .agg(F.count(F.lit(1)).alias("activities"), F.sum("distance_m").alias("metres"), F.sum(seconds).alias("seconds"),
                F.grouping("sport").cast("int").alias("is_total")))
    return out


def top_sports(totals: DataFrame) -> DataFrame:
    """Totals ranked by distance per athlete (at most one row per sport)."""
    w = Window.partitionBy("athlete_id").orderBy(F.desc("metres"), "sport")
    return totals.filter("is_total = 0").withColumn("rank", F.row_number().over(w))


def totals(activities: DataFrame) -> DataFrame:
    return activities.groupBy("athlete_id").agg((F.sum("distance_m") / 1000).alias("km"), F.count(F.lit(1)).alias("activities"),
                                                F.count_if(F.col("quality") == 0).alias("without_gps"))


def eddington(activities: DataFrame, sports: list[str], tz: str = "UTC", keys=("athlete_id",)) -> DataFrame:
    """Eddington number, days toward the next one and days still needed.

    Days collapse to a histogram of whole kilometres before anything is ordered, so the only window
    runs over distinct day distances: the number is the largest min(km, days with at least km)."""
    keys = list(keys)
    daily = (activities.filter(F.col("sport").isin(sports) & F.col("start_ts").isNotNull())
             .groupBy(*keys, fa.local_day("start_ts", tz).alias("day")).agg(F.floor(F.sum(F.col("distance_m") / 1000)).alias("km")))
    histogram = daily.groupBy(*keys, "km").agg(F.count(F.lit(1)).alias("days"))
    further = Window.partitionBy(*keys).orderBy(F.desc("km"))
    reach = histogram.withColumn("at_least", F.sum("days").over(further))
    best = reach.groupBy(*keys).agg(F.max(F.least("km", "at_least")).alias("number"),
                                    F.collect_list(F.struct("km", "at_least")).alias("steps"))
    beyond = F.filter("steps", lambda s: s["km"] >= F.col("number") + 1)
    toward = F.coalesce(F.array_max(F.transform(beyond, lambda s: s["at_least"])), F.lit(0))
    return best.select(*keys, "number", toward.alias("toward"), (F.col("number") + 1 - toward).alias("needed"))


def months(activities: DataFrame, tz: str = "UTC") -> DataFrame:
    """Activities newest first with their month; undated ones (null month) come last."""
    month = F.date_trunc("month", fa.local_time("start_ts", tz)).cast("date")
    dated = activities.withColumn("month", month)
    bucket = F.coalesce(F.unix_date(F.to_date("start_ts")), F.lit(-(10 ** 6)))
    return ordered.ordinals(dated, ["athlete_id"], [F.desc_nulls_last("start_ts"), "activity_id"], bucket, "pos", descending=True)

"""Badge rules: how often each athlete earned each badge.

Single-activity rules are one conditional aggregate per athlete. Day rules start from one row per
active day; patterns over days are bit masks built by a grouped ``bit_or``, so no rule orders an
athlete's activities in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import graph, ordered

# Distances in metres, climbing in metres and seconds of the badge rules.
HUNDRED_M, CENTURY_M = 100_000, 160_934
MARATHON_M, DISTANCE_TOLERANCE = 42_195.0, 0.99
PRETZEL_M, PRETZEL_ASCENT, PRETZEL_NAME = 128_000, 2_300, "uber pretzel"
EVEREST_M, EDDY_DESCENT_M, FESTIVE_M = 8_848, 1_000, 500_000
DAY_S, COUNTRIES, ZWIFT_RIDES = 86_400, 50, 100
SNOW_SPORTS = ["Skiing", "Snowboarding"]

KEY = ["athlete_id"]


def _single_rules() -> dict[str, Column]:
    cycling, running = F.col("sport") == "Cycling", F.col("sport") == "Running"
    metres, ascent = F.col("distance_m"), F.col("ascent_m")
    return {
        "100": cycling & (metres >= HUNDRED_M),
        "century": cycling & (metres >= CENTURY_M),
        "hollander": cycling & (metres >= HUNDRED_M) & (ascent < 100),
        "marathon": running & (metres >= MARATHON_M * DISTANCE_TOLERANCE),
        "half-marathon": running & (metres >= MARATHON_M / 2 * DISTANCE_TOLERANCE),
        "nosleep": F.col("elapsed_s") > DAY_S,
        "pretzel": fa.folded_contains("name", PRETZEL_NAME) & (metres >= PRETZEL_M) & (ascent >= PRETZEL_ASCENT),
        "taylor": F.col("is_zwift"),
    }


def single(activities: DataFrame, badges: list[str] | None = None, keys=KEY) -> DataFrame:
    rules = {b: c for b, c in _single_rules().items() if badges is None or b in badges}
    counted = activities.filter("start_ts is not null").groupBy(*keys).agg(*[F.count_if(c).alias(b) for b, c in rules.items()])
    entries = F.array(*[F.struct(F.lit(b).alias("badge"), (F.floor(F.col(f"`{b}`") / ZWIFT_RIDES) if b == "taylor" else F.col(f"`{b}`")).alias("n"))
                        for b in rules])
    return counted.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.badge", "e.n").filter("n > 0")


def globetrotter(activity_countries: DataFrame, keys=KEY) -> DataFrame:
    return (activity_countries.groupBy(*keys).agg(F.count_distinct("country").alias("c")).filter(F.col("c") >= COUNTRIES)
            .select(*keys, F.lit("globetrotter").alias("badge"), F.lit(1).cast("bigint").alias("n")))


def day_facts(activities: DataFrame, tz: str = "UTC", keys=KEY) -> DataFrame:
    """One row per athlete and active local day."""
    start = F.unix_micros("start_ts")
    return (activities.filter("start_ts is not null").groupBy(*keys, fa.local_day("start_ts", tz).alias("day"))
            .agg(F.sum("distance_m").alias("metres"),
                 F.sum(F.when(F.col("sport").isin(SNOW_SPORTS), F.coalesce("descent_m", F.lit(0.0)))).alias("snow_descent"),
                 F.min(F.when(F.col("sport") == "Swimming", start)).alias("first_swim"),
                 F.max(F.when(F.col("sport") == "Running", start)).alias("last_run")))


def _counted(rows: DataFrame, badge: str, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit(badge).alias("badge"), "n")


def triple_jump(days: DataFrame, keys=KEY) -> DataFrame:
    """Active, rest, active, two rests, active: bits 0, 2 and 5 of the six days from a day."""
    marks = days.select(*keys, "day", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("o"))
    masks = marks.groupBy(*keys, F.date_sub("day", F.col("o")).alias("anchor")).agg(F.bit_or(F.expr("shiftleft(1, o)")).alias("m"))
    return _counted(masks.filter(F.col("m") == 0b100101), "triple-jump", keys)


def triathlete(days: DataFrame, activities: DataFrame, tz: str = "UTC", keys=KEY) -> DataFrame:
    """Days with a ride after a swim and before a run."""
    frame = days.filter("first_swim < last_run").select(*keys, "day", "first_swim", "last_run")
    rides = activities.filter(F.col("sport") == "Cycling").select(*keys, fa.local_day("start_ts", tz).alias("day"), F.unix_micros("start_ts").alias("ride"))
    between = rides.join(frame, [*keys, "day"]).filter("ride > first_swim and ride < last_run")
    return _counted(between.select(*keys, "day").distinct(), "triathlete", keys)


def eddy(days: DataFrame, keys=KEY) -> DataFrame:
    return _counted(days.filter(F.col("snow_descent") > EDDY_DESCENT_M), "eddy-the-eagle", keys)


def date_years(days: DataFrame, badge: str, month: int, day: int, keys=KEY) -> DataFrame:
    """Years with activity on a given date."""
    return _counted(days.filter((F.month("day") == month) & (F.dayofmonth("day") == day)).select(*keys, F.year("day").alias("y")).distinct(), badge, keys)


def festive(days: DataFrame, keys=KEY) -> DataFrame:
    late = days.filter((F.month("day") == 12) & (F.dayofmonth("day") >= 24))
    return _counted(late.groupBy(*keys, F.year("day").alias("y")).agg(F.sum("metres").alias("m")).filter(F.col("m") >= FESTIVE_M), "festive-500", keys)


def week_masks(days: DataFrame, keys=KEY) -> DataFrame:
    """Per Monday: bits 0-6 for the week's active days, 7 and 8 for the weekend before it."""
    monday = F.trunc("day", "week")
    weekday = F.datediff("day", monday)
    own = F.struct(monday.alias("monday"), weekday.alias("bit"))
    after = F.struct(F.date_add(monday, 7).alias("monday"), (weekday + 2).alias("bit"))
    marks = days.select(*keys, F.explode(F.when(weekday >= 5, F.array(own, after)).otherwise(F.array(own))).alias("k"))
    return marks.groupBy(*keys, F.col("k.monday").alias("monday")).agg(F.bit_or(F.expr("shiftleft(1, k.bit)")).alias("m"))


def hustling(days: DataFrame, keys=KEY) -> DataFrame:
    return _counted(week_masks(days, keys).filter("m & 127 = 127"), "every-day-im-hustling", keys)


def nine_to_five(days: DataFrame, keys=KEY) -> DataFrame:
    return _counted(week_masks(days, keys).filter("m & 511 = 31"), "working-9-to-5", keys)


def everester(activities: DataFrame, keys=KEY) -> DataFrame:
    """Disjoint 24-hour stretches with more than 8,848 m of cycling ascent, earliest first.

    Sums look ahead over day blocks. Taking stretches greedily follows each candidate to the first
    one a day later; chains restart wherever no candidate lies within the day before, so counting
    the chains by pointer doubling gives the greedy result."""
    keys, day_us = list(keys), DAY_S * 1_000_000
    rides = (activities.filter((F.col("sport") == "Cycling") & F.col("start_ts").isNotNull())
             .groupBy(*keys, F.unix_micros("start_ts").alias("t")).agg(F.sum(F.coalesce("ascent_m", F.lit(0.0))).alias("up")))
    day = F.floor(F.col("t") / day_us)
    spread = rides.withColumn("d", F.explode(F.array(day, day - 1)))
    window = Window.partitionBy(*keys, "d").orderBy("t").rangeBetween(0, day_us - 1)
    found = (spread.withColumn("ahead", F.sum("up").over(window)).filter((F.col("d") == day) & (F.col("ahead") > EVEREST_M)).select(*keys, "t"))
    marked = ordered.running(found, keys, ["t"], {"prev": (F.col("t"), "max")}, day, exclusive=True)
    marked = marked.withColumn("head", F.col("prev").isNull() | (F.col("t") - F.col("prev") >= day_us))
    moves = marked.select(*keys, "t", "head", F.explode(F.array(F.struct(F.col("t").alias("pos"), F.lit(1).alias("kind")),
                                                                F.struct((F.col("t") + day_us).alias("pos"), F.lit(0).alias("kind")))).alias("m"))
    moves = moves.select(*keys, "t", "head", "m.pos", "m.kind")
    looked = ordered.running(moves, keys, [F.desc("pos"), F.desc("kind")],
                             {"hit": (F.when(F.col("kind") == 1, F.struct("t", "head")), "min")}, F.floor(F.col("pos") / day_us), backward=True)
    links = looked.filter("kind = 0").select(*keys, F.col("t").alias("node"), "head", F.when(~F.col("hit.head"), F.col("hit.t")).alias("next"))
    lengths = graph.count_to_end(links, keys)
    heads = links.filter("head").select(*keys, "node")
    return (lengths.join(heads, [*keys, "node"], "left_semi").groupBy(*keys).agg(F.sum("steps").alias("n"))
            .select(*keys, F.lit("everester").alias("badge"), "n"))


def all_badges(activities: DataFrame, activity_countries: DataFrame | None = None, tz: str = "UTC", keys=KEY) -> DataFrame:
    """(keys..., badge, n) for every badge earned."""
    days = day_facts(activities, tz, keys)
    parts = [single(activities, keys=keys), everester(activities, keys), triple_jump(days, keys), triathlete(days, activities, tz, keys),
             eddy(days, keys), date_years(days, "silent-night", 12, 24, keys), date_years(days, "giant-leap", 2, 29, keys), festive(days, keys),
             hustling(days, keys), nine_to_five(days, keys)]
    if activity_countries is not None:
        parts.append(globetrotter(activity_countries, keys))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

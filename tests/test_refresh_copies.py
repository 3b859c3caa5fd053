"""Climbs with equal checkpoints are stored once in the library and count as many."""

from pyspark.sql import functions as F

from wayfold.plans import refresh


def test_equal_climbs_in_the_library(spark):
    up = [(50 + i * 0.0009, 6.0) for i in range(21)]
    acts = spark.createDataFrame([(1, k, "Cycling", 21, 1000.0 * k) for k in (10, 11)], "athlete_id long, activity_id long, sport string, n_points long, distance_m double")
    none = [F.lit(None).cast("double").alias(c) for c in ("moving_s", "ascent_m", "descent_m", "avg_power_w")]
    acts = acts.select("*", F.timestamp_seconds(F.col("activity_id") * 86400).alias("start_ts"), F.lit(60.0).alias("elapsed_s"), *none, F.lit(1).alias("quality"), F.lit(False).alias("is_virtual"), F.lit(False).alias("is_zwift"),
                       F.lit("ride").alias("name"), F.lit("feed").alias("source"), F.col("activity_id").cast("string").alias("file_name"))
    points = spark.createDataFrame([(1, k, i, a, o) for k in (10, 11) for i, (a, o) in enumerate(up)], "athlete_id long, activity_id long, seq int, lat double, lon double")
    marks = spark.createDataFrame([(c, i, a + far, o) for c, far in (("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 9.0)) for i, (a, o) in enumerate(up)], "climb_id string, idx long, lat double, lon double")
    ring = spark.createDataFrame([("A:1", "a", 0, 0, 0, i, a, o) for i, (a, o) in enumerate([(49.9, 5.9), (49.9, 6.1), (50.1, 6.1), (50.1, 5.9)])], "code string, name string, ordinal int, poly int, ring int, seq int, lat double, lon double")
    names = spark.createDataFrame([], "file_name string, new_name string")
    library = refresh.refresh(acts, points, names, ring, marks)
    assert [(r.climb_id, r.times, r.copies) for r in library.climbs.collect()] == [("a", 2, 3)]
    assert {(r.climb_id, r.times) for r in refresh.climbs_of(library).collect()} == {("a", 2), ("b", 2), ("c", 2)}
    assert [(r.activities, r.climbs, r.areas) for r in refresh.summary(library).collect()] == [(2, 3, 1)]

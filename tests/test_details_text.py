"""The line of details under an activity."""

from wayfold.functions import activity as fa


def test_speed_is_rounded_as_the_decimal_it_stands_for(spark):
    k = 112216  # 22.85 km/h, stored as 22.849999999999998
    row = spark.createDataFrame([(None, float(600 + k * 6151 % 30000), k * 104729 % 1800000 / 10, None, float((600 + k * 6151 % 30000) * 0.9))],
                                "none double, elapsed_s double, distance_m double, avg_power_w double, moving_s double")
    assert row.select(fa.details_text()).first()[0] == "18:14 · 6.9 km · 22.9 km/h"

"""Daily health metrics from JSON columns of varying shape, over a declared list of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import _c

# Containers in which the fields occur, outer ones first.
CONTAINERS = ["$", "$[0]", "$.values[0]", "$[0].values", "$.dailySleepDTO", "$.wellness", "$.allMetrics"]
REPORTS = ("array<struct<bodyBatteryValuesArray:array<array<string>>,bodyBatteryMostRecentValue:string,"
           "bodyBatteryValueDescriptorDTOList:array<struct<bodyBatteryValueDescriptorIndex:int,bodyBatteryValueDescriptorKey:string>>>>")


def _first(json: Column, *fields: str) -> Column:
    return F.coalesce(*[F.try_variant_get(json, f"{c}.{f}", "double") for f in fields for c in CONTAINERS]).cast("bigint")


def steps(text) -> Column:
    """STRUCT<count, goal>, null without a step count."""
    json = F.try_parse_json(_c(text))
    count = _first(json, "totalSteps")
    return F.when(count.isNotNull(), F.struct(count.alias("count"), _first(json, "stepGoal", "dailyStepGoal").alias("goal")))


def sleep(text) -> Column:
    """STRUCT<seconds, score>, null without sleep."""
    json = F.try_parse_json(_c(text))
    seconds = _first(json, "sleepTimeSeconds")
    score = _first(json, "sleepScores.overall.value", "overallSleepScore.value", "overallSleepScore", "sleepScore")
    return F.when(seconds > 0, F.struct(seconds.alias("seconds"), score.alias("score")))


def body_battery(text) -> Column:
    """STRUCT<level, time_ms>: the last measured value, by the report's own column descriptors."""
    reports = F.reverse(F.from_json(_c(text), REPORTS))

    def column(report, key):
        named = F.filter(report["bodyBatteryValueDescriptorDTOList"], lambda d: d["bodyBatteryValueDescriptorKey"] == key)
        return F.get(named, F.lit(0))["bodyBatteryValueDescriptorIndex"]

    def reading(report):
        def level(row):
            at = F.coalesce(column(report, "bodyBatteryLevel"), F.when(F.size(row) >= 3, 2).otherwise(1))
            return F.get(row, at).try_cast("double").cast("bigint")

        def time(row):
            return F.get(row, F.coalesce(column(report, "timestamp"), F.lit(0))).try_cast("double").cast("bigint")

        rows = F.transform(F.reverse(report["bodyBatteryValuesArray"]), lambda row: F.struct(level(row).alias("level"), time(row).alias("time_ms")))
        last = F.get(F.filter(rows, lambda r: r["level"].isNotNull()), F.lit(0))
        recent = report["bodyBatteryMostRecentValue"].try_cast("double").cast("bigint")
        return F.coalesce(last, F.when(recent.isNotNull(), F.struct(recent.alias("level"), F.lit(None).cast("bigint").alias("time_ms"))))

    return F.get(F.filter(F.transform(reports, reading), lambda r: r.isNotNull()), F.lit(0))

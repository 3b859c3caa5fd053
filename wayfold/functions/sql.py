"""The reusable scalar functions as SQL functions; Catalyst inlines their expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "wf_tile_x(lon DOUBLE)": ("INT", "cast(greatest(0, least(16383, floor((lon + 180) / 360 * 16384))) as int)"),
    "wf_tile_y(lat DOUBLE)": ("INT", "cast(greatest(0, least(16383, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384))) as int)"),
    "wf_tile_key(x INT, y INT)": ("BIGINT", "shiftleft(cast(x as bigint), 32) | cast(y as bigint)"),
    "wf_tile_lat(y DOUBLE)": ("DOUBLE", "degrees(atan(sinh(pi() * (1 - 2 * y / 16384))))"),
    "wf_tile_lon(x DOUBLE)": ("DOUBLE", "x / 16384 * 360 - 180"),
    "wf_distance_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": (
        "DOUBLE", "hypot((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) * 111320D, (lat2 - lat1) * 110574D)"),
    "wf_category(sport STRING)": (
        "STRING", "case when sport in ('Cycling', 'E-biking') then 'bike' when sport = 'Running' then 'run' when sport in ('Walking', 'Hiking') then 'foot' else 'other' end"),
    "wf_duration(moving DOUBLE, elapsed DOUBLE)": ("DOUBLE", "case when moving > 0 then moving else elapsed end"),
    "wf_climb_category(length DOUBLE, avg DOUBLE)": (
        "STRING", "case when avg < 3 then null when length * avg >= 80000 then 'HC' when length * avg >= 64000 then '1' when length * avg >= 32000 then '2' "
                  "when length * avg >= 16000 then '3' when length * avg >= 8000 then '4' when length >= 300 and avg >= 5 then 'hill' end"),
    "wf_cell_1deg(lat DOUBLE, lon DOUBLE)": (
        "STRING", "concat(if(floor(lat) >= 0, 'n', 's'), lpad(cast(abs(floor(lat)) as string), 2, '0'), if(floor(lon) >= 0, 'e', 'w'), lpad(cast(abs(floor(lon)) as string), 3, '0'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions and returns their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature in FUNCTIONS]

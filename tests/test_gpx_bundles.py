"""GPX documents bundled in files are read back whole, each under its own name."""

import os

from pyspark.sql import functions as F

from wayfold.sinks import writers
from wayfold.sources import gpx


def test_many_documents_a_file(spark, tmp_path):
    points = spark.range(600).select((F.col("id") % 200).alias("route_id"), F.floor(F.col("id") / 200).alias("seq"), (F.col("id") / 100).alias("lat"), (F.col("id") / 50).alias("lon"))
    heads = points.select("route_id").distinct().withColumn("name", F.format_string("a </gpx> & %d", "route_id")).withColumn("created_ts", F.lit("2024-01-01").cast("timestamp"))
    path = str(tmp_path / "gpx")
    writers.write_gpx_bundles(writers.gpx_lines(heads, points, points.filter("seq = 0").withColumn("name", F.lit("stop"))), path)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) <= 8
    for limit in ("128m", "10k"):  # whole files, then pieces of them
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            found, stops = gpx.read_gpx(spark, path, bundled=True)
            rows = {(r.name, r.seq, r.lat, r.lon) for r in found.collect()}
            assert rows == {(f"a </gpx> & {i % 200}", i // 200, i / 100, i / 50) for i in range(600)}
            assert found.select("file").distinct().count() == 200
            assert stops.join(found.filter("seq = 0").select("file", "lat"), ["file", "lat"]).count() == 200
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_stand_alone(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<?xml version="1.0"?>\n<gpx><wpt lat="1" lon="2"/></gpx>\n')
    (tmp_path / "b.gpx").write_text('<gpx><rte><name> r </name><rtept lat="3" lon="4"/></rte></gpx>')
    for bundled in (False, True):
        points, _ = gpx.read_gpx(spark, str(tmp_path), bundled)
        assert {(r.name, r.lat, r.lon) for r in points.collect()} == {(None, 1.0, 2.0), ("r", 3.0, 4.0)}

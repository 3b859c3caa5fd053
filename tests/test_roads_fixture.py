"""Road pieces stay on the globe however many there are."""

from pyspark.sql import functions as F

from workload import q_lines


def test_roads_stay_on_the_globe(spark, tmp_path):
    spark.range(0, 4_000_000, 9).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    rows = q_lines.pieces(spark, str(tmp_path))
    low, high = rows.agg(F.min("lat"), F.max("lat")).first()
    assert 50 <= low and high < 75
    # Roads without a name are told apart by their place alone.
    ends = rows.filter("key is null").withColumn("y", F.round("lat", 6)).groupBy("y").agg(F.countDistinct(F.floor(F.col("way_id") / 10)).alias("roads"))
    assert ends.filter("roads > 1").isEmpty()


def test_stitched_roads_beyond_the_first_block(spark, tmp_path):
    spark.range(100080, 100100).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    rows = {(r.road, r.way_id, r.points, r.flat) for r in q_lines.jn_mutual_nearest_ends(spark, str(tmp_path)).collect()}
    assert (10008, 100080, 22, 2) in rows and not [r for r in rows if r[0] == 10008 and r[1] == 100085]

"""What a task holds or looks through doesn't grow faster than its input."""

import hashlib
from datetime import datetime, timedelta

from wayfold.operators import climbs, merge
from wayfold.sinks import writers
from wayfold.sources import collections


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_climb_points_are_exchanged_before_they_are_gathered(spark):
    """A task that makes many climbs of a small file neither sorts nor folds their points."""
    points = spark.createDataFrame([(c, i, 50.0 + i * 0.0003 * c, 5.0) for c in (1, 2) for i in range(5)] + [(3, 0, 50.0, 5.0)], "climb_id long, seq int, lat double, lon double")
    marks = climbs.climb_checkpoints(points)
    plan = _plan(marks)[1]
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    assert plan.rindex("ObjectHashAggregate") < plan.index("Exchange")  # printed from the result down
    assert sorted((r.climb_id, r.idx, round(r.lat, 4)) for r in marks.collect()) == [
        (1, 0, 50.0), (1, 1, 50.0006), (1, 2, 50.0012), (2, 0, 50.0), (2, 1, 50.0006), (2, 2, 50.0012), (2, 3, 50.0018), (2, 4, 50.0024), (3, 0, 50.0)]


def test_gaps_of_a_block_are_not_sought_sample_by_sample(spark):
    """Every one of 289 places looked through all samples with an expression of its own."""
    raster = spark.createDataFrame([(50, 5, r, c, r * 100 + c) for r in range(17) for c in range(17) if (r, c) not in ((0, 0), (3, 4), (16, 16))] + [(50, 5, 1, 1, 7)], "cell_lat long, cell_lon long, row int, col int, elev int")
    blocks = climbs.raster_blocks(raster)
    assert "filter(" not in _plan(blocks)[0]
    elev = {(r.brow, r.bcol): r.elev for r in blocks.collect()}[0, 0]
    assert [i for i, e in enumerate(elev) if e is None] == [0, 3 * 17 + 4, 288] and elev[18] == 7.0 and elev[2 * 17 + 5] == 205.0


def test_grouping_reads_its_input_a_few_times(spark):
    """Equal activities were gathered anew for every kind of link."""
    begin, reads = datetime(2024, 1, 1, 9, 0, 0), spark.sparkContext.accumulator(0)
    starts = [0, 100, 219, 340, 3590, 3601, 3700, 7000, 7199, 7200, 7330]  # 340 and 7330 follow 121 s and more later
    rows = [(1, i, begin + timedelta(seconds=s), 10.0, "Cycling") for i, s in enumerate(starts)]

    def told(row):
        reads.add(1)
        return row

    acts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(told), "athlete_id long, activity_id long, start_ts timestamp, elapsed_s double, sport string")
    got = {r.activity_id: r.group_id for r in merge.duplicate_groups(acts).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 10}
    assert reads.value <= 5 * len(rows)


def test_snapshot_has_one_file_an_athlete(spark, tmp_path):
    """Tiles 200 columns apart lay in several files of every athlete."""
    tiles = spark.createDataFrame([(a, (8400 + 40 * i) * 2 ** 32 + 5400) for a in (1, 2) for i in range(6)], "athlete_id long, tile_key long")
    path = str(tmp_path / "tiles")
    assert writers.snapshot_tiles(tiles, path).count() == 2
    assert [len(list((tmp_path / "tiles" / f"athlete_id={a}").glob("*.parquet"))) for a in (1, 2)] == [1, 1]
    assert sorted(map(tuple, spark.read.parquet(path).select("athlete_id", "tile_key").collect())) == sorted(map(tuple, tiles.collect()))


def test_digest_sorts_packed_pieces(spark, tmp_path):
    """The task that takes a document's SHA-256 sorted all its pieces, each with its place."""
    whole = '{"features":[' + ",".join('{"id":%d,"geometry":{"type":"Point"}}' % i for i in range(6000)) + "]}\n"
    (tmp_path / "a.geojson").write_text(whole)
    (tmp_path / "b.geojson").write_text('{"é":{}} ')
    rows = collections.pieces(spark, str(tmp_path), ".geojson")
    assert {r.file: r.digest for r in collections.digests(rows).collect()} == {f: hashlib.sha256((tmp_path / f).read_bytes()).hexdigest() for f in ("a.geojson", "b.geojson")}
    runs = collections.packed(rows).collect()
    assert rows.count() > 12_000 and len(runs) < 20 and sum(len(r.data) for r in runs) < len(whole) / 3

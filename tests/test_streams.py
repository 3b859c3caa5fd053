"""Streams over several batches: state, replays, corrections, changed files, expiry."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import library, merge
from wayfold.streaming import events as ev
from wayfold.streaming import state


def feed(spark, folder, schema, parts):
    """A stream that takes one part per batch."""
    for i, rows in enumerate(parts):
        if os.path.exists(f"{folder}/{i}"):
            continue
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        os.utime(next(f"{folder}/{i}/{f}" for f in os.listdir(f"{folder}/{i}") if f.startswith("part-")), (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_tombstones_over_batches(spark, tmp_path):
    rng = random.Random(1)
    schema = "name STRING, changed_at BIGINT, writer BIGINT"
    parts = [[(f"f{rng.randint(0, 6)}", rng.choice([1, -1]) * rng.randint(1, 9), 25 * b + i) for i in range(25)] for b in range(4)] + [[(None, 3, 0), ("f1", None, 0), ("g", 5, 1), ("g", -5, 0), ("g", 5, 2)]]
    seen = []
    stream = feed(spark, f"{tmp_path}/in", schema, parts)
    ev.tombstone_stream(stream, f"{tmp_path}/ck", lambda batch, i: seen.append(sorted(r["name"] for r in batch.collect()))).awaitTermination()
    rows = [r for p in parts for r in p if r[0] is not None and r[1] is not None]
    want = {}
    for name, at, writer in rows:
        if name not in want or (abs(at), -writer) > (abs(want[name][0]), -want[name][1]):
            want[name] = (at, writer)
    got = {r["name"]: r["deleted"] for r in ev.tombstones_now(spark, f"{tmp_path}/ck").collect()}
    assert got == {n: at > 0 for n, (at, _) in want.items()} and got["g"] is False
    assert len(seen) >= 5 and seen[-1] == ["g"]  # a batch hands on only what it changed
    batch = library.tombstones(spark.createDataFrame(rows, schema)).collect()
    assert {r["name"]: r["deleted"] for r in batch} == got


def test_names_after_a_restart(spark, tmp_path):
    schema = "athlete_id BIGINT, file_name STRING, new_name STRING, arrival BIGINT"
    ev.names_stream(feed(spark, f"{tmp_path}/in", schema, [[(1, "a", "x", 5), (2, "a", "z", 1)]]), f"{tmp_path}/ck").awaitTermination()
    more = feed(spark, f"{tmp_path}/in", schema, [[(1, "a", "x", 5), (2, "a", "z", 1)], [(1, "a", "old", 4), (1, "b", None, 1), (2, "a", "y", 1)], [(1, "a", "new", 6), (1, "b", "w", 1)]])
    ev.names_stream(more, f"{tmp_path}/ck").awaitTermination()
    assert {(r["athlete_id"], r["file_name"]): r["new_name"] for r in ev.names_now(spark, f"{tmp_path}/ck").collect()} == {(1, "a"): "new", (1, "b"): "w", (2, "a"): "z"}


def test_first_visits_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    schema = "athlete_id BIGINT, tile_key BIGINT, activity_id BIGINT, start_ts TIMESTAMP"
    acts = {a: (rng.randint(0, 3), rng.choice([None, *range(1_700_000_000, 1_700_000_009)])) for a in range(40)}
    rows = [(acts[a][0], rng.randint(0, 12), a, acts[a][1]) for a in acts for _ in range(3)]
    parts = [rows[i::4] for i in range(4)]
    stamped = [[(u, t, a, None) if s is None else (u, t, a, __import__("datetime").datetime.fromtimestamp(s)) for u, t, a, s in p] for p in parts]
    ev.first_visit_stream(feed(spark, f"{tmp_path}/in", schema, stamped), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    want = {}
    for u, t, a, s in rows:
        want[u, t] = min(want.get((u, t), (2 ** 63, 0)), (ev.UNDATED if s is None else s, a))
    got = ev.first_visits(spark, f"{tmp_path}/out").withColumn("s", F.unix_seconds("first_ts")).collect()
    assert {(r["athlete_id"], r["tile_key"]): (ev.UNDATED if r["s"] is None else r["s"], r["activity_id"]) for r in got} == want
    table = ev.visit_table(spark, f"{tmp_path}/out")
    stored = table.read()
    assert stored.filter("correction").count() > 0 and stored.count() < len(rows)
    before = {tuple(r) for r in ev.earliest(table.read()).collect()}
    again = spark.createDataFrame(table.read().filter("batch = 2").drop("bucket", "batch").collect(), ev.VISIT)
    table.put(again, 1)  # a replayed batch replaces its own folder
    assert {tuple(r) for r in ev.earliest(table.read()).collect()} == before


def test_deltas_compact(spark, tmp_path):
    table = state.Deltas(spark, f"{tmp_path}/d", "k BIGINT, v STRING", ["k"], buckets=4)
    assert table.latest().collect() == []
    for i in range(6):
        table.put(spark.createDataFrame([(k, f"{i}") for k in range(i, 8)], "k BIGINT, v STRING"), i)
        if i in (2, 4):
            table.compact(i)
            assert len(table._folders()) == 1
    assert {r["k"]: r["v"] for r in table.latest().collect()} == {k: str(min(k, 5)) for k in range(8)}
    only = table.latest(touched=spark.createDataFrame([(3,)], "k BIGINT")).collect()
    assert 3 in {r["k"] for r in only} and len(only) < 8


def test_changed_files(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(name, values, when):
        (folder / name).write_text("".join(json.dumps({"v": v}) + "\n" if v is not None else "broken\n" for v in values))
        os.utime(folder / name, (when, when))

    def run():
        ev.import_stream(spark, str(folder), "v BIGINT", out, f"{tmp_path}/ck").awaitTermination()
        rows, bad = ev.imported(spark, out, "v BIGINT")
        return sorted(r["v"] for r in rows.collect()), bad.count()

    put("a", [1, 2], 100), put("b", [3, None], 100), put("c", [4], 100), put("e", [], 100), put(".hidden", [99], 100)
    assert run() == ([1, 2, 3, 4], 1)
    put("a", [1, 5], 200), (folder / "c").unlink(), put("d", [6, None, None], 50)  # an old file may arrive late
    assert run() == ([1, 3, 5, 6], 3)
    assert run() == ([1, 3, 5, 6], 3)  # nothing changed
    put("c", [7], 300), put("b", [], 300), put("e", [8], 300)
    assert run() == ([1, 5, 6, 7, 8], 2)


def test_ranges_cover_every_line_once(spark, tmp_path):
    from wayfold.sources.changes import ChangedFilesReader
    folder = tmp_path / "in"
    folder.mkdir()
    text = "".join("x" * (i * 7 % 23) + f"{i}\n" for i in range(200)) + "last"
    (folder / "a.txt").write_text(text)
    for size in (1, 10, 64, 10 ** 6):
        reader = ChangedFilesReader({"path": str(folder), "listings": f"{tmp_path}/l{size}", "range": str(size)})
        rows = [r[3] for task in reader.partitions(reader.initialOffset(), reader.latestOffset()) for r in reader.read(task)]
        assert [r for r in rows if r is not None] == text.split("\n") and rows.count(None) == 1


def test_late_merge_on_random_arrivals(spark, tmp_path):
    rng = random.Random(12)
    schema = "athlete_id BIGINT, activity_id BIGINT, start_ts TIMESTAMP, elapsed_s DOUBLE, sport STRING"
    import datetime
    base = datetime.datetime(2024, 3, 1)
    rows = [(rng.randint(1, 2), i, None if i % 29 == 0 else base + datetime.timedelta(seconds=rng.randint(0, 160_000)), float(rng.choice([0, 600, 7200, 50_000])), rng.choice(["Cycling", "Running", "Swimming"])) for i in range(150)]
    parts = [rows[i::3] for i in range(3)]
    ev.late_merge_stream(feed(spark, f"{tmp_path}/in", schema, parts), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r["activity_id"]: r["group_id"] for r in ev.group_table(spark, f"{tmp_path}/out").latest().collect()}
    want = {r["activity_id"]: r["group_id"] for r in merge.duplicate_groups(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_queue_forgets_old_days(spark, tmp_path):
    day = 86_400
    schema = "athlete_id BIGINT, type STRING, time BIGINT, activity_id BIGINT"
    parts = [[(1, "created", d * day + 5, d) for d in range(19_000, 19_020)], [(1, "created", d * day + 5, d) for d in range(19_010, 19_045)], [(1, "deleted", 19_060 * day, 1), (1, "created", 19_001 * day, 2)]]
    for i in range(3):
        ev.write_queue(feed(spark, f"{tmp_path}/in", schema, parts[:i + 1]), f"{tmp_path}/q", f"{tmp_path}/ck").awaitTermination()
    days = [(d - __import__("datetime").date(1970, 1, 1)).days for d in ev.stored_days(spark, f"{tmp_path}/q")]
    assert min(days) == 19_030 and max(days) == 19_060
    log = ev.read_queue(spark, f"{tmp_path}/q")
    assert sorted(r["time"] for r in log.collect()) == [d * day + 5 for d in range(19_030, 19_045)] + [19_060 * day]
    since = spark.createDataFrame([(1, 19_043 * day)], "athlete_id BIGINT, since BIGINT")
    plan = ev.events_since(log, since)
    assert sorted(r["time"] for r in plan.collect()) == [19_043 * day + 5, 19_044 * day + 5, 19_060 * day]
    assert "2022-02-20" in plan._jdf.queryExecution().toString()  # the least cursor prunes days


@pytest.mark.parametrize("runs", [1, 3])
def test_health_over_batches(spark, tmp_path, runs):
    import datetime
    schema = "athlete_id BIGINT, fetched BIGINT, day DATE, steps BIGINT, sleep_s BIGINT, battery BIGINT"
    rng = random.Random(runs)
    rows = [(rng.randint(1, 3), i, datetime.date(2024, 1, 1 + i // 9), rng.choice([None, i]), rng.choice([None, i]), rng.choice([None, i])) for i in range(60)]
    rng.shuffle(rows)
    ev.health_stream(feed(spark, f"{tmp_path}/in", schema, [rows[i::runs] for i in range(runs)]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, ev.health_now(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, ev.health_latest(spark.createDataFrame(rows, schema)).collect()))


def test_values_per_key_run_without_python(spark, tmp_path):
    schema, low = "name STRING, changed_at BIGINT, writer BIGINT", -2 ** 63
    parts = [[("a", 5, 0), ("b", 7, 0), ("e", low, 0)], [("a", 4, 0), ("b", -7, 0), ("c", -1, 0), ("c", 1, -1)], [("a", -6, 0), ("b", 7, None), ("e", 2 ** 63 - 1, 0)]]
    seen = []
    query = ev.tombstone_stream(feed(spark, f"{tmp_path}/in", schema, parts), f"{tmp_path}/ck", lambda batch, i: seen.append({r["name"]: r["changed_at"] for r in batch.collect()}))
    query.awaitTermination()
    # An equal rank leaves what is there; a batch hands on only what it changed.
    assert [s for s in seen if s] == [{"a": 5, "b": 7, "e": low}, {"c": 1}, {"a": -6}]
    assert {r["name"]: r["changed_at"] for r in ev.tombstones_now(spark, f"{tmp_path}/ck").collect()} == {"a": -6, "b": 7, "c": 1, "e": low}
    plan = query._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "InPandas" not in plan and "Python" not in plan


def test_equal_times_keep_the_first_order(spark, tmp_path):
    from workload import q_io
    # 3k and 3k + 1000003 give the same time, one as restored and one as deleted.
    rows = [(3 * k + late * 1_000_003, k) for k in range(40) for late in (0, 1)]
    spark.createDataFrame(rows, "o_orderkey BIGINT, o_custkey BIGINT").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["name"]: r["deleted"] for r in q_io.st_tombstones(spark, str(tmp_path)).collect()}
    assert got == {f"f{k}": False for k in range(40)}

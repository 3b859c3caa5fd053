"""Webhook events, logs and imports as Structured Streaming jobs and their batch halves."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import merge
from wayfold.session import cut
from wayfold.sources.changes import changed_lines
from wayfold.streaming import state

# Days an event is kept, seconds between refreshes, seconds a health value is fresh.
KEEP_DAYS, REFRESH_S, FRESH_S = 30, 10, 600
#: Stands before every date.
UNDATED = -(2 ** 62)
LOG = "athlete_id BIGINT, type STRING, time BIGINT, activity_id BIGINT, ts TIMESTAMP, day DATE, batch INT"
EVENT = "subscription_id STRING, owner_id STRING, object_id STRING, object_type STRING, aspect_type STRING, event_time STRING, updates STRUCT<authorized: STRING>"


def classify(raw: DataFrame, subscription: str | None = None) -> DataFrame:
    """Raw events (JSON ``value``) to (athlete_id, type, time, activity_id); others are dropped."""
    e = F.from_json("value", EVENT)
    rows = raw.select(e.alias("e")).select("e.*")
    if subscription is not None:
        rows = rows.filter(F.col("subscription_id") == subscription)
    whole = {n: F.when(F.col(c).rlike(r"^-?\d{1,15}$"), F.col(c).try_cast("bigint")) for n, c in (("athlete_id", "owner_id"), ("time", "event_time"), ("object", "object_id"))}
    kind = (F.when((F.col("object_type") == "athlete") & (F.col("updates.authorized") == "false"), "deauthorized")
            .when((F.col("object_type") == "activity") & (F.col("aspect_type") == "delete"), "deleted").when((F.col("object_type") == "activity") & (F.col("aspect_type") == "create"), "created"))
    return (rows.select(whole["athlete_id"].alias("athlete_id"), kind.alias("type"), whole["time"].alias("time"), F.when(F.col("object_type") == "activity", whole["object"]).alias("activity_id"), whole["object"].alias("_o"))
            .filter("type is not null and athlete_id is not null and time is not null and _o is not null").drop("_o"))


def queue(events: DataFrame) -> DataFrame:
    """The event log: repeated deliveries within the 30 days kept are dropped, days are partitions."""
    timed = events.withColumn("ts", F.timestamp_seconds("time")).withColumn("day", F.to_date(F.timestamp_seconds("time")))
    keys = ["athlete_id", "type", "time", "activity_id"]
    if events.isStreaming:
        return timed.withWatermark("ts", f"{KEEP_DAYS} days").dropDuplicatesWithinWatermark(keys)
    return timed.dropDuplicates(keys)


def write_queue(events: DataFrame, path: str, checkpoint: str):
    """Stores the event log as day=.../batch=... folders. A replayed batch replaces its own folders;
    days that ended before the 30 days up to the newest day stored leave as whole folders."""
    spark = events.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id)).repartition("day")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        expire(spark, path)

    return queue(events).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days that have a folder."""
    return sorted(date.fromisoformat(n.split("=")[1]) for n in state.names_in(spark, path) if n.startswith("day=") and n != "day=__HIVE_DEFAULT_PARTITION__")


def expire(spark: SparkSession, path: str) -> None:
    """Removes the folders of days that are wholly older than 30 days before the newest day. The
    watermark is at most that old, so no event that a batch still accepts falls on such a day."""
    days = stored_days(spark, path)
    for day in days:
        if day < days[-1] - timedelta(days=KEEP_DAYS):
            state.remove(spark, f"{path}/day={day.isoformat()}")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Events of the last 30 days before the newest one."""
    if not stored_days(spark, path):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).option("basePath", path).parquet(path)
    newest = log.filter(F.col("day") == F.lit(stored_days(spark, path)[-1])).agg(F.max("time")).head()[0]
    return log.filter(F.col("time") > newest - KEEP_DAYS * 86_400)


def events_since(log: DataFrame, cursors: DataFrame, now_s: int | None = None) -> DataFrame:
    """Each athlete's events after their cursor (athlete_id, since), kept 30 days, with an order key.

    Only days from the least cursor on are read."""
    least = cursors.agg(F.min("since")).head()[0]
    if least is None:
        least = 0
    floor = least if now_s is None else max(least, now_s - KEEP_DAYS * 86_400)
    day = (datetime(1970, 1, 1) + timedelta(seconds=floor)).date() if floor > 0 else date(1970, 1, 1)
    rows = log.filter((F.col("day") >= F.lit(day)) | F.lit(floor <= 0)).join(cursors, "athlete_id").filter(F.col("time") > F.col("since"))
    if now_s is not None:
        rows = rows.filter(F.col("time") > now_s - KEEP_DAYS * 86_400)
    return rows.select("athlete_id", "type", "time", "activity_id")


def changes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revoked athletes, removed activities) a batch of events asks for."""
    revoked = events.filter("type = 'deauthorized'").select("athlete_id").distinct()
    removed = events.filter("type = 'deleted' and activity_id is not null").select("athlete_id", "activity_id").distinct()
    return revoked, removed


def change_stream(events: DataFrame, path: str, checkpoint: str):
    """Stores what each batch of events asks for: (athlete_id, type, activity_id)."""
    table = change_table(events.sparkSession, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        revoked, removed = changes(batch)
        rows = removed.withColumn("type", F.lit("deleted")).unionByName(revoked.select("athlete_id", F.lit(None).cast("bigint").alias("activity_id"), F.lit("deauthorized").alias("type")))
        seen = table.read(batch_id, rows).select("athlete_id", "activity_id", "type")
        table.put(rows.join(seen, rows["athlete_id"].eqNullSafe(seen["athlete_id"]) & rows["activity_id"].eqNullSafe(seen["activity_id"]) & (rows["type"] == seen["type"]), "left_anti"), batch_id)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_table(spark: SparkSession, path: str) -> state.Deltas:
    return state.Deltas(spark, path, "athlete_id BIGINT, activity_id BIGINT, type STRING", ["athlete_id", "activity_id", "type"])


def tombstone_stream(log: DataFrame, checkpoint: str, sink=None):
    """Last change per name (name, changed_at, writer): the largest |changed_at|, at equal times the first
    writer. A batch touches only the names it holds; ``sink`` gets those whose change took effect."""
    rows = log.withColumn("writer", F.col("writer").cast("bigint") if "writer" in log.columns else F.lit(0).cast("bigint")).filter("changed_at is not null")
    at = F.col("changed_at")
    # ~x falls as x rises and knows no overflow: |changed_at| - 1, then the writers backwards.
    rank = [F.bitwise_not(F.when(at < 0, at).otherwise(-at)).alias("size"), F.bitwise_not(F.coalesce("writer", F.lit(0))).alias("first")]
    return state.keep_latest(rows, ["name"], ["changed_at", "writer"], rank, checkpoint, sink)


def tombstones_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    return state.latest(spark, checkpoint).select("name", "changed_at", (F.col("changed_at") > 0).alias("deleted"))


def names_stream(log: DataFrame, checkpoint: str, sink=None):
    """Current name per (athlete_id, file_name); the last arrival wins, at equal arrivals the larger name."""
    return state.keep_latest(log.filter("arrival is not null"), ["athlete_id", "file_name"], ["arrival", "new_name"], [F.col("arrival").alias("last"), F.col("new_name").alias("name")], checkpoint, sink)


def names_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    return state.latest(spark, checkpoint).select("athlete_id", "file_name", "new_name", "arrival")


def import_stream(spark: SparkSession, folder: str, schema: str, path: str, checkpoint: str, suffix: str = ""):
    """New and changed files of JSON lines, parsed into ``path``/rows; lines that don't parse go to
    ``path``/bad, and ``path``/files logs every file added, changed or removed."""
    raw = changed_lines(spark, folder, f"{path}/listings", suffix)
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))

    def store(batch: DataFrame, batch_id: int) -> None:
        good = F.col("r").isNotNull() & F.col("r._bad").isNull()
        batch.filter("value is null").select("file", "modified", "change").write.mode("overwrite").parquet(f"{path}/files/batch={batch_id}")
        batch.filter(F.col("value").isNotNull() & good).select("file", "r.*").drop("_bad").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.filter(F.col("value").isNotNull() & ~good).select("file", "value").write.mode("overwrite").parquet(f"{path}/bad/batch={batch_id}")

    return parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imported(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of the files as they are now: of each file the batch that read it last."""
    log = spark.read.schema("file STRING, modified BIGINT, change STRING, batch INT").parquet(f"{path}/files")
    now = log.groupBy("file").agg(F.max("batch").alias("batch"), F.max_by("change", "batch").alias("change")).filter("change <> 'removed'").select("file", "batch")
    rows = spark.read.schema(f"file STRING, {schema}, batch INT").parquet(f"{path}/rows")
    bad = spark.read.schema("file STRING, value STRING, batch INT").parquet(f"{path}/bad")
    return rows.join(now, ["file", "batch"], "left_semi"), bad.join(now, ["file", "batch"], "left_semi")


def interim_refresh(stream: DataFrame, refresh, checkpoint: str, seconds: int = REFRESH_S):
    """Calls ``refresh(batch, batch_id)`` every few seconds while rows arrive. A batch that is tried again
    keeps its id, so what it wrote under that id can be replaced."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


VISIT = "athlete_id BIGINT, tile_key BIGINT, start_us BIGINT, activity_id BIGINT, correction BOOLEAN"


def visit_table(spark: SparkSession, path: str) -> state.Deltas:
    return state.Deltas(spark, path, VISIT, ["athlete_id", "tile_key"])


def first_visit_stream(visits: DataFrame, path: str, checkpoint: str):
    """First visits from (athlete_id, tile_key, activity_id, start_ts), in any order of arrival.

    Each batch probes the buckets of its athletes and stores only tiles that are new, and as
    ``correction`` those an earlier visit arrived late for. Undated visits come first."""
    table = visit_table(visits.sparkSession, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = earliest(batch.select("athlete_id", "tile_key", F.coalesce(F.unix_micros("start_ts"), F.lit(UNDATED)).alias("start_us"), "activity_id"))
        known = earliest(table.read(batch_id, rows)).select("athlete_id", "tile_key", F.col("start_us").alias("_us"), F.col("activity_id").alias("_id"))
        earlier = F.struct("start_us", "activity_id") < F.struct(F.col("_us").alias("start_us"), F.col("_id").alias("activity_id"))
        fresh = rows.join(known, ["athlete_id", "tile_key"], "left").filter(F.col("_us").isNull() | earlier)
        table.put(fresh.withColumn("correction", F.col("_us").isNotNull()), batch_id)

    return visits.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def earliest(visits: DataFrame) -> DataFrame:
    first = visits.groupBy("athlete_id", "tile_key").agg(F.min(F.struct("start_us", "activity_id")).alias("v"))
    return first.select("athlete_id", "tile_key", "v.start_us", "v.activity_id")


def first_visits(spark: SparkSession, path: str) -> DataFrame:
    """(athlete_id, tile_key, activity_id, first_ts) as of the batches stored so far."""
    out = earliest(visit_table(spark, path).read())
    return out.select("athlete_id", "tile_key", "activity_id", F.when(F.col("start_us") > UNDATED, F.timestamp_micros("start_us")).alias("first_ts"))


def late_merge(stored: DataFrame, groups: DataFrame, late: DataFrame) -> DataFrame:
    """Groups after ``late`` copies arrived: only the islands they touch are grouped again.

    An island is closed under same-workout links: the groups that late copies link to, the groups
    those link to, and so on. Nothing outside it can change."""
    keys, island, edge = ["athlete_id", "activity_id"], None, late
    while True:
        hit = merge.same_workout(edge, stored).select("athlete_id", F.col("library_id").alias("activity_id")).distinct()
        found = groups.join(hit, keys, "left_semi").select("athlete_id", "group_id").distinct()
        if island is not None:
            found = found.join(island, ["athlete_id", "group_id"], "left_anti")
        found = cut(found)
        island = found if island is None else island.unionByName(found)
        if found.isEmpty():
            break
        edge = stored.join(groups.join(found, ["athlete_id", "group_id"], "left_semi"), keys, "left_semi")
    again = cut(groups.join(island, ["athlete_id", "group_id"], "left_semi").select(*keys))
    rows = stored.join(again, keys, "left_semi").unionByName(late)
    return groups.join(again, keys, "left_anti").unionByName(merge.duplicate_groups(rows))


def late_merge_stream(activities: DataFrame, path: str, checkpoint: str):
    """Groups activities as they arrive: each batch reads the buckets of its athletes, groups the
    touched islands again and stores only the rows that changed."""
    spark = activities.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in activities.schema)
    known, groups = state.Deltas(spark, f"{path}/activities", kinds, ["athlete_id", "activity_id"]), group_table(spark, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        late = cut(batch.dropDuplicates(["athlete_id", "activity_id"]).join(known.read(batch_id, batch).select("athlete_id", "activity_id"), ["athlete_id", "activity_id"], "left_anti"))
        now = cut(groups.latest(batch_id, late))
        merged = cut(late_merge(known.read(batch_id, late).drop("bucket", "batch"), now, late))
        groups.put(merged.join(now, merged.columns, "left_anti"), batch_id)
        known.put(late, batch_id)

    return activities.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_table(spark: SparkSession, path: str) -> state.Deltas:
    return state.Deltas(spark, f"{path}/groups", "athlete_id BIGINT, activity_id BIGINT, group_id BIGINT", ["athlete_id", "activity_id"])


METRICS = ["sleep_s", "battery", "steps"]
HEALTH = "athlete_id BIGINT, fetched BIGINT, day DATE, " + ", ".join(f"{m} BIGINT, {m}_at BIGINT" for m in METRICS) + ", steps_day DATE"


def health_parts(log: DataFrame) -> DataFrame:
    """Per athlete the newest fetch and, for each metric, its newest known value and when that was.
    Parts of a log fold into those of the whole (``health_fold``)."""
    at = {m: F.when(F.col(m).isNotNull(), F.col("fetched")) for m in METRICS}
    return log.groupBy("athlete_id").agg(F.max("fetched").alias("fetched"), F.max_by("day", "fetched").alias("day"), *[F.max_by(m, at[m]).cast("bigint").alias(m) for m in METRICS],
                                         *[F.max(at[m]).alias(f"{m}_at") for m in METRICS], F.max_by("day", at["steps"]).alias("steps_day"))


def health_fold(parts: DataFrame) -> DataFrame:
    return parts.groupBy("athlete_id").agg(F.max("fetched").alias("fetched"), F.max_by("day", "fetched").alias("day"), *[F.max_by(m, f"{m}_at").alias(m) for m in METRICS],
                                           *[F.max(f"{m}_at").alias(f"{m}_at") for m in METRICS], F.max_by("steps_day", "steps_at").alias("steps_day"))


def health_stream(log: DataFrame, path: str, checkpoint: str):
    """Stores one row per athlete of each batch; nothing stored before is read or written again."""
    table = state.Deltas(log.sparkSession, path, HEALTH, ["athlete_id"])
    return log.writeStream.foreachBatch(lambda batch, batch_id: table.put(health_parts(batch), batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_now(spark: SparkSession, path: str, now_s: int | None = None) -> DataFrame:
    return health_view(health_fold(state.Deltas(spark, path, HEALTH, ["athlete_id"]).read()), now_s)


def health_latest(log: DataFrame, now_s: int | None = None) -> DataFrame:
    """Latest value per metric from (athlete_id, fetched, day, steps, sleep_s, battery).

    Missing values keep the last known one; steps only from the day of the latest row."""
    return health_view(health_parts(log), now_s)


def health_view(parts: DataFrame, now_s: int | None = None) -> DataFrame:
    out = parts.select("athlete_id", "fetched", "day", "sleep_s", "battery", F.when(F.col("steps_day") == F.col("day"), F.col("steps")).alias("steps"))
    return out if now_s is None else out.withColumn("fresh", (F.lit(now_s) - F.col("fetched") < FRESH_S) & (F.col("fetched") <= now_s))

"""State that outlives a batch: one value per key in the state store, and tables kept as deltas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_latest(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], rank: Sequence[Column], checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Runs a stream into a value per key on RocksDB: a batch reads and writes only the keys it holds.

    The highest ``rank`` wins, of equal ones the row of the earliest batch. Rows of a key are folded
    before they are exchanged and before its state is read. ``sink`` gets the keys whose row changed,
    with their new row. Rows that lack a key go. The values are read back with ``latest``."""
    spark = stream.sparkSession
    # Within a batch the time is that of its offset log, also when it is replayed.
    now = F.unix_micros(F.current_timestamp())
    row = F.struct(F.struct(*rank).alias("_rank"), (-now).alias("_since"), *columns)
    ready = stream.select(*keys, row.alias("_row"))
    for k in keys:
        ready = ready.filter(F.col(k).isNotNull())
    best = ready.groupBy(*keys).agg(F.max("_row").alias("_row"))
    changed = best.filter(F.col("_row._since") == -now).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
    writer = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("noop")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows ``keep_latest`` holds now, read from its state."""
    held = spark.read.format("statestore").option("path", checkpoint).load()
    row = f"value.{held.schema['value'].dataType.names[0]}"
    return held.select("key.*", f"{row}.*").drop("_rank", "_since")


class Deltas:
    """A table that every batch extends by one folder (batch=n) split into buckets of the first key.

    A replayed batch replaces its own folder. Readers prune buckets; nothing else is rewritten
    until ``compact`` folds old folders into one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def bucket(self):
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Batches are numbered from 0."""
        self._write(rows, batch + 1)

    def _write(self, rows: DataFrame, number: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        (rows.select(*names, self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}"))

    def read(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """All stored rows with their ``batch``; only batches below ``before``, only the buckets of the
        keys in ``touched`` (at most ``buckets`` numbers reach the driver)."""
        if not self._folders():
            return self.spark.createDataFrame([], self.schema + ", bucket INT, batch INT")
        out = self.spark.read.schema(self.schema + ", bucket INT, batch INT").option("basePath", self.path).parquet(self.path)
        if before is not None:
            out = out.filter(F.abs("batch") <= before)
        if touched is not None:
            out = out.filter(F.col("bucket").isin([r[0] for r in touched.select(self.bucket()).distinct().collect()]))
        return out

    def latest(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The newest row of every key. A compacted folder (negative) stands after the batches it folds."""
        rows = self.read(before, touched)
        rest = [c for c in rows.columns if c not in (*self.keys, "bucket", "batch")]
        newest = F.max_by(F.struct(*rest), F.abs("batch") * 2 + (F.col("batch") < 0).cast("int"))
        return rows.groupBy(*self.keys).agg(newest.alias("_m")).select(*self.keys, "_m.*")

    def compact(self, upto: int) -> None:
        """Folds batches 0..``upto`` into one folder of newest rows. Readers are right at any moment: the
        folded rows outrank those they replace, and these go only afterwards."""
        self._write(self.latest(before=upto + 1), -(upto + 1))
        for name in self._folders():
            number = int(name.split("=")[1])
            if abs(number) <= upto + 1 and number != -(upto + 1):
                remove(self.spark, f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        return [n for n in names_in(self.spark, self.path) if n.startswith("batch=")]


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it is missing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def remove(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)

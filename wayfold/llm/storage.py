"""Tables between steps, in the shared checkpoint folder, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wayfold.session import checkpoint_dir

#: With this setting Spark removes the shuffle files of a query when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; its shuffle files are gone then."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/wayfold-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def drop(table: DataFrame, part: str = "") -> None:
    """Removes a table that ``put`` wrote, or its folder ``part``, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table._wayfold_path}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

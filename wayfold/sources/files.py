"""Folders read incrementally: only new or changed files are handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, suffix: str = ".fit", with_content: bool = False) -> DataFrame:
    """Files below ``folder`` (path, cache_key, bytes) with one suffix; hidden ones are skipped.

    Contents are read only when asked for."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
             .filter(~F.element_at(F.split("path", "/"), -1).startswith(".")))
    keyed = found.select("path", F.unix_seconds("modificationTime").cast("string").alias("cache_key"), F.col("length").alias("bytes"), *(["content"] if with_content else []))
    return keyed


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select("path", "cache_key"), ["path", "cache_key"], "left_anti")


def changed_challenges(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, problems): files whose time or size differs and whose content hash differs too.

    ``known`` has (path, cache_key, bytes, digest); unreadable files are those without content."""
    touched = files.join(known.select("path", "cache_key", "bytes"), ["path", "cache_key", "bytes"], "left_anti").withColumn("digest", F.sha2("content", 256))
    problems = touched.filter("content is null or bytes = 0").select("path", F.lit("unreadable").alias("reason"))
    changed = touched.filter("content is not null and bytes > 0").join(known.select("path", "digest"), ["path", "digest"], "left_anti")
    return changed, problems

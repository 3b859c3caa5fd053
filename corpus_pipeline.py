"""Corpus pipeline over ``documents``: quality, language, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
checkpoint folder and hands it to the next stage. All stages but the last return the columns of
``documents``. Every stage accepts null values, empty tables and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import langid, mixing, neardup, packing, quality
from wayfold.session import cut, prepare

#: Least share of the tokens that the mixture keeps while no document is read twice, the share of
#: the largest possible entropy at which sources are even enough to give up nothing more, and the
#: confidence below which a language is not accepted.
MIX_BUDGET, MIX_ENTROPY, LEAST_SURE = 0.9, 0.95, 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5; learns from all labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return docs.filter(quality.scorer(model)("text") >= 0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the marked ones have: those without letters, and those that fit
    no language better than the others, go. With no marked document all stay."""
    model = langid.train(docs)
    if not model.langs:
        return docs
    sure = min(LEAST_SURE, 1.2 / len(model.langs))
    said = docs.select(F.struct(*docs.columns).alias("row"), langid.predictor(model)("text").alias("said"))  # whatever else the columns are called
    return said.filter((F.col("said.lang_pred") != langid.UNKNOWN) & (F.col("said.score") >= sure)).select("row.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id. Rows that
    repeat an id and its text leave one; an id on several texts keeps those that stand for their
    group; documents without an id stay."""
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("row"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    kept = neardup.classes(docs).filter("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    named = whole.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return named.unionByName(whole.filter("doc_id is null").select(*named.columns)).select("row.*")


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of the sources without reading a document twice: made even up to ``MIX_ENTROPY`` for
    as few tokens as that takes, a tenth at most. Sources that are even enough lose nothing."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # whatever else the columns are called
    return mixing.mix(whole, budget_share=MIX_BUDGET, entropy_share=MIX_ENTROPY, max_repeats=1.0, widen=True).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a batch of its length bucket."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("near copies", near_copy_stage), ("mixture", mixture_stage), ("packing", packing_stage)]

#: No stage but the last two can be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

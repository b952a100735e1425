"""The corpus pipeline: a chain of stages over ``documents``, each a dealt operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps. ``run`` applies them in order, writing each stage's documents to the
shared checkpoint folder and reading them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, table
from driftgate.llm.line_dedup import line_dedup
from driftgate.llm.minmax_dedup import near_duplicates
from driftgate.llm.packing import best_fit_pack
from driftgate.llm.quality_rules import quality_rules
from driftgate.llm.suffix_dedup import suffix_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the outlier test."""
    return quality_rules(docs).filter("kept").select("row.*")


def _retexted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the new text and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    return _retexted(docs, line_dedup(docs).select("row", "text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. A row is named
    by id and text, so different texts that repeat an id are different documents; of rows that
    agree in both one stays."""
    scratch = Scratch(spark, "stage")
    name = F.struct(F.col("doc_id"), F.xxhash64(F.col("text")).alias("digest"))
    named = docs.filter("doc_id is not null").withColumn("_name", name)
    verdict = near_duplicates(named, id="_name").filter("kept").select(F.col("id").alias("_name"))
    verdict = scratch.write(verdict.groupBy("_name").agg(F.count(F.lit(1)).alias("rows")))
    kept = named.join(verdict.select("_name").hint("shuffle_hash"), "_name", "left_semi")
    repeated = verdict.filter("rows > 1").select("_name")
    if repeated.limit(1).count():
        again = kept.join(repeated, "_name", "left_semi").dropDuplicates(["_name"])
        kept = kept.join(repeated, "_name", "left_anti").select(*named.columns).union(again.select(*named.columns))
    return kept.select(docs.columns).union(docs.filter("doc_id is null"))


#: Bytes of a repeated passage: a passage of over 50 words is longer (51 words of the given
#: languages have 280 to 340 bytes, and fewer than 272 in one of ten cases).
PASSAGE = 272


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of ``PASSAGE`` bytes or more that stand elsewhere, too."""
    return _retexted(docs, suffix_dedup(docs, PASSAGE).select("row", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of every document go: bin, offset and the bin's capacity."""
    return best_fit_pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: The outlier estimate iterates and the near-duplicate classes are components: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs = scratch.write(docs)
    return docs

"""Where a dependency is named: a nested table beside the lock.

A row holds a dependency's occurrences in one block of lines of one file, so a row is bounded
whatever the dependency, and nothing is gathered by dependency but counts and sums. The lock
refers to its occurrences by number and digest (the multiset digest of ``operators.publish``),
so a reader can tell whether the table is that of the lock.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.functions.identity import model_key
from driftgate.operators.publish import DEC, _fold, _halves

#: Lines of a file whose occurrences share a row.
BLOCK_LINES = 4096
FIELDS = ["line", "column", "hit_ord", "snippet", "confidence", "kind"]


def occurrence_blocks(hits: DataFrame) -> DataFrame:
    """(scope, entity_key, path, block, occurrences): every hit, in the order of its file."""
    block = F.floor(F.col("line") / BLOCK_LINES).cast("int").alias("block")
    keyed = hits.select("scope", model_key("provider", "model_id").alias("entity_key"), "path", block, F.struct(*FIELDS).alias("o"))
    return keyed.groupBy("scope", "entity_key", "path", "block").agg(F.array_sort(F.collect_list("o")).alias("occurrences"))


def flat_occurrences(blocks: DataFrame) -> DataFrame:
    return blocks.select("scope", "entity_key", "path", F.explode("occurrences").alias("o")).select("scope", "entity_key", "path", "o.*")


def occurrence_digests(blocks: DataFrame) -> DataFrame:
    """(scope, entity_key, n_occurrences, occurrences_digest): partial aggregates only."""
    flat = flat_occurrences(blocks)
    text = F.to_json(F.struct("path", *FIELDS), {"ignoreNullFields": "false"})
    h1, h2 = _halves(text)
    g = flat.select("scope", "entity_key", h1.alias("h1"), h2.alias("h2")).groupBy("scope", "entity_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    return g.select("scope", "entity_key", F.col("n").alias("n_occurrences"), _fold(F.col("n"), F.col("s1").cast(DEC), F.col("s2").cast(DEC)).alias("occurrences_digest"))


def with_occurrences(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lock records with the number and digest of their occurrences (none: 0 and null)."""
    d = occurrence_digests(blocks)
    kept = [c for c in records.columns if c not in ("n_occurrences", "occurrences_digest")]
    return records.select(*kept).join(d, ["scope", "entity_key"], "left").withColumn("n_occurrences", F.coalesce("n_occurrences", F.lit(0)).cast("long"))


def write_occurrences(blocks: DataFrame, lock: DataFrame, path: str) -> None:
    """Store the occurrences of the lock's dependencies, and of no others, beside it."""
    kept = blocks.join(lock.select("scope", "entity_key"), ["scope", "entity_key"], "left_semi")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(os.path.join(path, "occurrences"))


def read_occurrences(spark: SparkSession, lock: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, strangers): the stored occurrences, and the lock's dependencies (scope,
    entity_key) whose number or digest says otherwise."""
    blocks = spark.read.parquet(os.path.join(path, "occurrences"))
    found = occurrence_digests(blocks).select("scope", "entity_key", F.col("n_occurrences").alias("_n"), F.col("occurrences_digest").alias("_d"))
    both = lock.select("scope", "entity_key", "n_occurrences", "occurrences_digest").join(found, ["scope", "entity_key"], "left")
    same = (F.col("n_occurrences") == F.coalesce("_n", F.lit(0))) & F.col("occurrences_digest").eqNullSafe(F.col("_d"))
    return blocks, both.filter(~F.coalesce(same, F.lit(False))).select("scope", "entity_key")

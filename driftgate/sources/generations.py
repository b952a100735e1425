"""What every source says now: complete bodies, generations and tombstones.

A source's fetch (all its bodies of one fetch time) is its complete list. The state holds,
for every (entity, source), the last observation, and ``gone_at`` once a newer accepted fetch
of that source no longer lists the entity: a tombstone, which keeps the observation but counts
for nothing. A fetch that is older than the source's newest accepted one changes nothing; a
source that was not fetched, or whose body was refused, keeps its entities.

A state is written as a new generation: first the sources' newest fetch times (``heads``),
then the observations, whose ``_SUCCESS`` makes the generation count. One shuffle by (entity,
source), reduced to the last observation of each before it moves; the heads are one row a
source. Merging a batch again gives the same state.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.operators.reconcile import latest_per_source
from driftgate.sources.manifest import exists, listed, remove

HEADS = "source_id string, head timestamp"


def _generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished generations, ascending."""
    return sorted(int(n[4:]) for n in listed(spark, root)
                  if n.startswith("gen=") and exists(spark, os.path.join(root, n, "rows", "_SUCCESS")))


def _at(root: str, generation: int, table: str) -> str:
    return os.path.join(root, f"gen={generation}", table)


def fetch_heads(accepted: DataFrame) -> DataFrame:
    """(source_id, head): the newest accepted fetch of each source among landing rows."""
    return accepted.groupBy("source_id").agg(F.max("fetched_at").alias("head"))


def stored_heads(spark: SparkSession, path: str) -> DataFrame:
    root = os.path.join(path, "state")
    gens = _generations(spark, root)
    return spark.read.schema(HEADS).parquet(_at(root, gens[-1], "heads")) if gens else spark.createDataFrame([], HEADS)


def newest_bodies(spark: SparkSession, path: str, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads after this batch, the accepted bodies that belong to them): bodies of older
    fetches are not even parsed."""
    heads = stored_heads(spark, path).unionByName(fetch_heads(accepted)).groupBy("source_id").agg(F.max("head").alias("head"))
    rows = [(r["source_id"], r["head"]) for r in heads.toLocalIterator()]  # one row for each registered source
    heads = spark.createDataFrame(rows, HEADS)
    # Sent to where the bodies lie: by source, all of one source would meet in one task.
    return heads, accepted.join(F.broadcast(heads), "source_id").filter(F.col("fetched_at") == F.col("head")).drop("head")


def merge_generation(spark: SparkSession, path: str, heads: DataFrame, new: DataFrame) -> DataFrame:
    """Merge the observations of the newest bodies into the state: the next generation,
    written and read back, tombstones included."""
    root = os.path.join(path, "state")
    gens = _generations(spark, root)
    new = new.withColumn("gone_at", F.lit(None).cast("timestamp"))
    schema = new.schema
    if gens:
        new = new.unionByName(spark.read.schema(schema).parquet(_at(root, gens[-1], "rows")))
    kept = latest_per_source(new.withColumn("_seq", F.col("obs_seq"))).withColumnRenamed("_seq", "obs_seq")
    # Not in the source's newest complete list: it left the feed.
    kept = kept.join(F.broadcast(heads), "source_id", "left")
    left = F.col("gone_at").isNull() & (F.col("fetched_at") < F.col("head"))
    kept = kept.withColumn("gone_at", F.when(left, F.col("head")).otherwise(F.col("gone_at"))).select(*schema.names)
    generation = gens[-1] + 1 if gens else 0
    heads.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(_at(root, generation, "heads"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(_at(root, generation, "rows"))
    for g in gens[:-1]:  # the one before stays, for readers that still use it
        remove(spark, os.path.join(root, f"gen={g}"))
    return spark.read.schema(schema).parquet(_at(root, generation, "rows"))


def live(state: DataFrame) -> DataFrame:
    """The observations that count: those their source still lists."""
    return state.filter("gone_at is null").drop("gone_at")


def departures(state: DataFrame) -> DataFrame:
    """Which entities left which source, and when (the fetch that no longer listed them)."""
    return state.filter("gone_at is not null").select("entity_key", "source_id", F.col("fetched_at").alias("last_seen"), "gone_at")

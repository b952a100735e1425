"""Atomic publishing: records first, then one small manifest file that names them.

A version's record files lie in a folder of their own and are never replaced. What makes
them a snapshot is a numbered manifest, written aside and renamed into place last. A reader
looks at manifests only, so it sees the old version or the new one, whatever happens to the
writer in between; files that no manifest names are leftovers of a run that did not finish.
One publisher at a time writes to a table.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("snapshot_date", T.StringType()),
    T.StructField("schema_version", T.IntegerType()), T.StructField("generated_at", T.StringType()),
    T.StructField("generator_version", T.StringType()), T.StructField("frozen", T.BooleanType()),
    T.StructField("freeze_reason", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("folder", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())),
])


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object): any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _folder(path: str) -> str:
    return os.path.join(path, "manifest")


def write_version(df: DataFrame, path: str, snapshot_date: str) -> tuple[str, list[str]]:
    """The records of a date in a new folder: (folder, file names), not yet published."""
    folder = os.path.join("records", f"snapshot_date={snapshot_date}", f"v={uuid.uuid4().hex}")
    df.write.parquet(os.path.join(path, folder))
    names = [n for n in listed(df.sparkSession, os.path.join(path, folder)) if not n.startswith(("_", "."))]
    return folder, names


def write_versions(df: DataFrame, path: str, date: str, dates: list[str]) -> dict[str, tuple[str, list[str]]]:
    """The records of many dates (column ``date``) in one pass, each date in a new folder as of
    ``write_version``: date -> (folder, file names)."""
    spark, version = df.sparkSession, f"v={uuid.uuid4().hex}"
    out = df.select("*", F.col(date).alias("snapshot_date"), F.lit(version[2:]).alias("v")) if date != "snapshot_date" else df.withColumn("v", F.lit(version[2:]))
    # Dealt by date in pieces of bounded size, so that a task writes few dates.
    (out.hint("rebalance", "snapshot_date").write.mode("append").partitionBy("snapshot_date", "v")
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(os.path.join(path, "records")))
    found = {}
    for d in dates:
        folder = os.path.join("records", f"snapshot_date={d}", version)
        found[d] = folder, [n for n in listed(spark, os.path.join(path, folder)) if not n.startswith(("_", "."))]
    return found


def commit(spark: SparkSession, path: str, entry: dict) -> int:
    """Publish: the next manifest, moved into place when it is complete."""
    names = [n for n in listed(spark, _folder(path)) if n.endswith(".json")]
    seq = int(names[-1].removesuffix(".json")) + 1 if names else 0
    fs, aside = file_system(spark, os.path.join(_folder(path), f"_new-{uuid.uuid4().hex}"))
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"seq": seq, **entry}).encode()))
    out.close()
    _, place = file_system(spark, os.path.join(_folder(path), f"{seq:012d}.json"))
    if fs.exists(place) or not fs.rename(aside, place):
        raise RuntimeError(f"another publisher took manifest {seq} of {path}")
    return seq


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest of every date (one small row for each publish is read)."""
    if not exists(spark, _folder(path)):
        return spark.createDataFrame([], MANIFEST)
    every = spark.read.schema(MANIFEST).json(_folder(path)).filter("seq is not null")
    newest = every.groupBy("snapshot_date").agg(F.max_by(F.struct(*[c for c in every.columns if c != "snapshot_date"]), "seq").alias("m"))
    return newest.select("snapshot_date", "m.*")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the record folders that no date's newest manifest names; returns how many. For
    times when no reader holds an older version and no publisher runs."""
    kept = {r["folder"] for r in manifests(spark, path).select("folder").toLocalIterator()}
    gone = 0
    for date in listed(spark, os.path.join(path, "records")):
        for version in listed(spark, os.path.join(path, "records", date)):
            folder = os.path.join("records", date, version)
            if folder not in kept:
                remove(spark, os.path.join(path, folder))
                gone += 1
    return gone

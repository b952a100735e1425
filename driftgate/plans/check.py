"""The check job as it runs in production: stored lock + latest stored snapshot -> diff ->
rules, with findings computed once and every report derived from the written findings.

Writing the findings cuts the lineage: the gate, SARIF and JSON reports read them back
instead of re-running the diff, and a lost executor during reporting recomputes from the
written table, not from the snapshots. Every table is replaced whole. Rows are laid out by
``scope_bucket``, a hash of the scope, and spread over ``FILES`` files of a bucket, so the
number of files grows with neither tenants nor tasks and a giant tenant is no single file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.operators.diff import field_diff
from driftgate.operators.documents import ordered_findings, sarif_document
from driftgate.operators.policy import evaluate, gate
from driftgate.operators.reports import json_report, sarif_results, sarif_rules
from driftgate.schemas import GENERATOR_VERSION


BUCKETS, FILES = 16, 4


def write_by_scope(df: DataFrame, path: str, form: str = "parquet", buckets: int = BUCKETS, files: int = FILES) -> None:
    """Replace the table at ``path``: at most ``buckets * files`` files, pruned by
    ``scope_bucket`` (``pmod(xxhash64(scope), buckets)``)."""
    bucket = F.pmod(F.xxhash64("scope"), F.lit(buckets)).cast("int")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files)).cast("int")
    (df.withColumn("scope_bucket", bucket).withColumn("_salt", salt)
       .repartition("scope_bucket", "_salt").drop("_salt")
       .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("scope_bucket").format(form).save(path))


def run_check(spark: SparkSession, lock: DataFrame, snapshot: DataFrame, policy: DataFrame, now: str,
              out_dir: str, frozen: bool = False, warnings: list[str] | None = None,
              freeze_reason: str | None = None, documents: bool = False) -> DataFrame:
    """``lock``: lock records (``operators.lock.lock_records``, as stored) or long lock rows;
    ``snapshot``: wide records of the current snapshot (``sources.snapshots.read_snapshot``);
    ``policy``: one row per scope. Writes ``findings``, ``gate``, ``sarif_results``,
    ``sarif_rules`` and ``json_report`` under ``out_dir`` and returns the gate table. With
    ``documents`` also ``sarif``: each scope's SARIF document as ordered pieces."""
    findings = evaluate(field_diff(lock, snapshot), policy, now, frozen, warnings, freeze_reason)
    fpath = os.path.join(out_dir, "findings")
    write_by_scope(findings, fpath)
    written = spark.read.parquet(fpath).drop("scope_bucket")
    g = gate(written, policy)
    g.write.mode("overwrite").parquet(os.path.join(out_dir, "gate"))
    write_by_scope(sarif_results(written), os.path.join(out_dir, "sarif_results"))
    write_by_scope(sarif_rules(written), os.path.join(out_dir, "sarif_rules"))
    write_by_scope(json_report(written, g), os.path.join(out_dir, "json_report"), "json")
    if documents:
        pieces = sarif_document(ordered_findings(written), g, "driftgate", GENERATOR_VERSION)
        write_by_scope(pieces, os.path.join(out_dir, "sarif"))
    return spark.read.parquet(os.path.join(out_dir, "gate"))

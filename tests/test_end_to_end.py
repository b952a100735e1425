"""The whole flow on a small project: discover -> refresh the registry -> build and write
the lock -> a later refresh with a price rise -> read the lock -> check -> gate fails."""

import json
import os

from pyspark.sql import functions as F

from driftgate.operators import discovery as D
from driftgate.operators.lock import lock_long, lock_records
from driftgate.operators.policy import effective_policy
from driftgate.plans.check import run_check
from driftgate.schemas import DEFAULT_IGNORE_GLOBS, SNAPSHOT
from driftgate.sources.lockio import lock_lines, lock_records_from_lines, read_lock, write_lock
from driftgate.sources.snapshots import read_snapshot, refresh


def landing(spark, price):
    catalog = {"openai": {"id": "openai", "models": {
        "gpt-4o-2024-08-06": {"id": "gpt-4o-2024-08-06", "status": "active", "cost": {"input": price}},
        "gpt-4o": {"id": "gpt-4o", "status": "active", "cost": {"input": 2.5}}}}}
    pack = {"schemaVersion": 1, "updatedAt": "2026-07-01", "models": [
        {"provider": "openai", "modelId": "gpt-4o-2024-08-06", "lifecycleStatus": "active",
         "inputPricePerMillion": price}]}
    feed = {"version": "1", "items": []}
    rows = [("models.dev", json.dumps(catalog)), ("official-provider", json.dumps(pack)),
            ("deprecations.info", json.dumps(feed))]
    return spark.createDataFrame([(s, b) for s, b in rows], "source_id string, body string") \
        .withColumn("fetched_at", F.to_timestamp(F.lit("2026-07-23 00:00:00")))


def test_scan_lock_refresh_check(spark, tmp_dir):
    proj = os.path.join(tmp_dir, "project")
    os.makedirs(os.path.join(proj, "src"))
    with open(os.path.join(proj, "src", "app.ts"), "w") as fh:
        fh.write('import OpenAI from "openai";\nconst c = new OpenAI();\n'
                 'await c.chat.completions.create({ model: "gpt-4o-2024-08-06", messages: [] });\n')
    with open(os.path.join(proj, ".env.example"), "w") as fh:
        fh.write("OPENAI_MODEL=gpt-4o\n")
    files = D.read_corpus(spark, proj, "repo", DEFAULT_IGNORE_GLOBS)
    deps = D.discover_files(files).select(
        "scope", "entity_key", "provider", "model_id", "identifier_kind",
        F.col("confidence").alias("discovery_confidence"), "low_confidence", "path", "line")
    assert {r["entity_key"] for r in deps.collect()} == {"openai:gpt-4o-2024-08-06", "openai:gpt-4o"}

    snaps = os.path.join(tmp_dir, "registry")
    assert refresh(spark, landing(spark, 2.5), snaps, "2026-07-24", "2026-07-24 00:00:00").status == "published"
    wide, meta = read_snapshot(spark, snaps, SNAPSHOT)
    lock_path = os.path.join(tmp_dir, "lock")
    assert write_lock(lock_lines(lock_records(deps, wide, "2026-07-24 00:00:00"), "2026-07-24"),
                      lock_path) == 2

    assert refresh(spark, landing(spark, 5.0), snaps, "2026-07-25", "2026-07-24 00:00:00").status == "published"
    current, meta = read_snapshot(spark, snaps, SNAPSHOT)
    good, rejects = read_lock(spark.read.text(lock_path))
    assert rejects.count() == 0
    lock = lock_long(lock_records_from_lines(good))
    gate = run_check(spark, lock, current, effective_policy(deps), "2026-07-25 00:00:00",
                     os.path.join(tmp_dir, "out"), meta.frozen, meta.warnings).collect()[0]
    assert gate["exit_code"] == 1 and gate["n_fail"] == 1
    found = spark.read.parquet(os.path.join(tmp_dir, "out", "findings")).filter("severity = 'fail'").collect()
    assert [(r["key"], r["code"]) for r in found] == [("openai:gpt-4o-2024-08-06", "input-price-increase")]
    # the floating alias from the env file warns
    warn = spark.read.parquet(os.path.join(tmp_dir, "out", "findings")).filter("code = 'floating-alias'").count()
    assert warn == 1


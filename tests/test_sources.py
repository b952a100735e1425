"""Feed normalizers (S1-S5), strict JSON gate, lock and snapshot I/O (S6-S10), refresh."""

import json

from pyspark.sql import functions as F

from driftgate.sources import feeds
from driftgate.sources.lockio import read_lock, write_lock, lock_lines
from driftgate.sources.snapshots import list_snapshots, read_snapshot, refresh
from driftgate.schemas import SNAPSHOT

CATALOG = {
    "openai": {"id": "openai", "models": {
        "gpt-4o": {"id": "gpt-4o", "status": "active", "tool_call": True, "structured_output": True,
                   "attachment": True, "cost": {"input": 2.5, "output": 10}, "limit": {"context": 128000, "output": 16384},
                   "modalities": {"input": ["text", "image"]}},
        "gpt-4o-mini": {"tool_call": True}}},
    "Anthropic": {"name": "Anthropic", "models": [{"name": "claude-3-5-haiku-20241022", "attachment": False}, {}]},
}
FEED = {"version": "1", "items": [{"id": "1", "title": "t", "_deprecation": {
    "provider": "OpenAI", "model_id": "gpt-3.5-turbo", "shutdown_date": "2026-09-01", "status": "deprecated"}}]}
PACK = {"schemaVersion": 1, "updatedAt": "2026-07-01", "models": [
    {"provider": "openai", "modelId": "gpt-4o", "lifecycleStatus": "active", "inputPricePerMillion": 2.5}]}


def landing(spark, rows):
    return spark.createDataFrame([(s, b, "2026-07-23 00:00:00") for s, b in rows],
                                 "source_id string, body string, fetched_at string") \
        .withColumn("fetched_at", F.to_timestamp("fetched_at"))


def test_catalog_object_and_array_forms(spark):
    o = {r["model_id"]: r for r in feeds.parse_catalog(landing(spark, [("models.dev", json.dumps(CATALOG))])).collect()}
    assert set(o) == {"gpt-4o", "gpt-4o-mini", "claude-3-5-haiku-20241022", "1"}
    g = o["gpt-4o"]
    assert g["provider"] == "openai" and g["lifecycle_status"] == "active" and g["vision"] is True
    assert g["context_limit"] == 128000 and g["retirement_date"] is None
    m = o["gpt-4o-mini"]
    assert m["lifecycle_status"] == "unknown" and m["vision"] is None and m["structured_output"] is None
    assert o["claude-3-5-haiku-20241022"]["provider"] == "anthropic"
    assert o["claude-3-5-haiku-20241022"]["vision"] is False
    assert o["claude-3-5-haiku-20241022"]["identifier_kind"] == "fixed"


def test_feed_and_pack(spark):
    f = feeds.parse_feed(landing(spark, [("deprecations.info", json.dumps(FEED))])).collect()[0]
    assert (f["entity_key"], f["lifecycle_status"], f["retirement_date"]) == ("openai:gpt-3.5-turbo", "deprecated", "2026-09-01")
    assert f["input_price"] is None
    bad = dict(PACK, models=PACK["models"] + [{"provider": "x", "modelId": "y", "lifecycleStatus": "sunset"}])
    obs, st = feeds.parse_pack(landing(spark, [("official-provider", json.dumps(PACK)),
                                               ("official-provider", json.dumps(bad))]))
    assert obs.count() == 1
    assert sorted(r["pack_ok"] for r in st.collect()) == [False, True]


def test_malformed_body_gives_status_and_no_rows(spark):
    lg = landing(spark, [("models.dev", "{ this is not json"), ("models.dev", '{"a": {}} trailing'),
                         ("deprecations.info", json.dumps(FEED))])
    st = {r["body"][:5]: r for r in feeds.body_status(lg).collect()}
    assert st["{ thi"]["ok"] is False and st['{"a":']["ok"] is False and st['{"ver']["ok"] is True
    assert st["{ thi"]["warning"].startswith("models.dev fetch failed")
    assert feeds.parse_catalog(lg.filter("source_id = 'models.dev'")).count() == 0
    assert feeds.normalize(lg).count() == 1


def test_lock_roundtrip_and_secret_refusal(spark, tmp_dir):
    deps = spark.createDataFrame([("r", "openai:gpt-4o", "openai", "gpt-4o", "floating", 0.9, False, "a.ts", 1)],
                                 "scope string, entity_key string, provider string, model_id string, "
                                 "identifier_kind string, discovery_confidence double, low_confidence boolean, "
                                 "path string, line int")
    path = tmp_dir + "/lock"
    assert write_lock(lock_lines(deps, "2026-07-24T00:00:00Z"), path) == 1
    good, rej = read_lock(spark.read.text(path))
    assert good.count() == 1 and rej.count() == 0
    raw = spark.createDataFrame([('{"lockfileVersion": 2, "scope": "r", "key": "k", "provider": "p", '
                                  '"modelId": "m", "identifierKind": "fixed"}',), ("{bad",),
                                 ('{"lockfileVersion": 1, "path": "sk-' + "x" * 30 + '"}',)], "value string")
    reasons = sorted(r["reason"] for r in read_lock(raw)[1].collect())
    assert reasons == ["contains a secret", "not valid JSON", "unsupported lockfileVersion"]
    line = {"lockfileVersion": 1, "scope": "r", "key": "openai:m", "provider": "openai", "modelId": "m", "identifierKind": "fixed"}
    wrong = [{"identifierKind": "loose"}, {"provider": "nobody"}, {"discoveryConfidence": 1.5}, {"line": 0}, {"lockfileVersion": "one"},
             {"facts": {"provider": {"confidence": "certain"}}}]
    lines = spark.createDataFrame([(json.dumps({**line, **w}),) for w in [{}, *wrong]], "value string")
    good, rejected = read_lock(lines)
    assert good.count() == 1 and {r["reason"] for r in rejected.collect()} == {"schema validation failed"}
    # a secret in a free-text column is scrubbed before writing
    leaky = lock_lines(deps.withColumn("path", F.lit("sk-" + "y" * 30)), "t")
    write_lock(leaky, tmp_dir + "/lock2")
    assert "[REDACTED]" in spark.read.text(tmp_dir + "/lock2").collect()[0]["value"]


def test_refresh_publish_unchanged_frozen(spark, tmp_dir):
    snap = tmp_dir + "/snap"
    empty, meta = read_snapshot(spark, snap, SNAPSHOT)
    assert empty.count() == 0 and meta.frozen
    ok = landing(spark, [("models.dev", json.dumps(CATALOG)), ("official-provider", json.dumps(PACK)),
                         ("deprecations.info", json.dumps(FEED))])
    r1 = refresh(spark, ok, snap, "2026-07-24", "2026-07-24 00:00:00")
    assert r1.status == "published"
    r2 = refresh(spark, ok, snap, "2026-07-25", "2026-07-24 00:00:00")
    assert r2.status == "unchanged"
    dead = landing(spark, [("models.dev", "{"), ("official-provider", "nope"), ("deprecations.info", "")])
    r3 = refresh(spark, dead, snap, "2026-07-26", "2026-07-24 00:00:00")
    assert r3.status == "frozen"
    dates = [r["snapshot_date"] for r in list_snapshots(spark, snap).orderBy("snapshot_date").collect()]
    assert dates == ["2026-07-24", "2026-07-26"]
    latest, m = read_snapshot(spark, snap, SNAPSHOT)
    assert m.frozen and m.snapshot_date == "2026-07-26" and latest.count() > 0
    no_official = landing(spark, [("models.dev", json.dumps(CATALOG)), ("official-provider", "{")])
    assert refresh(spark, no_official, snap, "2026-07-27", "2026-07-24 00:00:00").status == "official-failed"


def test_refresh_stream_publishes_each_batch(spark, tmp_dir):
    import os
    from driftgate.sources.snapshots import list_snapshots
    from driftgate.streaming import start_refresh_stream
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(land)
    with open(os.path.join(land, "f1.json"), "w") as fh:
        for sid, body in (("models.dev", CATALOG), ("official-provider", PACK), ("deprecations.info", FEED)):
            fh.write(json.dumps({"source_id": sid, "body": json.dumps(body), "fetched_at": "2026-07-23T00:00:00Z"}) + "\n")
    q = start_refresh_stream(spark, land, tmp_dir + "/snap", tmp_dir + "/ckpt")
    q.awaitTermination(120)
    assert [r["snapshot_date"] for r in list_snapshots(spark, tmp_dir + "/snap").collect()] == ["2026-07-23"]


def test_check_job_writes_findings_once_and_reports(spark, tmp_dir):
    from helpers import SF001
    from driftgate.operators.lock import build_lock
    from driftgate.operators.policy import effective_policy
    from driftgate.plans import bindings as B
    from driftgate.plans import drift
    from driftgate.plans.check import run_check
    from driftgate.sources.snapshots import SnapshotMeta, read_snapshot, write_snapshot
    snap_path = tmp_dir + "/snapshots"
    current = drift.current_wide(spark, SF001)
    write_snapshot(current, snap_path, SnapshotMeta("2001-11-05", B.CURRENT_AS_OF))
    latest, meta = read_snapshot(spark, snap_path, current.schema)
    deps = B.dependencies(spark, SF001)
    lock = build_lock(deps, drift.approved_wide(spark, SF001), B.APPROVED_AS_OF)
    g = run_check(spark, lock, latest, effective_policy(deps), B.CURRENT_AS_OF, tmp_dir + "/out",
                  meta.frozen, meta.warnings)
    expected = {r["scope"]: (r["n_fail"], r["n_warn"]) for r in drift.run(spark, SF001).gate.collect()}
    assert {r["scope"]: (r["n_fail"], r["n_warn"]) for r in g.collect()} == expected
    assert spark.read.json(tmp_dir + "/out/json_report").count() > 0


def models(spark, snap):
    return {r["entity_key"] for r in read_snapshot(spark, snap, SNAPSHOT)[0].collect()}


def test_refresh_keeps_what_every_batch_brought(spark, tmp_dir):
    """Batches that hold one source each: nothing of an unpublished batch is lost."""
    snap = tmp_dir + "/snap"
    new = {"openai": {"id": "openai", "models": {"gpt-9": {"id": "gpt-9"}}}}
    first = refresh(spark, landing(spark, [("models.dev", json.dumps(new))]), snap, "2026-07-24", "2026-07-24 00:00:00")
    assert first.status == "official-failed"
    assert refresh(spark, landing(spark, [("official-provider", json.dumps(PACK))]), snap, "2026-07-24", "2026-07-24 00:00:00").status == "published"
    only_pack = {f"{m['provider']}:{m['modelId']}" for m in PACK["models"]}
    assert models(spark, snap) == {"openai:gpt-9"} | only_pack
    assert refresh(spark, landing(spark, [("deprecations.info", json.dumps(FEED))]), snap, "2026-07-25", "2026-07-24 00:00:00").status == "published"
    assert models(spark, snap) > only_pack
    log = {r["status"] for r in spark.read.parquet(snap + "/log").collect()}
    assert log <= {"published", "official-failed"} and "published" in log


def test_invalid_pack_is_not_published(spark, tmp_dir):
    for change in ({"lifecycleStatus": "sunset"}, {"inputPricePerMillion": "2.5"}, {"toolCalling": "yes"}, {"provider": 5},
                   {"contextLimit": 1.5}, {"evidenceUrl": "not a url"}):
        bad = {**PACK, "models": [{**PACK["models"][0], **change}]}
        obs, status = feeds.parse_pack(landing(spark, [("official-provider", json.dumps(bad))]))
        assert obs.count() == 0 and not status.first()["pack_ok"], change
    r = refresh(spark, landing(spark, [("models.dev", json.dumps(CATALOG)), ("official-provider", json.dumps(bad))]),
                tmp_dir + "/snap", "2026-07-24", "2026-07-24 00:00:00")
    assert r.status == "official-failed" and "pack is not valid" in r.warnings[0]
    assert read_snapshot(spark, tmp_dir + "/snap", SNAPSHOT)[0].count() == 0


def test_the_last_item_of_a_body_wins(spark):
    from driftgate.operators.reconcile import latest_per_source
    item = lambda day: {"_deprecation": {"provider": "openai", "model_id": "m", "shutdown_date": day}}
    body = {"version": "1", "items": [item(f"2026-0{k}-01") for k in (5, 3, 8, 2)]}
    obs = feeds.normalize(landing(spark, [("deprecations.info", json.dumps(body))]))
    assert latest_per_source(obs.repartition(3)).first()["retirement_date"] == "2026-02-01"


def test_second_check_run_replaces_the_first(spark, tmp_dir):
    """A scope without findings today keeps none of yesterday's, also after a snapshot was written."""
    import glob
    from driftgate.plans.check import write_by_scope
    from driftgate.sources.snapshots import SnapshotMeta, write_snapshot
    rows = lambda scopes: spark.createDataFrame([(s, i) for i, s in enumerate(scopes)], "scope string, n int")
    write_by_scope(rows(["a", "b"] * 500), tmp_dir + "/f")
    write_snapshot(rows(["x"]), tmp_dir + "/s", SnapshotMeta("2026-07-24", "t"))
    write_by_scope(rows(["a"] * 3), tmp_dir + "/f")
    assert {r["scope"] for r in spark.read.parquet(tmp_dir + "/f").collect()} == {"a"}
    write_by_scope(rows([f"t{i % 300}" for i in range(3000)]).repartition(8), tmp_dir + "/f")
    assert len(glob.glob(tmp_dir + "/f/*/*.parquet")) <= 64
    assert spark.read.parquet(tmp_dir + "/f").count() == 3000


def _catalog(spark, at, *ids):
    """A complete catalog and an empty pack and feed, fetched at ``at``."""
    models = {"openai": {"id": "openai", "models": {i: {"id": i, "status": "active"} for i in ids}}}
    rows = [("models.dev", json.dumps(models)), ("official-provider", json.dumps({"schemaVersion": 1, "updatedAt": "2026-07-01", "models": []})),
            ("deprecations.info", json.dumps({"version": "1", "items": []}))]
    return spark.createDataFrame(rows, "source_id string, body string").withColumn("fetched_at", F.to_timestamp(F.lit(at)))


def _keys(spark, path):
    records, meta = read_snapshot(spark, path, SNAPSHOT)
    return sorted(r["entity_key"] for r in records.collect()), meta.snapshot_date


def test_models_that_leave_a_feed_become_unknown(spark, tmp_dir):
    from driftgate.operators.diff import field_diff
    from driftgate.operators.lock import build_lock
    from driftgate.sources.generations import departures
    path = tmp_dir + "/reg"
    assert refresh(spark, _catalog(spark, "2026-07-01 00:00:00", "gpt-4o", "o3"), path, "2026-07-01", "2026-07-01 00:00:00").status == "published"
    first, _ = read_snapshot(spark, path, SNAPSHOT)
    deps = spark.createDataFrame([("r", f"openai:{m}", "openai", m, "floating", 0.9, False, "a.ts", 1) for m in ("gpt-4o", "o3")],
                                 "scope string, entity_key string, provider string, model_id string, identifier_kind string, "
                                 "discovery_confidence double, low_confidence boolean, path string, line int")
    lock = build_lock(deps, first, "2026-07-01 00:00:00").persist()
    assert lock.count() == 24
    assert refresh(spark, _catalog(spark, "2026-07-02 00:00:00", "gpt-4o"), path, "2026-07-02", "2026-07-02 00:00:00").status == "published"
    assert _keys(spark, path) == (["openai:gpt-4o"], "2026-07-02")
    kinds = {(r["entity_key"], r["kind"]) for r in field_diff(lock, read_snapshot(spark, path, SNAPSHOT)[0]).select("entity_key", "kind").collect()}
    assert ("openai:o3", "unknown") in kinds and ("openai:gpt-4o", "unknown") not in kinds and ("openai:o3", "unchanged") not in kinds
    # the same body again, a body older than the newest, and a model that comes back
    assert refresh(spark, _catalog(spark, "2026-07-02 00:00:00", "gpt-4o"), path, "2026-07-03", "2026-07-02 00:00:00").status == "unchanged"
    assert refresh(spark, _catalog(spark, "2026-06-30 00:00:00", "o1", "o3"), path, "2026-07-03", "2026-07-02 00:00:00").status == "unchanged"
    state = spark.read.parquet(path + "/state/gen=3/rows")
    assert [(r["entity_key"], str(r["gone_at"])) for r in departures(state).collect()] == [("openai:o3", "2026-07-02 00:00:00")]
    assert refresh(spark, _catalog(spark, "2026-07-04 00:00:00", "gpt-4o", "o3"), path, "2026-07-04", "2026-07-04 00:00:00").status == "published"
    assert _keys(spark, path) == (["openai:gpt-4o", "openai:o3"], "2026-07-04")
    # a refused body is no complete list: nothing leaves
    bad = _catalog(spark, "2026-07-05 00:00:00", "gpt-4o").withColumn("body", F.when(F.col("source_id") == "models.dev", "{").otherwise(F.col("body")))
    refresh(spark, bad, path, "2026-07-05", "2026-07-05 00:00:00")
    assert spark.read.parquet(path + "/state/gen=5/rows").filter("gone_at is not null").count() == 0


def test_a_publisher_that_dies_leaves_the_old_snapshot(spark, tmp_dir, monkeypatch):
    import pytest
    from driftgate.sources import manifest, snapshots
    path = tmp_dir + "/reg"
    refresh(spark, _catalog(spark, "2026-07-01 00:00:00", "gpt-4o"), path, "2026-07-01", "2026-07-01 00:00:00")

    def dies(*_):
        raise RuntimeError("lost")

    second = _catalog(spark, "2026-07-02 00:00:00", "gpt-4o", "o3")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(snapshots, "commit", dies)  # the same date again: records written, manifest not
        refresh(spark, second, path, "2026-07-01", "2026-07-02 00:00:00")
    assert _keys(spark, path) == (["openai:gpt-4o"], "2026-07-01")
    assert refresh(spark, second, path, "2026-07-01", "2026-07-02 00:00:00").status == "published"
    assert _keys(spark, path) == (["openai:gpt-4o", "openai:o3"], "2026-07-01")
    assert manifest.vacuum(spark, path) == 2 and _keys(spark, path)[0] == ["openai:gpt-4o", "openai:o3"]


def test_refresh_makes_its_landing_once_and_leaves_bodies_where_they_lie(spark, tmp_dir):
    from driftgate.sources.generations import newest_bodies
    made = spark.sparkContext.accumulator(0)

    def count(body):
        made.add(1)
        return body
    rows = [("models.dev", json.dumps(CATALOG)), ("deprecations.info", json.dumps(FEED)), ("official-provider", json.dumps(PACK))]
    counted = landing(spark, rows).withColumn("body", F.udf(count, "string").asNondeterministic()("body"))
    assert refresh(spark, counted, f"{tmp_dir}/reg_once", "2026-07-24", "2026-07-24 00:00:00").status == "published"
    assert made.value == len(rows)
    _, newest = newest_bodies(spark, f"{tmp_dir}/reg_none", landing(spark, rows))
    assert "hashpartitioning(source_id" not in newest._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_hashed_before_their_items_are_taken_apart(spark):
    for parse, source, body in ((feeds.parse_catalog, "models.dev", CATALOG), (feeds.parse_feed, "deprecations.info", FEED)):
        plan = parse(landing(spark, [(source, json.dumps(body))]).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2(" in plan and plan.index("sha2(") > plan.rindex("Generate posexplode"), plan

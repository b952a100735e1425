"""Documents as pieces, report order, validation, occurrences, lock headers."""

import json

from helpers import SF001
from pyspark.sql import functions as F

from driftgate.operators import documents as DOC
from driftgate.plans import bindings as B
from driftgate.plans import drift


def whole(pieces):
    """Each scope's document: its pieces' texts in order."""
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.scope, r.part, r.piece)):
        out[r.scope] = out.get(r.scope, "") + r.text
    return out


def test_documents_are_valid_and_whole(spark, monkeypatch):
    monkeypatch.setattr(DOC, "PIECE", 7)  # many pieces
    run = drift.run(spark, SF001)
    findings = DOC.ordered_findings(run.findings).persist()
    rows = {}
    for r in sorted(findings.collect(), key=lambda r: (r.scope, r.position)):
        rows.setdefault(r.scope, []).append(r)
    sarif = {k: json.loads(v) for k, v in whole(DOC.sarif_document(findings, run.gate, "tool", "1.2")).items()}
    assert len(sarif) == 20
    for scope, doc in sarif.items():
        results = doc["runs"][0]["results"]
        assert doc["version"] == "2.1.0" and [r["ruleId"] for r in results] == [f.code for f in rows.get(scope, [])]
        rules = doc["runs"][0]["tool"]["driver"]["rules"]
        seen = list(dict.fromkeys(f.code for f in rows.get(scope, [])))
        assert [r["id"] for r in rules] == seen  # in the order of first appearance
        assert all(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == f.path for r, f in zip(results, rows.get(scope, [])) if f.path)
    diffs = DOC.ordered_by_key(run.fdiff, "entity_key", "field_ord")
    for scope, text in whole(DOC.json_document(findings, diffs, run.gate, ["a \"quoted\" warning"])).items():
        doc = json.loads(text)
        assert [f["message"] for f in doc["findings"]] == [f.message for f in rows.get(scope, [])]
        assert doc["warnings"] == ['a "quoted" warning'] and len(doc["diffs"]) == 12 * 10 and doc["exitCode"] in (0, 1)


def test_a_scope_without_findings_has_a_document(spark):
    none = spark.createDataFrame([], "scope string, key string, field string, field_ord int, severity string, code string, message string, path string, "
                                     "line int, confidence string, position long")
    gate = spark.createDataFrame([("quiet", 0, 0, 0)], "scope string, n_fail long, n_warn long, exit_code int")
    doc = json.loads(whole(DOC.sarif_document(none, gate, "tool", "1"))["quiet"])
    assert doc["runs"][0]["results"] == [] == doc["runs"][0]["tool"]["driver"]["rules"]


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("scope"),
                                  F.concat(F.when(F.col("id") % 2 == 0, "K").otherwise("k"), ((F.col("id") * 7919) % 5000).cast("string")).alias("entity_key"), "id")
    got = DOC.ordered_by_key(df.repartition(7), "entity_key", "id").collect()
    for scope in ("s0", "s1", "s2"):
        rows = sorted((r for r in got if r.scope == scope), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
        fold = [r.entity_key.lower() for r in rows]
        assert fold == sorted(fold)  # letters first by letter, whatever their case
    assert DOC.ordered_by_key(df.limit(0), "entity_key").count() == 0


def test_occurrences_round_trip_and_strangers(spark, tmp_dir):
    from driftgate.operators import discovery as D
    from driftgate.operators import occurrences as O
    from driftgate.operators.lock import lock_records
    from driftgate.operators.policy import effective_policy
    from driftgate.sources.lockio import lock_lines, lock_records_from_lines, read_lock, write_lock
    lines = B.code_lines(spark, SF001)
    hits = D.scan_python(lines.filter(F.col("path").endswith(".py"))).persist()
    deps = D.consolidate(hits).withColumn("discovery_confidence", F.col("confidence"))
    blocks = O.occurrence_blocks(hits)
    records = O.with_occurrences(lock_records(deps, drift.approved_wide(spark, SF001), B.APPROVED_AS_OF), blocks)
    write_lock(lock_lines(records, B.APPROVED_AS_OF, effective_policy(deps), "digest-of-registry"), tmp_dir + "/lines")
    good, rejects = read_lock(spark.read.text(tmp_dir + "/lines"))
    assert rejects.count() == 0
    first = good.first()
    assert first.registryDigest == "digest-of-registry" and len(first.configDigest) == 64 and first.generatorVersion and first.nOccurrences > 0
    lock = lock_records_from_lines(good).persist()
    O.write_occurrences(blocks, lock, tmp_dir)
    back, strangers = O.read_occurrences(spark, lock, tmp_dir)
    assert O.flat_occurrences(back).count() == hits.count() and strangers.count() == 0
    assert lock.agg(F.sum("n_occurrences")).first()[0] == hits.count()
    # another lock's occurrences, and a dependency that has none, are told
    changed = hits.withColumn("line", F.when(F.col("model_id") == "gpt-4o", F.col("line") + 1).otherwise(F.col("line")))
    O.write_occurrences(O.occurrence_blocks(changed.filter("model_id != 'grok-3'")), lock, tmp_dir)
    _, strangers = O.read_occurrences(spark, lock, tmp_dir)
    assert {r.entity_key.split(":")[1] for r in strangers.collect()} == {"gpt-4o", "grok-3"}


def test_lock_lines_of_wrong_types(spark):
    from driftgate.sources.lockio import read_lock
    line = {"lockfileVersion": 1, "scope": "r", "key": "openai:m", "provider": "openai", "modelId": "m", "identifierKind": "fixed"}
    wrong = [{"path": 5}, {"line": "3"}, {"lowConfidence": "no"}, {"facts": []}, {"discoveryConfidence": "0.5"}, {"generatedAt": {}}, {"evidence": "x"}]
    right = [{}, {"path": None, "line": 3, "lowConfidence": False, "discoveryConfidence": 1, "evidence": []}]
    good, rejects = read_lock(spark.createDataFrame([(json.dumps({**line, **w}),) for w in [*wrong, *right]], "value string"))
    assert good.count() == len(right) and rejects.count() == len(wrong)


def test_constraints_reject_the_row_and_name_the_reason(spark):
    from driftgate.operators.policy import effective_policy
    from driftgate.operators.validate import input_status, rejects
    policy = effective_policy(spark.createDataFrame([("a",), ("b",)], "scope string"))
    assert rejects(policy, "policy").count() == 0 and {r.status for r in input_status({"policy": policy}).collect()} == {"OK"}
    bad = policy.withColumn("timeout_ms", F.when(F.col("scope") == "b", 0).otherwise(F.col("timeout_ms"))).withColumn(
        "floating_aliases", F.when(F.col("scope") == "b", F.lit(None)).otherwise(F.col("floating_aliases")))
    assert {(r.row_key, r.reason) for r in rejects(bad, "policy").collect()} == {("b", "source-limits"), ("b", "floating-aliases")}
    assert {r.status for r in input_status({"policy": bad}).collect()} == {"invalid"}
    assert {r.status for r in input_status({"policy": policy.limit(0)}).collect()} == {"OK"}


def test_check_writes_documents(spark, tmp_dir):
    from driftgate.operators.lock import lock_records
    from driftgate.operators.policy import effective_policy
    from driftgate.plans.check import run_check
    deps = B.dependencies(spark, SF001)
    records = lock_records(deps, drift.approved_wide(spark, SF001), B.APPROVED_AS_OF)
    run_check(spark, records, drift.current_wide(spark, SF001), effective_policy(deps), B.CURRENT_AS_OF, tmp_dir, documents=True)
    docs = {k: json.loads(v) for k, v in whole(spark.read.parquet(tmp_dir + "/sarif")).items()}
    found = {r["scope"]: r["count"] for r in spark.read.parquet(tmp_dir + "/findings").groupBy("scope").count().collect()}
    assert {k: len(d["runs"][0]["results"]) for k, d in docs.items()} == {k: found.get(k, 0) for k in docs} and len(docs) == 20

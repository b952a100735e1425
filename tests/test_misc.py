"""F7 exclude, J3 overrides, U1/U2, X9 canonical JSON, O1 ordering, A10/T2 report rows."""

import json

from pyspark.sql import functions as F

from driftgate.functions.jsontext import canonical_json, json_ok
from driftgate.operators.lock import exclude, lock_keys_change, merge_warnings, overrides
from driftgate.operators.reports import ordered, sarif_results, sarif_rules

DEP_SCHEMA = ("scope string, entity_key string, provider string, model_id string, identifier_kind string, "
              "discovery_confidence double, low_confidence boolean, path string, line int")


def test_exclude_and_overrides(spark):
    deps = spark.createDataFrame([("r", "openai:gpt-4o", "openai", "gpt-4o", "floating", 0.9, False, "a.py", 2),
                                  ("r", "xai:grok-3", "xai", "grok-3", "floating", 0.7, False, "b.py", 1)], DEP_SCHEMA)
    kept = exclude(deps, spark.createDataFrame([("r", "xai:grok-3")], "scope string, entity_key string"))
    assert [r["entity_key"] for r in kept.collect()] == ["openai:gpt-4o"]
    pins = spark.createDataFrame([("r", "openai", "gpt-4o"), ("r", "anthropic", "claude-opus-4-0")],
                                 "scope string, provider string, model_id string")
    inc = spark.createDataFrame([("r", "anthropic:claude-opus-4-0"), ("r", "google:gemini-2.5-pro"), ("r", "bad")],
                                "scope string, key string")
    out = {r["entity_key"]: r for r in overrides(kept, pins, inc).collect()}
    assert set(out) == {"openai:gpt-4o", "anthropic:claude-opus-4-0", "google:gemini-2.5-pro"}
    assert out["openai:gpt-4o"]["discovery_confidence"] == 0.9  # already discovered: not overridden
    o = out["google:gemini-2.5-pro"]
    assert (o["discovery_confidence"], o["path"], o["line"], o["low_confidence"]) == (1.0, ".llm-lock.yml", 1, False)


def test_key_changes_and_warning_union(spark):
    a = spark.createDataFrame([("r", "k1"), ("r", "k2")], "scope string, entity_key string")
    b = spark.createDataFrame([("r", "k2"), ("r", "k3")], "scope string, entity_key string")
    ch = {(r["entity_key"], r["change"]) for r in lock_keys_change(a, b).collect()}
    assert ch == {("k3", "added"), ("k1", "removed")}
    w = spark.createDataFrame([(["x", "y"], ["y", "z"])], "a array<string>, b array<string>")
    assert w.select(merge_warnings(F.col("a"), F.col("b")).alias("m")).collect()[0]["m"] == ["x", "y", "z"]


def test_canonical_json_sorted_keys_and_nulls(spark):
    df = spark.createDataFrame([("v", None, 1)], "zeta string, alpha string, mid int")
    s = df.select(canonical_json("zeta", "alpha", "mid").alias("j")).collect()[0]["j"]
    assert s == '{"alpha":null,"mid":1,"zeta":"v"}' and list(json.loads(s)) == ["alpha", "mid", "zeta"]
    ok = spark.createDataFrame([("[1]",), ("{}",), ("{} x",), ("",)], "b string").select(json_ok("b")).collect()
    assert [r[0] for r in ok] == [True, True, False, False]


def test_report_order_and_sarif(spark):
    f = spark.createDataFrame([
        ("r", "b:2", "contextLimit", 7, "fail", "context-decrease", "Context limit decreased", None, None, "official-verified"),
        ("r", "a:1", "vision", 11, "warn", "conflicting-fact", "Conflicting data for a:1.vision; not blocking", "x\\y.py", None, "conflicting"),
        ("r", "a:1", "toolCalling", 9, "warn", "conflicting-fact", "Conflicting data for a:1.toolCalling; not blocking", "x\\y.py", 4, "conflicting"),
    ], "scope string, key string, field string, field_ord int, severity string, code string, message string, "
       "path string, line int, confidence string")
    keys = [(r["key"], r["field"]) for r in ordered(f, "scope", "key", "code", "field_ord").collect()]
    assert keys == [("a:1", "toolCalling"), ("a:1", "vision"), ("b:2", "contextLimit")]
    res = {(r["rule_id"], r["start_line"]): r for r in sarif_results(f).collect()}
    assert res[("conflicting-fact", 1)]["uri"] == "x/y.py" and res[("context-decrease", None)]["level"] == "error"
    rules = {r["rule_id"]: r["full_description"] for r in sarif_rules(f).collect()}
    assert rules["conflicting-fact"] == "Conflicting data for a:1.toolCalling; not blocking"


def test_config_digest_tracks_effective_settings(spark):
    from driftgate.operators.policy import effective_policy
    scopes = spark.createDataFrame([("a",), ("b",), ("c",)], "scope string")
    ov = spark.createDataFrame([("b", 90, None), ("c", 30, None)],
                               "scope string, retirement_window_days int, floating_aliases string")
    d = {r["scope"]: r["config_digest"] for r in effective_policy(scopes, ov).collect()}
    assert d["a"] == d["b"]          # an override equal to the default changes nothing
    assert d["a"] != d["c"] and len(d["a"]) == 64

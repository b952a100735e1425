"""Policy rules (P1-P14, A9) on small two-snapshot fixtures."""

import pytest
from helpers import obs_df, obs_row

from driftgate.operators.diff import field_diff, model_diff
from driftgate.operators.lock import build_lock
from driftgate.operators.policy import effective_policy, evaluate, gate
from driftgate.operators.reconcile import reconcile_wide as reconcile

A_AT, A_SEEN = "2026-01-10 00:00:00", "2026-01-09T00:00:00"
C_AT, C_SEEN = "2026-07-24 00:00:00", "2026-07-23T00:00:00"
SOURCES = {"official": ["official-provider"], "multi": ["models.dev", "deprecations.info"], "single": ["models.dev"]}


def run(spark, before: dict, after: dict, support="official", model="gpt-4o-2024-08-06", overrides=None,
        frozen=False, warnings=None, low=False, after_support=None):
    a_rows = [obs_row("openai", model, s, A_SEEN, **before) for s in SOURCES[support]]
    c_rows = [obs_row("openai", model, s, C_SEEN, **after) for s in SOURCES[after_support or support]]
    key = f"openai:{model}"
    deps = spark.createDataFrame(
        [("repo-1", key, "openai", model, "fixed" if model[-1].isdigit() else "floating", 0.9, low, "src/app.ts", 3)],
        "scope string, entity_key string, provider string, model_id string, identifier_kind string, "
        "discovery_confidence double, low_confidence boolean, path string, line int")
    lock = build_lock(deps, reconcile(obs_df(spark, a_rows), A_AT, 7), A_AT)
    current = reconcile(obs_df(spark, c_rows), C_AT, 7) if after is not None else \
        reconcile(obs_df(spark, c_rows), C_AT, 7).limit(0)
    fd = field_diff(lock, current)
    pol = effective_policy(deps, overrides(spark) if overrides else None)
    f = evaluate(fd, pol, C_AT, frozen=frozen, warnings=warnings)
    return {(r["code"], r["field"]): r for r in f.collect()}, gate(f, pol).collect()[0], fd


def test_price_rise_fails_with_official_confidence(spark):
    f, g, _ = run(spark, {"input_price": 2.5}, {"input_price": 5.0})
    r = f[("input-price-increase", "inputPricePerMillion")]
    assert r["severity"] == "fail" and r["message"] == "Input price increased 100.0% (max 15%)"
    assert r["path"] == "src/app.ts" and r["line"] == 3 and r["confidence"] == "official-verified"
    assert g["exit_code"] == 1 and g["n_fail"] == 1


@pytest.mark.parametrize("support", ["multi", "single"])
def test_weaker_confidence_only_warns(spark, support):
    f, g, _ = run(spark, {"input_price": 2.5}, {"input_price": 5.0}, support=support)
    assert f[("input-price-increase", "inputPricePerMillion")]["severity"] == "warn"
    assert g["exit_code"] == 0


def test_lower_blocking_floor_lets_single_source_fail(spark):
    ov = lambda s: s.createDataFrame([("repo-1", "single-source")], "scope string, min_blocking_confidence string")
    f, _, _ = run(spark, {"input_price": 2.5}, {"input_price": 5.0}, support="single", overrides=ov)
    assert f[("input-price-increase", "inputPricePerMillion")]["severity"] == "fail"


@pytest.mark.parametrize("after,fires", [(115.0, False), (114.9, False), (115.1, True)])
def test_price_threshold_is_strictly_greater(spark, after, fires):
    f, _, _ = run(spark, {"input_price": 100.0}, {"input_price": after})
    assert (("input-price-increase", "inputPricePerMillion") in f) == fires


def test_conflict_never_blocks(spark):
    a_rows = [obs_row("openai", "gpt-4o-2024-08-06", "official-provider", A_SEEN, input_price=2.5)]
    c_rows = [obs_row("openai", "gpt-4o-2024-08-06", "official-provider", C_SEEN, input_price=9.99),
              obs_row("openai", "gpt-4o-2024-08-06", "models.dev", C_SEEN, input_price=2.5)]
    deps = spark.createDataFrame([("r", "openai:gpt-4o-2024-08-06", "openai", "gpt-4o-2024-08-06", "fixed", 0.9,
                                   False, "a.ts", 1)],
                                 "scope string, entity_key string, provider string, model_id string, "
                                 "identifier_kind string, discovery_confidence double, low_confidence boolean, "
                                 "path string, line int")
    fd = field_diff(build_lock(deps, reconcile(obs_df(spark, a_rows), A_AT, 7), A_AT),
                    reconcile(obs_df(spark, c_rows), C_AT, 7))
    pol = effective_policy(deps)
    f = evaluate(fd, pol, C_AT).collect()
    codes = {(r["code"], r["severity"]) for r in f}
    assert ("conflicting-fact", "warn") in codes and not any(s == "fail" for _, s in codes)


@pytest.mark.parametrize("mode,expected", [("warn", "warn"), ("deny", "fail"), ("allow", None)])
def test_floating_alias(spark, mode, expected):
    ov = lambda s: s.createDataFrame([("repo-1", mode)], "scope string, floating_aliases string")
    f, _, _ = run(spark, {"input_price": 2.5}, {"input_price": 2.5}, model="gpt-4o", overrides=ov)
    got = f.get(("floating-alias", "identifierKind"))
    assert (got["severity"] if got else None) == expected


@pytest.mark.parametrize("behavior,expected", [("warn", "warn"), ("fail", "fail"), ("ignore", None)])
def test_frozen_snapshot_stale_source(spark, behavior, expected):
    ov = lambda s: s.createDataFrame([("repo-1", behavior)], "scope string, stale_source_behavior string")
    f, g, _ = run(spark, {"input_price": 2.5}, {"input_price": 2.5}, overrides=ov, frozen=True)
    got = f.get(("stale-source", "registry"))
    assert (got["severity"] if got else None) == expected
    if got:
        assert got["key"] == "*" and got["confidence"] == "stale"


def test_capability_removals_and_switches(spark):
    before = {"tool_calling": True, "structured_output": True, "vision": True, "context_limit": 128000,
              "max_output_limit": 8192, "lifecycle_status": "active"}
    after = {"tool_calling": False, "structured_output": False, "vision": False, "context_limit": 64000,
             "max_output_limit": 4096, "lifecycle_status": "deprecated"}
    f, _, _ = run(spark, before, after)
    assert f[("tool-calling-removal", "toolCalling")]["severity"] == "fail"
    assert f[("structured-output-removal", "structuredOutput")]["severity"] == "fail"
    assert ("vision-removal", "vision") not in f  # off by default
    assert f[("context-decrease", "contextLimit")]["message"] == "Context limit decreased from 128000 to 64000"
    assert f[("max-output-decrease", "maxOutputLimit")]["message"] == "Max output decreased from 8192 to 4096"
    assert f[("lifecycle-regression", "lifecycleStatus")]["message"] == "Lifecycle changed from active to deprecated"
    ov = lambda s: s.createDataFrame([("repo-1", True)], "scope string, fail_on_vision_removal boolean")
    f2, _, _ = run(spark, before, after, overrides=ov)
    assert f2[("vision-removal", "vision")]["severity"] == "fail"


def test_null_to_false_is_not_a_removal(spark):
    f, _, _ = run(spark, {"tool_calling": None}, {"tool_calling": False})
    assert ("tool-calling-removal", "toolCalling") not in f


@pytest.mark.parametrize("date,fires", [("2026-10-22", True), ("2026-10-23", False), ("2025-01-01", True),
                                        ("soon", False)])
def test_retirement_window_inclusive(spark, date, fires):
    # 2026-07-24 + 90 days = 2026-10-22
    f, _, _ = run(spark, {"retirement_date": date}, {"retirement_date": date})
    assert (("retirement-window", "retirementDate") in f) == fires


def test_low_confidence_and_missing_entity(spark):
    f, _, fd = run(spark, {"input_price": 2.5}, {"input_price": 2.5}, low=True)
    assert f[("low-confidence-discovery", "discovery")]["severity"] == "warn"
    # entity gone from the current snapshot: unknown diffs, no price findings
    a_rows = [obs_row("openai", "gpt-4o-2024-08-06", "official-provider", A_SEEN, input_price=2.5)]
    deps = fd.select("scope", "entity_key", "provider", "model_id", "identifier_kind", "discovery_confidence",
                     "low_confidence", "path", "line").distinct()
    lock = build_lock(deps, reconcile(obs_df(spark, a_rows), A_AT, 7), A_AT)
    empty = reconcile(obs_df(spark, a_rows), C_AT, 7).limit(0)
    gone = field_diff(lock, empty)
    kinds = {r["kind"] for r in gone.collect()}
    assert kinds == {"unknown"}
    assert model_diff(gone).collect()[0]["kind"] == "changed"


def test_self_diff_has_no_changes(spark):
    same = {"input_price": 2.5, "tool_calling": True, "identifier_kind": "fixed"}
    _, _, fd = run(spark, same, same)
    assert {r["kind"] for r in fd.collect()} == {"unchanged"}
    # without a registry value, the lock's discovered identifier kind reads as a change
    _, _, fd2 = run(spark, {"input_price": 2.5}, {"input_price": 2.5})
    assert {r["field"] for r in fd2.collect() if r["kind"] == "changed"} == {"identifierKind"}


def test_pinned_diff_counts_sf0001(spark):
    """FIXTURES B2: input-price diffs between the 2001-03-01 and 2001-11-05 snapshots over
    all parts: changed 57 / conflicting 25 / unchanged 118 at sf0.001."""
    from helpers import SF001
    from driftgate.plans import bindings as B
    a = reconcile(B.observations(spark, SF001, B.APPROVED_AS_OF), B.APPROVED_AS_OF, B.STALE_AFTER_DAYS)
    c = reconcile(B.observations(spark, SF001, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)
    deps = B.dependencies(spark, SF001, exclude_mod=None)
    fd = field_diff(build_lock(deps, a, B.APPROVED_AS_OF), c).filter("field = 'inputPricePerMillion'")
    assert {r["kind"]: r["count"] for r in fd.groupBy("kind").count().collect()} == \
        {"changed": 57, "conflicting": 25, "unchanged": 118}

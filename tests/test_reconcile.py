"""Reconciliation (A1-A8): reference fixture outcomes, staleness, tolerance, order."""

from helpers import obs_df, obs_row

from driftgate.operators.reconcile import latest_per_source, reconcile, source_status, to_snapshot

NOW = "2026-07-24 00:00:00"
FRESH = "2026-07-23T00:00:00"
OLD = "2026-01-01T00:00:00"


def facts(spark, rows, stale=7):
    f = reconcile(obs_df(spark, rows), NOW, stale).collect()
    return {(r["entity_key"], r["field"]): r for r in f}


def test_reference_fixture_outcomes(spark):
    rows = [
        # catalog: no status -> lifecycle value 'unknown'; pack says active
        obs_row("openai", "gpt-4o", "models.dev", FRESH, lifecycle_status="unknown", input_price=2.5),
        obs_row("openai", "gpt-4o", "official-provider", FRESH, lifecycle_status="active", input_price=2.5),
        obs_row("openai", "gpt-3.5-turbo", "models.dev", FRESH, lifecycle_status="deprecated"),
        obs_row("openai", "gpt-3.5-turbo", "deprecations.info", FRESH, lifecycle_status="deprecated",
                retirement_date="2026-09-01"),
        obs_row("openai", "gpt-3.5-turbo", "official-provider", FRESH, lifecycle_status="deprecated",
                retirement_date="2026-09-01"),
        obs_row("xai", "grok-3", "models.dev", FRESH, vision=False),
        obs_row("xai", "grok-3", "official-provider", FRESH, vision=False),
    ]
    f = facts(spark, rows)
    assert f[("openai:gpt-4o", "inputPricePerMillion")]["confidence"] == "official-verified"
    assert f[("openai:gpt-4o", "inputPricePerMillion")]["num_value"] == 2.5
    life = f[("openai:gpt-4o", "lifecycleStatus")]
    assert life["confidence"] == "conflicting" and life["str_value"] is None
    assert [c["str_value"] for c in life["candidates"]] == ["unknown", "active"]
    assert f[("openai:gpt-3.5-turbo", "lifecycleStatus")]["confidence"] == "official-verified"
    assert f[("openai:gpt-3.5-turbo", "retirementDate")]["confidence"] == "official-verified"
    assert f[("openai:gpt-3.5-turbo", "retirementDate")]["str_value"] == "2026-09-01"
    assert f[("xai:grok-3", "vision")]["confidence"] == "official-verified"
    assert f[("xai:grok-3", "vision")]["bool_value"] is False
    # identity facts
    assert f[("openai:gpt-4o", "provider")]["confidence"] == "multi-source-verified"
    assert f[("openai:gpt-4o", "requestedModelId")]["confidence"] == "single-source"
    # a field nobody reports
    assert f[("openai:gpt-4o", "contextLimit")]["confidence"] == "unavailable"
    assert f[("openai:gpt-4o", "contextLimit")]["source_id"] == "models.dev"


def test_conflicting_price_and_agreement(spark):
    rows = [
        obs_row("openai", "gpt-4o", "models.dev", FRESH, input_price=2.5),
        obs_row("openai", "gpt-4o", "official-provider", FRESH, input_price=9.99),
        obs_row("google", "gemini-2.5-pro", "models.dev", FRESH, input_price=1.25),
        obs_row("google", "gemini-2.5-pro", "deprecations.info", FRESH, input_price=1.25 + 1e-12),
        obs_row("xai", "grok-3", "models.dev", FRESH, input_price=3.0),
    ]
    f = facts(spark, rows)
    c = f[("openai:gpt-4o", "inputPricePerMillion")]
    assert c["confidence"] == "conflicting" and c["num_value"] is None and c["source_id"] == "models.dev"
    m = f[("google:gemini-2.5-pro", "inputPricePerMillion")]
    assert m["confidence"] == "multi-source-verified" and abs(m["num_value"] - 1.25) < 1e-9
    assert f[("xai:grok-3", "inputPricePerMillion")]["confidence"] == "single-source"


def test_staleness(spark):
    rows = [
        # all stale and agreeing -> stale, value kept
        obs_row("openai", "o3", "models.dev", OLD, input_price=10.0),
        obs_row("openai", "o3", "official-provider", OLD, input_price=10.0),
        # only stale rows that disagree -> conflicting (before the stale test)
        obs_row("openai", "o1", "models.dev", OLD, input_price=15.0),
        obs_row("openai", "o1", "official-provider", OLD, input_price=16.0),
        # a fresh row exists: the disagreeing stale row is ignored
        obs_row("openai", "gpt-5", "models.dev", OLD, input_price=99.0),
        obs_row("openai", "gpt-5", "official-provider", FRESH, input_price=1.25),
    ]
    f = facts(spark, rows)
    assert f[("openai:o3", "inputPricePerMillion")]["confidence"] == "stale"
    assert f[("openai:o3", "inputPricePerMillion")]["num_value"] == 10.0
    assert f[("openai:o1", "inputPricePerMillion")]["confidence"] == "conflicting"
    g = f[("openai:gpt-5", "inputPricePerMillion")]
    assert g["confidence"] == "official-verified" and g["num_value"] == 1.25
    assert g["source_id"] == "official-provider"


def test_last_record_per_source_wins(spark):
    rows = [
        obs_row("openai", "gpt-4o", "models.dev", FRESH, seq=1, input_price=2.5),
        obs_row("openai", "gpt-4o", "models.dev", FRESH, seq=2, input_price=5.0),
        obs_row("openai", "gpt-4o", "official-provider", FRESH, seq=0, input_price=5.0),
    ]
    f = facts(spark, rows)
    assert f[("openai:gpt-4o", "inputPricePerMillion")]["confidence"] == "official-verified"
    assert f[("openai:gpt-4o", "inputPricePerMillion")]["num_value"] == 5.0


def test_row_order_does_not_change_classes(spark):
    rows = [obs_row("openai", f"gpt-{i % 7}", s, FRESH if i % 3 else OLD, seq=i, input_price=float(i % 2))
            for i, s in enumerate(["models.dev", "deprecations.info", "official-provider"] * 7)]
    a = reconcile(obs_df(spark, rows), NOW, 7).select("entity_key", "field", "confidence")
    b = reconcile(obs_df(spark, list(reversed(rows))).repartition(3), NOW, 7).select("entity_key", "field", "confidence")
    assert sorted(a.collect()) == sorted(b.collect())


def test_pinned_class_counts_sf0001(spark):
    from helpers import SF001
    from driftgate.plans import bindings as B
    f = reconcile(B.observations(spark, SF001, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)
    got = {r["confidence"]: r["count"] for r in
           f.filter("field = 'inputPricePerMillion'").groupBy("confidence").count().collect()}
    assert got == {"official-verified": 73, "multi-source-verified": 14, "single-source": 48,
                   "conflicting": 25, "stale": 24, "unavailable": 16}


def test_snapshot_record_and_evidence(spark):
    rows = [obs_row("openai", "gpt-4o", "official-provider", FRESH, input_price=2.5),
            obs_row("openai", "gpt-4o", "models.dev", FRESH, input_price=2.5)]
    latest = latest_per_source(obs_df(spark, rows))
    snap = to_snapshot(latest, NOW, 7).collect()[0]
    assert [e["source_id"] for e in snap["evidence"]] == ["models.dev", "official-provider"]
    assert snap["facts"]["inputPricePerMillion"]["confidence"] == "official-verified"
    assert snap["facts"]["provider"]["str_value"] == "openai"


def test_source_status_modes(spark):
    def mode(rows):
        df = spark.createDataFrame(rows, "source_id string, ok boolean, warning string")
        return source_status(df).collect()[0]["mode"]
    assert mode([("a", True, None), ("b", True, None)]) == "fresh"
    assert mode([("a", True, None), ("b", False, "b failed")]) == "partial"
    assert mode([("a", False, "x"), ("b", False, "y")]) == "frozen"

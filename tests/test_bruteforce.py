"""A2: a table of cases written out by hand, and a property on random fixtures."""

import datetime as dt
import random

from helpers import obs_df, obs_row

from driftgate.operators.reconcile import reconcile

NOW = dt.datetime(2026, 7, 24)
STALE_DAYS = 7
ORDER = ["models.dev", "deprecations.info", "official-provider"]


C, D, O = ORDER  # catalog, deprecation feed, official pack
FRESH, OLD = 1, 30  # age in days
# One field of one entity: observations (source, age, value), then the class, the value that is
# shown and the source that it is ascribed to, from the rules of SURVEY section 2.13.
CASES = [
    ([(C, FRESH, None)], "unavailable", None, C),
    ([(D, FRESH, None), (O, OLD, None)], "unavailable", None, D),
    ([(C, FRESH, 1.0)], "single-source", 1.0, C),
    ([(D, FRESH, 1.0)], "single-source", 1.0, D),
    ([(O, FRESH, 1.0)], "official-verified", 1.0, O),
    ([(C, FRESH, 1.0), (D, FRESH, 1.0)], "multi-source-verified", 1.0, C),
    ([(C, FRESH, 1.0), (O, FRESH, 1.0)], "official-verified", 1.0, C),
    ([(C, FRESH, 1.0), (D, FRESH, 1.0), (O, FRESH, 1.0)], "official-verified", 1.0, C),
    ([(C, FRESH, 1.0), (O, FRESH, 1.0 + 1e-12)], "official-verified", 1.0, C),
    ([(C, FRESH, 1.0), (O, FRESH, 2.0)], "conflicting", None, C),
    ([(C, FRESH, 1.0), (D, FRESH, 2.0), (O, FRESH, 1.0)], "conflicting", None, C),
    ([(C, FRESH, None), (D, FRESH, 2.0), (O, FRESH, 3.0)], "conflicting", None, D),
    ([(C, FRESH, None), (D, FRESH, 2.0)], "single-source", 2.0, D),
    ([(C, OLD, 1.0)], "stale", 1.0, C),
    ([(O, OLD, 1.0)], "stale", 1.0, O),
    ([(C, OLD, 1.0), (O, OLD, 1.0)], "stale", 1.0, C),
    ([(C, OLD, 1.0), (O, OLD, 2.0)], "conflicting", None, C),
    ([(C, OLD, 1.0), (O, FRESH, 2.0)], "official-verified", 2.0, O),
    ([(C, FRESH, 1.0), (O, OLD, 2.0)], "single-source", 1.0, C),
    ([(C, OLD, 5.0), (D, FRESH, 1.0), (O, FRESH, None)], "single-source", 1.0, D),
    ([(C, FRESH, 0.0), (D, FRESH, 0.0)], "multi-source-verified", 0.0, C),
]


def test_confidence_cases(spark):
    """Every case as a price and, with words for numbers, as a lifecycle status."""
    words = {0.0: "active", 1.0: "active", 1.0 + 1e-12: "active", 2.0: "deprecated", 3.0: "retired", 5.0: "retired"}
    rows = []
    for k, (seen, *_) in enumerate(CASES):
        for source, age, value in seen:
            at = (NOW - dt.timedelta(days=age)).isoformat()
            rows.append(obs_row("openai", f"m-{k}", source, at, seq=1, input_price=value, lifecycle_status=words.get(value)))
            # An earlier record of the source, which must not count.
            rows.append(obs_row("openai", f"m-{k}", source, at, seq=0, input_price=99.0, lifecycle_status="preview"))
    got = {(r["entity_key"], r["field"]): r for r in reconcile(obs_df(spark, rows).repartition(3), "2026-07-24 00:00:00", STALE_DAYS).collect()}
    for k, (seen, confidence, value, source) in enumerate(CASES):
        price, state = got[f"openai:m-{k}", "inputPricePerMillion"], got[f"openai:m-{k}", "lifecycleStatus"]
        assert (price["confidence"], price["num_value"], price["source_id"]) == (confidence, value, source), seen
        assert (state["confidence"], state["str_value"], state["source_id"]) == (confidence, words.get(value), source), seen


def test_source_order_permutation_keeps_classes(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(11)
    rows = []
    for e in range(200):
        for s in ORDER:
            if rnd.random() < 0.75:
                fetched = NOW - dt.timedelta(days=rnd.choice([1, 3, 10]))
                rows.append(obs_row("xai", f"g-{e}", s, fetched.isoformat(),
                                    input_price=rnd.choice([1.0, 2.0, None]),
                                    tool_calling=rnd.choice([True, False, None])))
    df = obs_df(spark, rows)
    a = reconcile(df, "2026-07-24 00:00:00", STALE_DAYS).select("entity_key", "field", "confidence")
    flipped = df.withColumn("source_ord", (F.lit(2) - F.col("source_ord")).cast("int"))
    b = reconcile(flipped, "2026-07-24 00:00:00", STALE_DAYS).select("entity_key", "field", "confidence")
    assert sorted(a.collect()) == sorted(b.collect())

"""Validation of all inputs by a table of constraints (S13): policy, lock and snapshot.

Each constraint is a name and a condition that a good row fulfils. A table's constraints are
tested in one pass; the rejects table has a row for every (row, broken constraint), and the
status of an input follows from its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.schemas import CONFIDENCE_ORDER, LIFECYCLE_STATES, PROVIDERS, SCHEMA_VERSION, SOURCE_OFFICIAL


def _in(c: str, values) -> Column:
    return F.col(c).isin(list(values))


def _least(c: str, low, whole: bool = False) -> Column:
    ok = F.col(c) >= low
    return ok & (F.col(c) == F.floor(c)) if whole else ok


def _text(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _maybe(c: str, ok: Column) -> Column:
    return F.col(c).isNull() | ok


def _key_fits() -> Column:
    return F.col("entity_key") == F.concat("provider", F.lit(":"), "model_id")


def _envelopes(test) -> Column:
    """Every envelope of the wide record's facts passes."""
    from driftgate.schemas import FACT_FIELDS
    return F.forall(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"facts.{n}").alias("e")) for n, _ in FACT_FIELDS]),
                    lambda x: F.coalesce(test(x["field"], x["e"]), F.lit(False)))


def _has_value(e: Column) -> Column:
    return e["str_value"].isNotNull() | e["num_value"].isNotNull() | e["bool_value"].isNotNull()


#: (input, key of a row, [(constraint, condition of a good row)]).
CONSTRAINTS: dict[str, tuple[str, list[tuple[str, object]]]] = {
    "policy": ("scope", [
        ("scope-missing", lambda: _text("scope")),
        ("floating-aliases", lambda: _in("floating_aliases", ("allow", "warn", "deny"))),
        ("stale-source-behavior", lambda: _in("stale_source_behavior", ("ignore", "warn", "fail"))),
        ("min-blocking-confidence", lambda: _in("min_blocking_confidence", CONFIDENCE_ORDER)),
        ("retirement-window-days", lambda: _least("retirement_window_days", 0, True)),
        ("price-increase-percent", lambda: _least("max_input_price_increase_percent", 0) & _least("max_output_price_increase_percent", 0)),
        ("source-limits", lambda: _least("stale_after_days", 1, True) & _least("timeout_ms", 1, True) & _least("max_bytes", 1, True)),
    ]),
    "lock": ("entity_key", [
        ("identity-missing", lambda: _text("scope") & _text("provider") & _text("model_id")),
        ("key-mismatch", _key_fits),
        ("provider", lambda: _in("provider", PROVIDERS)),
        ("identifier-kind", lambda: _in("identifier_kind", ("floating", "fixed"))),
        ("discovery-confidence", lambda: F.col("discovery_confidence").between(0, 1)),
        ("line", lambda: _maybe("line", F.col("line") >= 1)),
        ("fact-confidence", lambda: _envelopes(lambda f, e: e["confidence"].isin(CONFIDENCE_ORDER))),
    ]),
    "snapshot": ("entity_key", [
        ("key-mismatch", _key_fits),
        ("provider", lambda: _in("provider", PROVIDERS)),
        ("fact-confidence", lambda: _envelopes(lambda f, e: e["confidence"].isin(CONFIDENCE_ORDER))),
        ("price-negative", lambda: _envelopes(lambda f, e: ~f.isin("inputPricePerMillion", "outputPricePerMillion") | e["num_value"].isNull() | (e["num_value"] >= 0))),
        ("limit-not-non-negative-integer", lambda: _envelopes(lambda f, e: ~f.isin("contextLimit", "maxOutputLimit") | e["num_value"].isNull()
                                                              | ((e["num_value"] >= 0) & (e["num_value"] == F.floor(e["num_value"]))))),
        ("lifecycle", lambda: _maybe("facts.lifecycleStatus.str_value", _in("facts.lifecycleStatus.str_value", LIFECYCLE_STATES))),
        ("conflicting-with-value", lambda: _envelopes(lambda f, e: (e["confidence"] != "conflicting") | ~_has_value(e))),
        ("official-without-official-evidence", lambda: _envelopes(lambda f, e: (e["confidence"] != "official-verified")
                                                                  | F.exists("evidence", lambda v: v["source_id"] == SOURCE_OFFICIAL))),
    ]),
    "snapshot_meta": ("snapshot_date", [
        ("schema-version", lambda: F.col("schema_version") == SCHEMA_VERSION),
        ("generated-at", lambda: F.col("generated_at").isNotNull() & F.expr("try_to_timestamp(generated_at)").isNotNull()),
        ("freeze-reason", lambda: ~F.col("frozen") | F.col("freeze_reason").isNotNull()),
    ]),
}


def rejects(df: DataFrame, name: str) -> DataFrame:
    """(input, row_key, reason): one row for every constraint of ``name`` that a row breaks."""
    key, tests = CONSTRAINTS[name]
    broken = F.array(*[F.when(~F.coalesce(test(), F.lit(False)), F.lit(reason)) for reason, test in tests])
    return df.select(F.lit(name).alias("input"), F.col(key).cast("string").alias("row_key"),
                     F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("reason"))


def input_status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for every input and reason, none left out, with the number of rows that break
    it, and the input's ``status``: OK, or invalid if any row breaks any. One partial aggregate
    over each table."""
    out = None
    for name, df in tables.items():
        _, tests = CONSTRAINTS[name]
        counts = df.agg(*[F.count(F.when(~F.coalesce(test(), F.lit(False)), 1)).alias(f"c{i}") for i, (_, test) in enumerate(tests)])
        rows = F.array(*[F.struct(F.lit(reason).alias("reason"), F.col(f"c{i}").alias("n_rows")) for i, (reason, _) in enumerate(tests)])
        bad = sum((F.col(f"c{i}") for i in range(len(tests))), F.lit(0))
        one = counts.select(F.lit(name).alias("input"), F.when(bad > 0, "invalid").otherwise("OK").alias("status"), F.explode(rows).alias("r")) \
            .select("input", "status", "r.reason", "r.n_rows")
        out = one if out is None else out.unionByName(one)
    return out

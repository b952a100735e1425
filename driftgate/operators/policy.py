"""Policy rules over the field diff.

All per-entity rules are evaluated in one pass over the field diff: every diff row carries
its dependency's discovery columns (path, line, low flag, identifier kind), so J4 needs no
join; the dependency-level rules (P2, P3, P4) each fire on exactly one field row of the
dependency (identifierKind, retirementDate, provider). Each row builds an array of
``when(rule, finding)``; nulls are dropped and the rest exploded. The policy table (one
row per scope) is joined by scope; Spark's size estimate decides whether it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.confidence import can_block, days_until, pct_increase
from driftgate.schemas import DEFAULT_FREEZE_MESSAGE, POLICY_DEFAULTS

POLICY_COLS = [
    "floating_aliases", "retirement_window_days", "max_input_price_increase_percent",
    "max_output_price_increase_percent", "fail_on_context_decrease", "fail_on_max_output_decrease",
    "fail_on_tool_calling_removal", "fail_on_structured_output_removal", "fail_on_vision_removal",
    "stale_source_behavior", "min_blocking_confidence", "fail_on_warn",
    "allow_network", "stale_after_days", "timeout_ms", "max_bytes",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_policy(scopes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per scope, each parameter the override if given, else its default."""
    defaults = dict(POLICY_DEFAULTS, fail_on_warn=False)
    base = scopes.select("scope").distinct()
    if overrides is not None:
        base = base.join(overrides, "scope", "left")
    cols = []
    for name in POLICY_COLS:
        d = F.lit(defaults[name])
        cols.append((F.coalesce(F.col(name), d) if name in base.columns else d).alias(name))
    out = base.select("scope", *cols)
    return out.withColumn("config_digest", config_digest())


def config_digest() -> Column:
    """Digest of a scope's effective policy: sha-256 of its ``key=value`` pairs in
    key order (so equal settings give equal digests whatever their source)."""
    pairs = [F.concat(F.lit(name + "="), F.col(name).cast("string")) for name in sorted(POLICY_COLS)]
    return F.sha2(F.concat_ws("|", *pairs), 256)


def js_number(x) -> Column:
    """A double as JavaScript prints it: integral values without a fraction."""
    x = _c(x)
    integral = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity") \
            .when(x == float("-inf"), "-Infinity") \
            .when(integral, x.cast("long").cast("string")).otherwise(x.cast("string"))


def _fixed1(x: Column) -> Column:
    return F.when(x == float("inf"), "Infinity").otherwise(F.format_string("%.1f", x))


def _finding(code: str, severity: Column, message: Column, confidence: Column | None,
             field: Column | None = None) -> Column:
    return F.struct(
        (field if field is not None else F.col("field")).alias("field"),
        severity.alias("severity"), F.lit(code).alias("code"), message.alias("message"),
        (confidence if confidence is not None else F.lit(None).cast("string")).alias("confidence"),
    )


def entity_findings(fdiff: DataFrame, policy: DataFrame, now) -> DataFrame:
    """P2-P13 (+J4, J5): one pass over the field diff."""
    now = now if isinstance(now, Column) else F.to_timestamp(F.lit(str(now)))
    j = fdiff.join(policy, "scope", "left")
    field, kind, conf = F.col("field"), F.col("kind"), F.coalesce(F.col("confidence"), F.lit("unavailable"))
    block = can_block(conf, F.col("min_blocking_confidence"))
    sev = F.when(block, "fail").otherwise("warn")
    moving = kind.isin("changed", "unknown")
    a_num, c_num = F.col("a_num"), F.col("c_num")
    both_num = a_num.isNotNull() & c_num.isNotNull()
    key = F.col("entity_key")

    # P2 floating alias, on the dependency's identifierKind row.
    fa = F.col("floating_aliases")
    p2 = F.when((field == "identifierKind") & (F.col("identifier_kind") == "floating") & fa.isin("deny", "warn"),
                _finding("floating-alias", F.when(fa == "deny", "fail").otherwise("warn"),
                         F.when(fa == "deny", F.format_string('Floating model alias "%s" is denied by policy', F.col("model_id")))
                          .otherwise(F.format_string('Floating model alias "%s" detected', F.col("model_id"))),
                         None))
    # P4 low-confidence discovery, on the provider row.
    p4 = F.when((field == "provider") & F.coalesce(F.col("low_confidence"), F.lit(False)),
                _finding("low-confidence-discovery", F.lit("warn"),
                         F.format_string("Dependency %s was discovered with low confidence", key), None,
                         F.lit("discovery")))
    # P3 retirement window (J5: approved date, else the current one).
    retirement = F.coalesce(F.col("a_str"), F.col("c_str"))
    days = days_until(retirement, now)
    window = F.col("retirement_window_days")
    p3 = F.when((field == "retirementDate") & retirement.isNotNull() & (retirement != "") & days.isNotNull()
                & (days <= window),
                _finding("retirement-window", sev,
                         F.format_string("Model %s retires in %s day(s) (window=%s)", key,
                                         days.cast("string"), window.cast("string")),
                         conf))
    # P13 conflicting fact: always a warning.
    p13 = F.when(kind == "conflicting",
                 _finding("conflicting-fact", F.lit("warn"),
                          F.format_string("Conflicting data for %s.%s; not blocking", key, field),
                          F.lit("conflicting")))
    pct = pct_increase(a_num, c_num)
    p5 = F.when(moving & (field == "inputPricePerMillion") & both_num & (c_num > a_num)
                & (pct > F.col("max_input_price_increase_percent")),
                _finding("input-price-increase", sev,
                         F.format_string("Input price increased %s%% (max %s%%)", _fixed1(pct),
                                         js_number(F.col("max_input_price_increase_percent"))), conf))
    p6 = F.when(moving & (field == "outputPricePerMillion") & both_num & (c_num > a_num)
                & (pct > F.col("max_output_price_increase_percent")),
                _finding("output-price-increase", sev,
                         F.format_string("Output price increased %s%% (max %s%%)", _fixed1(pct),
                                         js_number(F.col("max_output_price_increase_percent"))), conf))
    p7 = F.when(moving & F.col("fail_on_context_decrease") & (field == "contextLimit") & both_num & (c_num < a_num),
                _finding("context-decrease", sev,
                         F.format_string("Context limit decreased from %s to %s", js_number(a_num), js_number(c_num)), conf))
    p8 = F.when(moving & F.col("fail_on_max_output_decrease") & (field == "maxOutputLimit") & both_num & (c_num < a_num),
                _finding("max-output-decrease", sev,
                         F.format_string("Max output decreased from %s to %s", js_number(a_num), js_number(c_num)), conf))
    removed = (F.col("a_bool") == F.lit(True)) & (F.col("c_bool") == F.lit(False))
    p9 = F.when(moving & F.col("fail_on_tool_calling_removal") & (field == "toolCalling") & removed,
                _finding("tool-calling-removal", sev, F.lit("Tool-calling support removed"), conf))
    p10 = F.when(moving & F.col("fail_on_structured_output_removal") & (field == "structuredOutput") & removed,
                 _finding("structured-output-removal", sev, F.lit("Structured-output support removed"), conf))
    p11 = F.when(moving & F.col("fail_on_vision_removal") & (field == "vision") & removed,
                 _finding("vision-removal", sev, F.lit("Vision support removed"), conf))
    p12 = F.when(moving & (field == "lifecycleStatus") & (F.col("a_str") == "active")
                 & F.col("c_str").isin("deprecated", "retired"),
                 _finding("lifecycle-regression", sev,
                          F.format_string("Lifecycle changed from %s to %s", F.col("a_str"), F.col("c_str")), conf))
    rules = F.filter(F.array(p2, p4, p3, p13, p5, p6, p7, p8, p9, p10, p11, p12), lambda x: x.isNotNull())
    return (j.select("scope", F.col("entity_key").alias("key"), "field_ord", "path", "line",
                     F.explode(rules).alias("f"))
             .select("scope", "key", "f.field", "field_ord", "f.severity", "f.code", "f.message",
                     "path", "line", "f.confidence"))


def stale_findings(policy: DataFrame, frozen: bool, warnings: list[str] | None,
                   freeze_reason: str | None = None) -> DataFrame:
    """One finding per scope when the snapshot is frozen or carries warnings."""
    degraded = bool(frozen) or bool(warnings)
    behavior = F.col("stale_source_behavior")
    return (policy.filter(F.lit(degraded) & behavior.isin("warn", "fail"))
                  .select("scope", F.lit("*").alias("key"), F.lit("registry").alias("field"),
                          F.lit(-1).alias("field_ord"), behavior.alias("severity"),
                          F.lit("stale-source").alias("code"),
                          F.lit(freeze_reason or DEFAULT_FREEZE_MESSAGE).alias("message"),
                          F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"),
                          F.lit("stale").alias("confidence")))


def evaluate(fdiff: DataFrame, policy: DataFrame, now, frozen: bool = False,
             warnings: list[str] | None = None, freeze_reason: str | None = None) -> DataFrame:
    """All findings (P1-P13) for every scope."""
    return stale_findings(policy, frozen, warnings, freeze_reason).unionByName(
        entity_findings(fdiff, policy, now))


def gate(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Fail and warn counts per scope and the exit code (1 on any fail, or on any
    warning when the scope fails on warnings). Scopes without findings pass."""
    counts = (findings.groupBy("scope")
                      .agg(F.count(F.when(F.col("severity") == "fail", 1)).alias("n_fail"),
                           F.count(F.when(F.col("severity") == "warn", 1)).alias("n_warn")))
    g = policy.select("scope", "fail_on_warn").join(counts, "scope", "left")
    n_fail = F.coalesce(F.col("n_fail"), F.lit(0)).cast("long")
    n_warn = F.coalesce(F.col("n_warn"), F.lit(0)).cast("long")
    return g.select("scope", n_fail.alias("n_fail"), n_warn.alias("n_warn"),
                    F.when((n_fail > 0) | (F.col("fail_on_warn") & (n_warn > 0)), 1).otherwise(0).alias("exit_code"))


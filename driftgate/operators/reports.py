"""Report tables.

Reports stay tables: one row per finding / rule / scope. Nested JSON documents are built
per row, and a scope's report is the set of its rows (``write.partitionBy('scope')``),
so no scope's findings are gathered into a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.functions.text import sanitize_line


def sarif_results(findings: DataFrame) -> DataFrame:
    """T2 (flat): one SARIF result per finding: fail -> error, warn -> warning, else note;
    a location only when there is a path (backslashes -> '/', line default 1)."""
    sev = F.col("severity")
    has_path = F.col("path").isNotNull() & (F.col("path") != "")
    return findings.select(
        "scope", F.col("code").alias("rule_id"),
        F.when(sev == "fail", "error").when(sev == "warn", "warning").otherwise("note").alias("level"),
        sanitize_line(F.col("message")).alias("message"),
        F.when(has_path, F.regexp_replace("path", r"\\", "/")).alias("uri"),
        F.when(has_path, F.coalesce(F.col("line"), F.lit(1))).alias("start_line"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A10: distinct rules per scope; the description is the message of the first finding
    of that code in report order (key, then emission order). Partial aggregate, no window."""
    first = F.min(F.struct("key", "field_ord", "message"))
    return (findings.groupBy("scope", "code").agg(first.alias("f"))
                    .select("scope", F.col("code").alias("rule_id"), F.col("code").alias("short_description"),
                            sanitize_line(F.col("f.message")).alias("full_description")))


def json_report(findings: DataFrame, gate: DataFrame) -> DataFrame:
    """Per scope a header row (exit code, counts) and one JSON row per finding."""
    head = gate.select("scope", F.lit(0).alias("row_kind"),
                       F.to_json(F.struct(F.col("exit_code").alias("exitCode"), F.col("n_fail").alias("fail"),
                                          F.col("n_warn").alias("warn"))).alias("json"))
    rows = findings.select("scope", F.lit(1).alias("row_kind"),
                           F.to_json(F.struct("key", "field", "severity", "code", "message", "path", "line",
                                              "confidence")).alias("json"))
    return head.unionByName(rows)


def change_summary(previous: DataFrame, proposed: DataFrame, changes: DataFrame, gate: DataFrame) -> DataFrame:
    """Per scope: previous and proposed dependency counts, keys added and removed, and
    the policy preview counts. Each input is aggregated by scope; the joins are small."""
    p = previous.groupBy("scope").agg(F.count(F.lit(1)).alias("n_previous"))
    n = proposed.groupBy("scope").agg(F.count(F.lit(1)).alias("n_proposed"))
    c = changes.groupBy("scope").agg(F.count(F.when(F.col("change") == "added", 1)).alias("n_added"),
                                     F.count(F.when(F.col("change") == "removed", 1)).alias("n_removed"))
    out = (p.join(n, "scope", "full").join(c, "scope", "left")
            .join(gate.select("scope", "n_fail", "n_warn"), "scope", "left"))
    z = F.lit(0).cast("long")
    return out.select("scope", *[F.coalesce(F.col(x), z).alias(x)
                                 for x in ("n_previous", "n_proposed", "n_added", "n_removed", "n_fail", "n_warn")])


def explain(fdiff: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """T4 (+F11): one key through diff and rules, field by field with the rule codes that
    fired. The key filter is pushed under the joins by the optimizer."""
    d = fdiff.filter(F.col("entity_key") == key)
    f = (findings.filter(F.col("key") == key)
                 .groupBy("scope", "field").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes")))
    return (d.join(f, ["scope", "field"], "left")
             .select("scope", "entity_key", "field", "kind", "a_str", "a_num", "a_bool", "c_str", "c_num", "c_bool",
                     "confidence", F.coalesce("codes", F.lit("")).alias("codes")))


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """O1/O2: binary (not locale) ordering, applied only at the report edge."""
    return df.orderBy(*cols)

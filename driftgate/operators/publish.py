"""Digests, publish decisions, fallback and invariants.

The table digest is order- and partition-independent: each row's sha-256 is split into
two 60-bit numbers that are summed (exactly, as decimals) together with the row count.
Every step is a partial aggregate, so no task ever sees more than its own rows, and the
same rows give the same digest whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.operators.reconcile import to_long_facts
from driftgate.schemas import CONFIDENCE_ORDER, LIFECYCLE_STATES, PROVIDERS, SOURCE_OFFICIAL

DEC = "decimal(38,0)"
MATERIAL_COLS = ["entity_key", "field", "confidence", "str_value", "num_value", "bool_value"]


def material_row(df: DataFrame | None = None) -> Column:
    """Q6: the material content of one long fact row (no fetch times), as text that differs
    whenever the content does: every value is preceded by its length, a null is ``n``, and
    numbers have 15 significant digits whatever their size."""
    num = F.when(F.col("num_value").isNotNull(), F.format_string("%.14e", F.col("num_value")))
    values = [F.col("entity_key"), F.col("field"), F.col("confidence"), F.col("str_value"), num, F.col("bool_value").cast("string")]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in values])


def _halves(row_text: Column) -> tuple[Column, Column]:
    d = F.sha2(row_text, 256)
    return (F.conv(F.substring(d, 1, 15), 16, 10).cast(DEC), F.conv(F.substring(d, 16, 15), 16, 10).cast(DEC))


def _fold(n: Column, s1: Column, s2: Column) -> Column:
    return F.sha2(F.concat_ws(":", n.cast("string"), s1.cast("string"), s2.cast("string")), 256)


def table_digest(df: DataFrame, row_text: Column | None = None) -> DataFrame:
    """One row (n_rows, digest) over the given row text (default: material columns)."""
    h1, h2 = _halves(row_text if row_text is not None else material_row())
    g = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h1).alias("s1"), F.sum(h2).alias("s2"))
    return g.select("n_rows", _fold(F.col("n_rows"), F.coalesce("s1", F.lit(0).cast(DEC)),
                                    F.coalesce("s2", F.lit(0).cast(DEC))).alias("digest"))


def publish_decision(previous: DataFrame, current: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """R2 + R3: digests of the previous and current facts in one aggregation (no join), the
    row and entity counts, and whether to publish (the material digest changed)."""
    both = (previous.select(*MATERIAL_COLS, F.lit(0).alias("side"))
            .unionByName(current.select(*MATERIAL_COLS, F.lit(1).alias("side"))))
    h1, h2 = _halves(material_row())
    both = both.select("side", "field", h1.alias("h1"), h2.alias("h2"))
    aggs = []
    for tag, v in (("old", 0), ("new", 1)):
        on = F.col("side") == v
        aggs += [F.count(F.when(on, 1)).alias(f"{tag}_rows"),
                 F.count(F.when(on & (F.col("field") == "provider"), 1)).alias(f"{tag}_models"),
                 F.coalesce(F.sum(F.when(on, F.col("h1"))), F.lit(0).cast(DEC)).alias(f"{tag}_s1"),
                 F.coalesce(F.sum(F.when(on, F.col("h2"))), F.lit(0).cast(DEC)).alias(f"{tag}_s2")]
    g = both.agg(*aggs)
    old = _fold(F.col("old_rows"), F.col("old_s1"), F.col("old_s2"))
    new = _fold(F.col("new_rows"), F.col("new_s1"), F.col("new_s2"))
    warn = "; ".join(warnings) if warnings else "(none)"
    return g.select(old.alias("previous_digest"), new.alias("new_digest"), "old_models", "new_models",
                    (old != new).alias("publish"), F.lit(warn).alias("warnings"))


def last_known_good(previous: DataFrame, current: DataFrame) -> DataFrame:
    """R4 (per-entity option, Q7): entities the current facts lost are carried over from
    the previous facts, marked stale; the rest is the current facts. Wide records (one row per
    entity) meet once, at entity level, and are taken apart after the join, so that neither
    side is computed twice."""
    if "facts" in previous.columns:
        old = previous.select(F.col("entity_key").alias("_key"), F.struct(*previous.columns).alias("_old"))
        new = current.select(F.col("entity_key").alias("_cur"), F.struct(*current.columns).alias("_new"))
        both = old.join(new, F.col("_key") == F.col("_cur"), "full")
        lost = F.col("_new").isNull()
        both = both.select(lost.alias("lost"), F.when(lost, F.col("_old")).otherwise(F.col("_new")).alias("r"))
        rows = to_long_facts(both.select("lost", "r.*"), "lost")
        confidence = F.when(F.col("lost") & (F.col("confidence") != "unavailable"), "stale").otherwise(F.col("confidence"))
        return rows.withColumn("confidence", confidence).withColumn(
            "origin", F.when(F.col("lost"), "last-known-good").otherwise("current")).drop("lost")
    carried = (previous.join(current.select("entity_key").distinct(), "entity_key", "left_anti")
                       .withColumn("confidence", F.when(F.col("confidence") == "unavailable", "unavailable")
                                   .otherwise("stale"))
                       .withColumn("origin", F.lit("last-known-good")))
    return current.withColumn("origin", F.lit("current")).unionByName(carried)


def fact_violations(fact: DataFrame, latest: DataFrame) -> DataFrame:
    """Invariant violations of a long fact table, one row per (entity, field,
    check). ``latest`` (A1 output) tells which entities have official evidence."""
    official = (latest.groupBy("entity_key")
                      .agg(F.max((F.col("source_id") == SOURCE_OFFICIAL).cast("int")).alias("has_official")))
    f = fact.join(official, "entity_key", "left")
    field, num, conf = F.col("field"), F.col("num_value"), F.col("confidence")
    has_value = F.col("str_value").isNotNull() | num.isNotNull() | F.col("bool_value").isNotNull()
    checks = [
        ("price-negative", field.isin("inputPricePerMillion", "outputPricePerMillion") & (num < 0)),
        ("limit-not-non-negative-integer", field.isin("contextLimit", "maxOutputLimit")
         & ((num < 0) | (num != F.floor(num)))),
        ("official-without-official-evidence", (conf == "official-verified")
         & (F.coalesce(F.col("has_official"), F.lit(0)) == 0)),
        ("conflicting-with-value", (conf == "conflicting") & has_value),
        ("bad-enum", ((field == "lifecycleStatus") & F.col("str_value").isNotNull() & ~F.col("str_value").isin(LIFECYCLE_STATES))
         | ((field == "provider") & ~F.coalesce(F.col("str_value"), F.lit("")).isin(PROVIDERS))
         | ((field == "identifierKind") & F.col("str_value").isNotNull() & ~F.col("str_value").isin("floating", "fixed"))
         | ~conf.isin(CONFIDENCE_ORDER)),
        ("missing-source-meta", F.col("source_id").isNull() | F.col("source_url").isNull() | F.col("fetched_at").isNull()),
    ]
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks])
    return (f.select("entity_key", "field", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("check")))


CHECK_NAMES = ["price-negative", "limit-not-non-negative-integer", "official-without-official-evidence",
               "conflicting-with-value", "bad-enum", "missing-source-meta"]


def violation_counts(violations: DataFrame) -> DataFrame:
    """Count per check, every check listed (zero when clean)."""
    g = violations.agg(*[F.count(F.when(F.col("check") == c, 1)).alias(f"c{i}") for i, c in enumerate(CHECK_NAMES)])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"c{i}").alias("n_violations"))
                     for i, c in enumerate(CHECK_NAMES)])
    return g.select(F.explode(rows).alias("r")).select("r.*")

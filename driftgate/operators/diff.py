"""Field-level diff of an approved lock against the current facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.confidence import blocking_eligible
from driftgate.operators.skew import join_one
from driftgate.schemas import FACT_FIELDS

EPS = 1e-9
LOCK_PASS = ["scope", "entity_key", "provider", "model_id", "identifier_kind",
             "discovery_confidence", "low_confidence", "path", "line", "field", "field_ord"]


def _slim(records: DataFrame, *more: str) -> Column:
    """The 12 envelopes of a wide record, in field order, with their values and ``more`` only."""
    return F.array(*[F.struct(*[F.col(f"facts.{n}.{c}").alias(c) for c in ("str_value", "num_value", "bool_value", *more)])
                     for n, _ in FACT_FIELDS])


def field_diff(lock: DataFrame, current: DataFrame, heavy: list | None = None) -> DataFrame:
    """C1-C3 over J1: the approved lock left-joined to the current facts, field by field.

    ``lock`` are wide records (``lock_records``: one row per dependency) or long rows (one per
    field); ``current`` are wide records, one per entity. Wide records meet on ``entity_key``
    once and are taken apart after the join; when they come out of an entity-level join too,
    both sides are already partitioned alike and nothing moves. Long rows meet their own
    field's envelope only. ``heavy`` are entities to join apart (``operators.skew``). Keys only
    in the current facts drop out (left join); a lock key missing from them gives 'unknown'
    rows with confidence 'unavailable' (C2)."""
    ident = [c for c in LOCK_PASS if c not in ("field", "field_ord")]
    seen = current.select("entity_key", _slim(current, "confidence").alias("c_envs"))
    if "facts" in lock.columns:
        j = join_one(lock.select(*ident, _slim(lock).alias("a_envs")), seen, "entity_key", heavy)
        j = j.select(*ident, "c_envs", F.posexplode("a_envs").alias("field_ord", "a"))
        names = F.array(*[F.lit(n) for n, _ in FACT_FIELDS])
        j = j.select(*ident, F.get(names, F.col("field_ord")).alias("field"), "field_ord", "a", F.get("c_envs", F.col("field_ord")).alias("c"))
    else:
        l = lock.select(*LOCK_PASS, F.struct("str_value", "num_value", "bool_value").alias("a"))
        fields = seen.select("entity_key", F.posexplode("c_envs").alias("field_ord", "c"))
        j = l.join(fields, ["entity_key", "field_ord"], "left")
    j = j.select(*LOCK_PASS, F.col("a.str_value").alias("a_str"), F.col("a.num_value").alias("a_num"), F.col("a.bool_value").alias("a_bool"),
                 F.col("c").isNotNull().alias("c_seen"), F.col("c.str_value").alias("c_str"), F.col("c.num_value").alias("c_num"),
                 F.col("c.bool_value").alias("c_bool"), F.col("c.confidence").alias("c_conf"))
    gone = ~F.col("c_seen")
    conflicting = F.col("c_conf") == "conflicting"
    a_null = F.col("a_str").isNull() & F.col("a_num").isNull() & F.col("a_bool").isNull()
    c_null = F.col("c_str").isNull() & F.col("c_num").isNull() & F.col("c_bool").isNull()
    same = (F.col("a_str") == F.col("c_str")) | (F.col("a_num") == F.col("c_num")) \
        | (F.col("a_bool") == F.col("c_bool")) | (a_null & c_null) \
        | (F.abs(F.col("a_num") - F.col("c_num")) < EPS)
    kind = (F.when(gone, "unknown")
             .when(conflicting, "conflicting")
             .when(F.coalesce(same, F.lit(False)), "unchanged")
             .otherwise("changed"))
    blank = gone | conflicting
    conf = F.when(gone, F.lit("unavailable")).otherwise(F.col("c_conf"))
    return j.select(
        *LOCK_PASS, kind.alias("kind"), "a_str", "a_num", "a_bool",
        F.when(~blank, F.col("c_str")).alias("c_str"),
        F.when(~blank, F.col("c_num")).alias("c_num"),
        F.when(~blank, F.col("c_bool")).alias("c_bool"),
        conf.alias("confidence"),
        F.when(blank, F.lit(False)).otherwise(blocking_eligible(F.col("c_conf"))).alias("blocking_eligible"),
    )


def model_diff(fdiff: DataFrame) -> DataFrame:
    """An entity changed if any of its fields is changed, conflicting or unknown."""
    return (fdiff.groupBy("scope", "entity_key")
                 .agg(F.max((F.col("kind") != "unchanged").cast("int")).alias("any_change"))
                 .select("scope", "entity_key",
                         F.when(F.col("any_change") == 1, "changed").otherwise("unchanged").alias("kind")))

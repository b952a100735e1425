"""Lock building: dependencies joined to reconciled facts.

The lock is kept in long form, one row per (scope, entity_key, field), carrying the
dependency's discovery columns so the policy pass needs no further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.identity import identifier_kind, parse_model_key
from driftgate.operators.skew import join_one
from driftgate.schemas import EVIDENCE, FACT_FIELDS

DEP_COLS = ["scope", "entity_key", "provider", "model_id", "identifier_kind",
            "discovery_confidence", "low_confidence", "path", "line"]
VALUES = ["str_value", "num_value", "bool_value", "confidence"]


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.to_timestamp(F.lit(str(x)))


def exclude(deps: DataFrame, excluded: DataFrame) -> DataFrame:
    """drop discovered keys listed in a (scope, entity_key) exclude table."""
    return deps.join(excluded.select("scope", "entity_key"), ["scope", "entity_key"], "left_anti")


def overrides(deps: DataFrame, pins: DataFrame, includes: DataFrame) -> DataFrame:
    """Pins (scope, provider, model_id) then includes (scope, key) are added only for
    keys not already present; confidence 1, kind 'override', location the config file."""
    pk = parse_model_key(F.col("key"))
    inc = includes.select("scope", pk["provider"].alias("provider"), pk["model_id"].alias("model_id"),
                          F.lit(1).alias("prio")).filter(F.col("provider").isNotNull())
    cand = pins.select("scope", "provider", "model_id", F.lit(0).alias("prio")).unionByName(inc)
    cand = cand.withColumn("entity_key", F.concat("provider", F.lit(":"), "model_id"))
    # Pins win over includes for the same key: first by priority.
    first = (cand.groupBy("scope", "entity_key")
                 .agg(F.min(F.struct("prio", "provider", "model_id")).alias("c"))
                 .select("scope", "entity_key", "c.provider", "c.model_id"))
    added = (first.join(deps.select("scope", "entity_key"), ["scope", "entity_key"], "left_anti")
                  .select("scope", "entity_key", "provider", "model_id",
                          identifier_kind(F.col("model_id")).alias("identifier_kind"),
                          F.lit(1.0).alias("discovery_confidence"), F.lit(False).alias("low_confidence"),
                          F.lit(".llm-lock.yml").alias("path"), F.lit(1).alias("line")))
    return deps.select(*DEP_COLS).unionByName(added)


def _unavailable(generated_at, names: list[str] | None = None) -> Column:
    """The envelope of a fact the snapshot does not have (J2); ``names``: only these members."""
    from driftgate.operators.reconcile import CANDIDATES_TYPE
    env = {"str_value": F.lit(None).cast("string"), "num_value": F.lit(None).cast("double"), "bool_value": F.lit(None).cast("boolean"),
           "confidence": F.lit("unavailable"), "source_id": F.lit("unavailable"), "source_url": F.lit("file:unavailable"),
           "fetched_at": _ts(generated_at), "source_digest": F.lit("0"), "parser_version": F.lit("0"),
           "candidates": F.lit(None).cast(CANDIDATES_TYPE)}
    return F.struct(*[env[n].alias(n) for n in names or env])


def values_only(facts: DataFrame) -> DataFrame:
    """Wide records whose envelopes hold values and confidence only, for what needs no more."""
    env = lambda n: F.struct(*[F.col(f"facts.{n}.{c}").alias(c) for c in VALUES])
    return facts.select("entity_key", F.struct(*[env(n).alias(n) for n, _ in FACT_FIELDS]).alias("facts"))


def lock_records(deps: DataFrame, facts: DataFrame, generated_at, heavy: list | None = None) -> DataFrame:
    """J2 + T5 (wide): one lock record per dependency with its 12 facts and evidence from the snapshot;
    a key the snapshot lacks gets 'unavailable' facts; identity facts are overridden from
    discovery. ``facts`` are the wide records (one row per entity, already partitioned by
    ``entity_key``), so the join is at entity granularity and only the dependency side
    moves; entities that very many scopes depend on (``heavy``, see ``operators.skew``) are
    joined where the dependencies lie."""
    seen = facts.select("entity_key", "facts", F.col("evidence") if "evidence" in facts.columns else F.lit(None).cast(T.ArrayType(EVIDENCE)).alias("evidence"))
    j = join_one(deps.select(*DEP_COLS), seen, "entity_key", heavy)
    missing = F.col("facts").isNull()
    names = facts.schema["facts"].dataType[FACT_FIELDS[0][0]].dataType.names
    envs = []
    for n, _ in FACT_FIELDS:
        env = F.when(missing, _unavailable(generated_at, names)).otherwise(F.col(f"facts.{n}"))
        if n in ("provider", "requestedModelId", "identifierKind"):
            value = {"provider": F.col("provider"), "requestedModelId": F.col("model_id"),
                     "identifierKind": F.col("identifier_kind")}[n]
            conf = (F.lit("single-source") if n == "requestedModelId" else
                    F.when(env["confidence"] == "unavailable", "single-source").otherwise(env["confidence"]))
            env = env.withField("str_value", value).withField("confidence", conf)
        envs.append(env.alias(n))
    none = F.array().cast(T.ArrayType(EVIDENCE))
    return j.select(*DEP_COLS, F.struct(*envs).alias("facts"), F.coalesce("evidence", none).alias("evidence"))


def lock_long(records: DataFrame) -> DataFrame:
    """Lock records -> one row per (scope, entity, field), the form diff and rules use."""
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(i).alias("field_ord"), F.col(f"facts.{n}").alias("env"))
                     for i, (n, _) in enumerate(FACT_FIELDS)])
    return (records.select(*DEP_COLS, F.explode(rows).alias("x"))
                   .select(*DEP_COLS, "x.field", "x.field_ord", "x.env.*"))


def build_lock(deps: DataFrame, facts: DataFrame, generated_at, heavy: list | None = None) -> DataFrame:
    """J2 + T5 in long form (see ``lock_records``)."""
    return lock_long(lock_records(deps, facts, generated_at, heavy))


def lock_keys_change(previous: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per scope, keys added and removed between two dependency lists."""
    both = (previous.select("scope", "entity_key", F.lit(True).alias("old"))
            .unionByName(proposed.select("scope", "entity_key", F.lit(False).alias("old"))))
    sides = both.groupBy("scope", "entity_key").agg(F.min("old").alias("lo"), F.max("old").alias("hi"))
    return (sides.filter(F.col("lo") == F.col("hi"))
                 .select("scope", "entity_key", F.when(F.col("lo"), "removed").otherwise("added").alias("change")))


def merge_warnings(a: Column, b: Column) -> Column:
    """De-duplicated union of two warning lists (order of first appearance)."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")),
                         F.coalesce(b, F.array().cast("array<string>")))

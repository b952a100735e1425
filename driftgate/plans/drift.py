"""The end-to-end drift check over the shared tables: reconcile at two dates, build the
approved lock, diff it against the current facts, judge, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftgate.operators.diff import field_diff
from driftgate.operators.lock import lock_long, lock_records, values_only
from driftgate.operators.policy import effective_policy, evaluate, gate
from driftgate.operators.reconcile import reconcile, reconcile_wide
from driftgate.operators.skew import heavy_keys
from driftgate.plans import bindings as B
from driftgate.session import stored


@dataclass
class DriftRun:
    approved_fact: DataFrame
    current_fact: DataFrame
    deps: DataFrame
    lock: DataFrame
    fdiff: DataFrame
    policy: DataFrame
    findings: DataFrame
    gate: DataFrame


def approved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(B.approved_observations(spark, sf_dir), B.APPROVED_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)


def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(B.current_observations(spark, sf_dir), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)


def approved_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_wide(B.approved_observations(spark, sf_dir), B.APPROVED_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)


def approved_wide_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``approved_wide`` for callers that use all of it: raw columns are moved."""
    return reconcile_wide(B.approved_pieces(spark, sf_dir), B.APPROVED_AS_OF, B.STALE_AFTER_DAYS, describe=B.described, pieces=False)


def current_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_wide(B.current_observations(spark, sf_dir), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)


def both_wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``approved_wide`` and ``current_wide`` for callers that use both: one pass over the observations."""
    approved, current = B.drift_observations(spark, sf_dir)
    return (reconcile_wide(approved, B.APPROVED_AS_OF, B.STALE_AFTER_DAYS, describe=B.described, pieces=False),
            reconcile_wide(current, B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described, pieces=False))


def run(spark: SparkSession, sf_dir: str, policy_overrides: DataFrame | None = None, once: bool = False, lazy: bool = False) -> DriftRun:
    """``once``: the field diff is written first and read by all that follows from it, for
    callers that use more than one of ``fdiff``, ``findings`` and ``gate``. ``lazy``: nothing is
    written, for callers that want few keys (their filter then reaches the observations)."""
    approved, current = (approved_wide(spark, sf_dir), current_wide(spark, sf_dir)) if lazy else both_wide(spark, sf_dir)
    deps = B.dependencies(spark, sf_dir)
    heavy = heavy_keys(deps, "entity_key")
    records = lock_records(deps, approved, B.APPROVED_AS_OF, heavy)
    lock = lock_long(records)
    # The diff reads values only: no sources or candidates are sorted and moved for it.
    fdiff = field_diff(lock_records(deps, values_only(approved), B.APPROVED_AS_OF, heavy), current, heavy)
    if once:
        fdiff = stored(fdiff, "fdiff")
    policy = effective_policy(deps, policy_overrides)
    findings = evaluate(fdiff, policy, B.CURRENT_AS_OF)
    return DriftRun(approved, current, deps, lock, fdiff, policy, findings, gate(findings, policy))

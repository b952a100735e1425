"""Plan-shape guards: the properties the scale design relies on."""

import contextlib
import io

from helpers import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_a1_reduces_before_the_shuffle_and_pushes_the_date(spark):
    from driftgate.operators.reconcile import latest_per_source
    from driftgate.plans import bindings as B
    txt = plan(latest_per_source(B.observations(spark, SF001, B.CURRENT_AS_OF)))
    assert "WindowGroupLimit" in txt and "Partial" in txt
    assert "LessThanOrEqual(l_shipdate" in txt  # reaches the Parquet reader


def test_diff_join_reuses_entity_partitioning(spark):
    from driftgate.plans import drift
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the large-table shape
    try:
        run = drift.run(spark, SF001)
        txt = plan(run.fdiff)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in txt.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2  # deps x approved facts, lock x current facts
    # one hash exchange on entity_key for the dependency side; facts and lock sides reuse
    # the partitioning of the aggregation / join that produced them
    assert txt.count("Exchange hashpartitioning(entity_key") == 5  # 2 per reconcile + deps


def test_policy_single_pass(spark):
    from driftgate.plans import drift
    txt = plan(drift.run(spark, SF001).findings)
    assert txt.count("Generate explode") >= 1


def test_hot_entity_is_not_gathered(spark):
    """A third of all scopes on one model, broadcasts by size off: the same diff as a plain
    join, and the hot entity's rows never shuffle."""
    from pyspark.sql import functions as F
    from driftgate.operators.diff import field_diff
    from driftgate.operators.lock import lock_records
    from driftgate.operators.skew import heavy_keys
    from driftgate.plans import bindings as B
    from driftgate.plans import drift
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        deps = B.dependencies(spark, SF001)
        many = deps.join(spark.range(100).select(F.concat(F.lit("team-"), F.col("id").cast("string")).alias("team")), F.col("entity_key") == "anthropic:m1")
        many = many.withColumn("scope", F.col("team")).drop("team").unionByName(deps)
        heavy = heavy_keys(many, "entity_key", rows=50)
        assert heavy == ["anthropic:m1"]
        approved, current = drift.approved_wide(spark, SF001), drift.current_wide(spark, SF001)
        cols = ["scope", "entity_key", "field", "kind", "a_str", "a_num", "c_str", "c_num", "confidence"]
        fast = field_diff(lock_records(many, approved, B.APPROVED_AS_OF, heavy), current, heavy).select(*cols)
        slow = field_diff(lock_records(many, approved, B.APPROVED_AS_OF, []), current, []).select(*cols)
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
        assert plan(fast).count("BroadcastHashJoin") >= 2
        from driftgate.operators.lock import lock_long
        long = field_diff(lock_long(lock_records(many, approved, B.APPROVED_AS_OF, [])), current).select(*cols)
        assert sorted(map(str, long.collect())) == sorted(map(str, slow.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

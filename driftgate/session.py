"""Session helper: UTC, AQE with skew handling, and a shared checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "driftgate",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    On a cluster the launcher owns ``master`` and the checkpoint folder; locally (tests,
    bench) both default to something usable.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master and master.startswith("local"):
        # Local runs: the driver is the only JVM; give it a working heap.
        b = b.config("spark.driver.memory", os.environ.get("DRIFTGATE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a purely local session (tests,
    bench), whose one machine shares its own disk, gets a scratch folder when it is unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="driftgate-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for tables written to cut lineage."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet (``options`` of the writer) below the shared checkpoint
    folder and read back: what a checkpoint does, in columns and compressed."""
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

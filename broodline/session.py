"""Session construction and cluster-safe staging helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

#: What the library wants of a session; a value given to spark-submit wins.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "broodline",
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """A session for these jobs.

    Master, memory and shuffle partitions belong to spark-submit: they are set only when
    the caller names them. ``DEFAULTS`` are set only where spark-submit left them open.
    """
    SparkContext._ensure_initialized()  # so that SparkConf sees the submitted settings
    given = SparkConf()
    conf = {k: v for k, v in DEFAULTS.items() if not given.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    builder = SparkSession.builder.config(map=conf)
    if master:
        builder = builder.master(master)
    if not given.contains("spark.app.name") or given.get("spark.app.name") == "pyspark-shell":
        builder = builder.appName(app)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The folder the session names (``spark.checkpoint.dir``, or one set on the context) is
    used as it is. Only where neither is set, and only for a ``local`` master, a scratch
    folder is made; on a cluster a machine-local folder would not survive executor loss,
    so the setting is required there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return named
    if current := sc.getCheckpointDir():
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store); "
                           "staged tables are written there")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="broodline-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    For small row sets that are read once or twice in full, as in an iteration. Survives
    executor loss, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    For wide or large intermediates with several readers: each reader scans only the
    columns it uses and its filters reach the scan, which a checkpoint of serialised rows
    cannot offer. The schema is passed on, so the read infers nothing.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

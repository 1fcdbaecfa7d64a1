"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on.  Each is applied only where the
# session still has Spark's own default, so a cluster's choice always wins.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # several operators multiply rows after a shuffle, so small partitions still keep all cores busy
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
}
_SPARK_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1MB",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    "spark.sql.execution.arrow.pyspark.enabled": "false",
}


# how Spark prints its byte-size defaults back
_BYTES = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": ("268435456b", "256mb"),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": ("1048576b", "1mb"),
}


def get_spark(app: str = "metroframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and RocksDB streaming state."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # recording the Python call site of every expression costs more than planning it (static setting)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config(
        "spark.python.sql.dataFrameDebugging.enabled", "false"
    ).config(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in _RUNTIME.items():
        if not spark.conf.isModifiable(key):
            continue
        current = spark.conf.get(key, None)
        if key == "spark.sql.session.timeZone" or current is None:
            spark.conf.set(key, value)
        elif str(current).lower() == _SPARK_DEFAULTS.get(key, "").lower():
            spark.conf.set(key, value)
        elif str(current).lower() in _BYTES.get(key, ()):
            spark.conf.set(key, value)
    return spark


_fallback_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where one machine is the cluster."""
    global _fallback_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="metroframe-")
    return _fallback_dir


def scratch_path(spark: SparkSession, name: str = "") -> str:
    """A new path in this application's folder of the shared scratch space."""
    return os.path.join(scratch_dir(spark), "metroframe", spark.sparkContext.applicationId, name + uuid.uuid4().hex)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all that this application has stored for its own use; results that still read it are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(scratch_dir(spark), "metroframe", spark.sparkContext.applicationId))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job by writing the rows to shared storage.

    Parquet rather than an RDD checkpoint: the read side has true sizes, so the
    planner picks broadcast or shuffle joins from facts, and it prunes columns.
    The files survive the loss of any executor; ``drop_scratch`` removes them.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over four tasks a core (by ``keys``, if any), for small tables of few files that a join multiplies."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)

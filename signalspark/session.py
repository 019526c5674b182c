"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "signalspark", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with UTC time, AQE and the web page off.

    Partition counts are left to AQE and to the cluster's own settings; ``conf`` overrides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has, for work that costs far more than moving them.

    How a table's files are cut would else decide how many tasks share the work, down to one for a file of
    one row group. The number is given, so AQE leaves it as it is; a stream's frame stays as it was.
    """
    return df if df.isStreaming else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's or the session's, else one in the warehouse, which all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()

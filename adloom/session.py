"""Session settings and the shared checkpoint folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; `settings` are extra `spark.*` entries
    written with underscores for dots."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the folder named by `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    the files must outlive the machine that wrote them.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if current is None or current.rstrip("/").rpartition("/")[0] != named.rstrip("/"):
            context.setCheckpointDir(named)
    elif current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="adloom-checkpoint-"))


def checkpointed(rows: DataFrame) -> DataFrame:
    """`rows` written to the shared checkpoint folder, with its lineage cut."""
    use_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()

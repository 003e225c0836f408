"""Which hours of a log are whole.

Beside the folders of a log, partitioned by `log` and `date` (`yyyyMMddHH`), the manifest has
an empty file per whole hour, made by the hour's writer when its data are in place. Readers list
that folder alone and name the hours they read: neither data folders nor globs are listed, and an
hour still being written isn't read.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from adloom.sources.schemas import PAGE_VIEW, layout, narrow
from adloom.sources.writers import replaced

MANIFEST = "_manifest"


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_hour(rows: DataFrame, root: str, log: str, hour: str, files: int | None = None) -> None:
    """The rows of an hour in place of what it held. It counts as whole again once they are there."""
    spark, root = rows.sparkSession, root.rstrip("/")
    withdraw(spark, root, log, hour)
    with replaced(spark, f"{root}/log={log}/date={hour}") as new:
        (rows.repartition(files) if files else rows).write.parquet(new)
    announce(spark, root, log, hour)


def announce(spark: SparkSession, root: str, log: str, hour: str) -> None:
    """Note that an hour is whole."""
    at, files = _place(spark, f"{root.rstrip('/')}/{MANIFEST}/{log}/{hour}")
    files.create(at, True).close()


def withdraw(spark: SparkSession, root: str, log: str, hour: str) -> None:
    """Note that an hour isn't whole any more."""
    at, files = _place(spark, f"{root.rstrip('/')}/{MANIFEST}/{log}/{hour}")
    files.delete(at, False)


def whole_hours(spark: SparkSession, root: str, log: str, date: str) -> list[str]:
    """The whole hours of a log that begin with `date`, a day or an hour, in order; none without a manifest."""
    at, files = _place(spark, f"{root.rstrip('/')}/{MANIFEST}/{log}")
    if not files.exists(at):
        return []
    names = (status.getPath().getName() for status in files.listStatus(at))
    return sorted(name for name in names if name.startswith(date))


def read_whole_hours(
    spark: SparkSession,
    root: str,
    log: str,
    date: str,
    fields: Iterable[str],
    ddl: str = PAGE_VIEW,
    expected: Iterable[str] = (),
) -> DataFrame | None:
    """The records of a log's whole hours of a day or hour, with their `date`; None if there is none.

    Hours that are `expected` and not whole raise.
    """
    hours = whole_hours(spark, root, log, date)
    missing = sorted(set(expected) - set(hours))
    if missing:
        raise ValueError(f"hours of {log} that are not whole: {', '.join(missing)}")
    if not hours:
        return None
    base = f"{root.rstrip('/')}/log={log}"
    schema = narrow(layout(ddl), fields).add("date", "string")
    return spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/date={hour}" for hour in hours))

"""Readers for logs, daily tables and text."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from adloom import constants as C
from adloom.functions.dates import days_from
from adloom.operators.running import running_total
from adloom.sources.schemas import IMPRESSION_EXTRACT, CLICKS_AND_CONVERSIONS, PAGE_VIEW, layout, narrow
from adloom.sources.writers import SKETCH, SKETCHES

TAB = "\t"


def read_records(spark: SparkSession, path: str, fields: Iterable[str], ddl: str = PAGE_VIEW) -> DataFrame:
    """Nested records under a path or glob, only the named fields."""
    return spark.read.schema(narrow(layout(ddl), fields)).parquet(path)


def read_log(
    spark: SparkSession, root: str, log: str, date: str, fields: Iterable[str], ddl: str = PAGE_VIEW
) -> DataFrame:
    """One log (exposure, click, trace, …) of a day or an hour.

    The folder is partitioned by `log` and by `date` (`yyyyMMddHH`); a shorter date
    selects all its hours. No other folder is listed; a date without any raises.
    """
    schema = narrow(layout(ddl), fields)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/log={log}/date={date}*")


def read_daily_table(
    spark: SparkSession, source: str, day: str, days: int = C.DAYS_READ, partition: str = "day"
) -> DataFrame:
    """The partitions of a day and the ones after it, from a catalog table or a folder.

    Of a folder only these days' folders are listed; one of them at least must be there.
    """
    wanted = days_from(day, days)
    if "/" in source:
        root = source.rstrip("/")
        return spark.read.option("basePath", root).parquet(f"{root}/{partition}={{{','.join(wanted)}}}")
    return spark.read.table(source).filter(F.col(partition).cast("string").isin(wanted))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated text without header or quoting, read as `decode_tsv` does: a number
    that is blank or does not parse raises, columns beyond the schema are ignored."""
    return decode_tsv(read_lines(spark, path), schema)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """An impression extract written by an earlier job."""
    return read_tsv(spark, path, layout(IMPRESSION_EXTRACT))


def read_sketches(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The sketches of large keys kept with written tables, one row each; None unless all have one."""
    try:
        return spark.read.schema(SKETCHES).parquet(*(f"{path.rstrip('/')}/{SKETCH}" for path in paths))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files written by `writers.write_ordered`, with `place`: where they are, from 1."""
    read = spark.read.schema(schema).option("header", True).csv(path)
    # a task reads a stretch of a file from begin to end, and numbers its rows upwards
    rows = read.select(
        *schema.names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_row"), F.lit(1).alias("_one"),
    )
    placed = running_total(rows, "_one", ["_file", "_from", "_row"])
    return placed.select(*schema.names, F.col("running").alias("place"))


def read_clicks_and_conversions(spark: SparkSession, path: str) -> DataFrame:
    """Clicks and conversions per ad group."""
    return read_tsv(spark, path, layout(CLICKS_AND_CONVERSIONS))


def decode_tsv(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Tab-separated text column to typed columns, by place; trailing blanks count."""
    cells = F.split(column, TAB, -1)
    return lines.select(
        *(cells[place].cast(f.dataType).alias(f.name) for place, f in enumerate(schema.fields))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a file or folder, as column `value`."""
    return spark.read.text(path)


def read_if_complete(spark: SparkSession, path: str, fields: Iterable[str], ddl: str = PAGE_VIEW) -> DataFrame | None:
    """Records of a folder whose writer has finished (success marker), else None."""
    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "*").load(f"{path}/_SUCCESS").schema
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return read_records(spark, path, fields, ddl)

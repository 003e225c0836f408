"""Writers. Each replaces what its target held, once the new output is whole."""

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adloom.operators.skew import key_sketch

TAB = "\t"
SKETCHES = "rows bigint, sketch struct<sketch: binary, maxItemsTracked: int, itemDataType: bigint, itemDataTypeDDL: string>"
#: Kept beside the files of a written table; readers of tables pass by names with an underscore.
SKETCH = "_key_sketch"


@contextmanager
def replaced(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder beside `path` to write to, which then takes its place.

    The old output stays until the new one is whole, and comes back if the exchange fails; a
    failed write leaves nothing. Between the two renames there is no folder at `path`.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    made = path.rstrip("/")
    name = uuid.uuid4().hex
    target, new, old = (hadoop.Path(p) for p in (made, f"{made}.new-{name}", f"{made}.old-{name}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        yield new.toString()
        was = files.exists(target)
        if was and not files.rename(target, old):
            raise OSError(f"cannot move {made}")
        try:
            if not files.rename(new, target):
                raise OSError(f"cannot move the new output to {made}")
        except Exception:
            if was:
                files.rename(old, target)
            raise
        if was:
            files.delete(old, True)
    finally:
        files.delete(new, True)


def _into_files(rows: DataFrame, files: int | None) -> DataFrame:
    return rows.repartition(files) if files else rows


def write_tsv(rows: DataFrame, path: str, files: int | None = None, sketch_keys: Sequence[str] = ()) -> int:
    """Tab-separated text without header or quoting, returning the number of rows; nulls become blanks.

    With `sketch_keys`, a sketch of the most frequent keys is made in the same job and kept
    with the files (see `readers.read_sketches`).
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    seen = Observation()
    counted = [F.count(F.lit(1)).alias("rows")]
    if sketch_keys:
        counted.append(key_sketch(sketch_keys).alias("sketch"))
    lines = rows.observe(seen, *counted).select(F.concat_ws(TAB, *cells).alias("value"))
    spark = rows.sparkSession
    with replaced(spark, path) as new:
        _into_files(lines, files).write.text(new)
        if sketch_keys:
            kept = spark.createDataFrame([(seen.get["rows"], seen.get["sketch"])], SKETCHES)
            kept.coalesce(1).write.parquet(f"{new}/{SKETCH}")
    return seen.get["rows"]


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header."""
    with replaced(rows.sparkSession, path) as new:
        _into_files(rows, files).write.option("header", True).csv(new)


def write_ordered(rows: DataFrame, path: str, order_by: Sequence[str], files: int = 1) -> None:
    """CSV files with header in total order: rows in order within a file, files in the order of
    their names.

    Rows are dealt to files by ranges of `order_by`, so no task sorts them all; equal rows of
    the order are in one file.
    """
    ranged = rows.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by)
    with replaced(rows.sparkSession, path) as new:
        ranged.write.option("header", True).csv(new)


def write_report(rows: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """A result of few rows as one CSV file with header, in order."""
    write_ordered(rows, path, order_by)


def write_partitioned(
    rows: DataFrame, path: str, partitions: Sequence[str], files: int | None = None
) -> None:
    """Parquet folders per partition value; only the folders written are replaced.

    Without `files`, adaptive execution sizes the files and splits a large
    partition value over several tasks. With it, rows are dealt evenly to that many
    tasks, and each partition value gets at most that many files.
    """
    rows = rows.repartition(files) if files else rows.hint("rebalance", *partitions)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_counted(rows: DataFrame, path: str, name: str, files: int | None = None) -> int:
    """Parquet, returning the number of rows written, counted in the same job."""
    seen = Observation(name)
    with replaced(rows.sparkSession, path) as new:
        _into_files(rows.observe(seen, F.count(F.lit(1)).alias("rows")), files).write.parquet(new)
    return seen.get["rows"]

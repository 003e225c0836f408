"""Tables kept in the shared folder, connected components, positions without one large window."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Everything but a run of these characters is a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BUCKET_ROWS = 50_000
#: Rows of a file have numbers below this.
FILE_ROWS = 1 << 40
_PART = r"part-(\d{1,6})[-.]"
#: For each open scope the paths made in it.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode alone a temporary one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="adloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/adloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables at rest made inside are removed at the end: write the result that reads them before."""
    _scopes.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _scopes.pop():
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def unused(rows: DataFrame, name: str) -> str:
    """`name` with as many underscores in front as make it no column of `rows`."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with a number for each row in column `name`, the same whenever the rows are read.

    A table that Spark wrote is numbered where it lies, by the part that a file's name tells and the
    place in the file: rows of a sorted table keep their order. Others are written first.
    """
    files = rows.inputFiles()
    parts = [re.search(_PART, f.rsplit("/", 1)[-1]) for f in files]
    at_rest = rows._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if "_metadata" not in rows.columns and at_rest and files and (
        len(files) == 1 or all(parts) and len({m[1] for m in parts}) == len(parts)
    ):
        part = F.coalesce(F.regexp_extract("_metadata.file_name", _PART, 1).try_cast("long"), F.lit(0))
        return rows.select("*", (part * FILE_ROWS + F.col("_metadata.row_index")).alias(name))
    place = F.monotonically_increasing_id() % (1 << 33)  # of a row in its partition
    return stored(rows.withColumn(name, F.spark_partition_id().cast("long") * FILE_ROWS + place), "rows")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back: computed once, safe when an executor is lost."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for rows in tables:
        context = rows.sparkSession.sparkContext
        for file in rows.inputFiles()[:1]:
            at = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/adloom-" in at.toString():
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge; root is the smallest node reachable.

    Large-star and small-star rounds; each keeps at most one row per edge. The edges stay
    in the shared folder, only their number and a checksum reach the driver.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        moved = e.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.union(low.select("a", F.col("low").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges"
    )
    seen = mark(now)
    while seen[0]:
        then, now = now, stored(small_star(large_star(now)), "edges")
        forget(then)
        last, seen = seen, mark(now)
        if last == seen:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def offsets(rows: DataFrame, key: str, spread: str, order: list[str], amount: str) -> DataFrame:
    """`rows` with `before`: the sum of `amount` over earlier rows of the same key, null keys as one.

    Rows of a key are cut into buckets of about 50,000 by `spread` (a column of evenly
    distributed 64-bit integers that comes first in the order), so no key fills a task; only
    bucket sums meet. `rows` is read more than once and must give the same rows each time.
    """
    names = rows.columns
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("_buckets"))
    cut = rows.join(counts, F.col(key).eqNullSafe(F.col("_key")))
    share = F.shiftrightunsigned(F.col(spread), 1) / F.lit(float(2**63))
    cut = cut.select(*names, F.least(F.floor(share * F.col("_buckets")), F.col("_buckets") - 1).alias("_bucket"))
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy(key, "_bucket").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = placed.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")))
    return joined.select(*names, (F.col("_from") + F.col("_within")).alias("before"))

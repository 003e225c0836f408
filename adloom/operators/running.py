"""Running totals that no single task has to hold."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_ROWS = 1_000_000
#: Rows that bounds are taken from at most, and segments at most: each has 16 rows of the sample or more.
SAMPLED = 65_536
MOST_SEGMENTS = 4_096


def running_total(
    rows: DataFrame,
    measure: str,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    segments: int | None = None,
) -> DataFrame:
    """Adds `running` (sum of `measure` up to and including the row, in `order_by`
    order within `keys`) and `total` (sum over the whole of `keys`).

    Rows fall into ranges of (keys, order) of about a million rows, so a large group is
    spread over many segments. Sums per segment give each segment its starting value; a
    window inside the segment does the rest. `order_by` must tell the rows of a group
    apart, and keys must not be null.

    The bounds of the ranges are taken once, from a sample that depends on nothing but
    the rows, and stay in the plan as literals: a row's segment is a function of the row, the
    same in every use and after an executor is lost, so nothing is written. Without keys
    they are a subquery of the same plan, which shares the shuffles that `rows` end in;
    with keys they are fetched first, and if one segment is enough there is none.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    columns = [*keys, *order_by]
    bounds = segment_bounds(rows, columns, segments)
    if keys:
        found = bounds.first()["bounds"]
        if not found:
            upto = group.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return rows.select("*", F.sum(measure).over(upto).alias("running"), F.sum(measure).over(group).alias("total"))
        listed = _literal(found, bounds.schema["bounds"].dataType)
    else:
        listed = bounds.scalar()
    placed = rows.withColumn("bounds", listed).withColumn("segment", segment_of(columns, "bounds")).drop("bounds")
    earlier = group.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "segment")
        .agg(F.sum(measure).alias("in_segment"))
        .select(
            *keys,
            "segment",
            F.coalesce(F.sum("in_segment").over(earlier), F.lit(0)).alias("start"),
            F.sum("in_segment").over(group).alias("total"),
        )
    )
    if not keys:
        starts = F.broadcast(starts)  # one row per segment

    inside = (
        Window.partitionBy(*keys, "segment")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("inside", F.sum(measure).over(inside))
        .join(starts, [*keys, "segment"])
        .withColumn("running", F.col("start") + F.col("inside"))
        .drop("segment", "start", "inside")
    )


def segment_bounds(rows: DataFrame, columns: Sequence[str], segments: int | None = None) -> DataFrame:
    """One row: `bounds`, the ordered `columns` of the first row of each segment but the first.

    One pass counts the rows and takes an even sample of them: each of a fixed number of
    classes of hashes gives its row of the smallest hash. There are as many segments as
    the rows need, but no more than the sample can tell apart.
    """
    at = F.struct(*columns).alias("at")
    name = F.xxhash64(*columns).alias("name")
    sample = (
        rows.select(at, name)
        .groupBy(F.pmod("name", F.lit(SAMPLED)).alias("class"))
        .agg(F.min_by("at", "name").alias("at"), F.count(F.lit(1)).alias("rows"))
        .agg(F.sort_array(F.collect_list("at")).alias("sample"), F.sum("rows").alias("rows"))
    )
    needed = F.ceil(F.col("rows") / SEGMENT_ROWS) if segments is None else F.lit(segments)
    number = F.least(needed, F.lit(MOST_SEGMENTS)).cast("int").alias("number")
    size = F.size("sample")
    cuts = F.transform(F.sequence(F.lit(1), F.col("number") - 1), lambda i: F.floor(i * size / F.col("number")).cast("int"))
    taken = F.transform(F.filter(F.array_distinct(cuts), lambda c: c > 0), lambda c: F.get("sample", c))
    return sample.select("sample", number).select(
        F.when(F.col("number") > 1, taken).otherwise(F.slice("sample", 1, 0)).alias("bounds")
    )


def segment_of(columns: Sequence[str], bounds: str) -> Column:
    """How many of the ordered `bounds` a row has reached, by bisection."""
    steps = [2**i for i in reversed(range(MOST_SEGMENTS.bit_length()))]
    own = F.struct(*columns)

    def step(reached: Column, by: Column) -> Column:
        # beyond the last bound there is none to reach
        return F.when(F.get(bounds, reached + by - 1) <= own, reached + by).otherwise(reached)

    # never null, and known not to be: else joins on it would test that on every row of the input first
    return F.coalesce(F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), step), F.lit(0))


def _literal(value, kind: T.DataType) -> Column:
    """A collected value as a literal of its type."""
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*(_literal(v, kind.elementType) for v in value))
    return F.lit(value).cast(kind)

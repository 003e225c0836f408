"""Items that come up again within one group's ordered rows.

Ordinary groups are handled by windows over the group after one shuffle. Groups
too large for a task (see `skew.split_large`) take a second route with the same
answer: equal rows are merged into one row with a number of copies, each merged
row gets its place in the group by `running_total`, and the places are cut into
blocks that are processed apart.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.operators.running import running_total
from adloom.operators.skew import SPLIT_ABOVE, split_large

BLOCK_ROWS = 1_000_000


def count_recent_repeats(
    rows: DataFrame,
    keys: Sequence[str],
    item: str,
    order_by: Sequence[str],
    lookback: int = C.LOOKBACK_ROWS,
    split_above: int = SPLIT_ABOVE,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Per group: `n` rows, and `p` rows whose item is among the `lookback` rows before.

    `sketches` of the written rows, if there are any, tell the large groups without a look at
    the rows (see `skew.split_large`)."""
    if lookback < 1:
        raise ValueError("lookback must be positive")
    order_by = [c for c in _with_tail(order_by, [item]) if c not in keys]
    rows = rows.select(*dict.fromkeys([*keys, item, *order_by]))

    light_rows, heavy_rows = split_large(rows, keys, split_above, sketches)
    if heavy_rows is None:
        return _count_in_window(rows, keys, item, order_by, lookback)
    return _count_in_window(light_rows, keys, item, order_by, lookback).unionByName(
        _count_in_blocks(_as_group(heavy_rows, keys), item, order_by, lookback).select("group.*", "n", "p")
    )


def _count_in_window(rows, keys, item, order_by, lookback) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    same_item = Window.partitionBy(*keys, item).orderBy("place")
    near = F.col("place") - F.lag("place").over(same_item) <= lookback
    return (
        rows.withColumn("place", place)
        .select(*keys, near.alias("near"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("near").alias("p"),
        )
    )


def _count_in_blocks(rows, item, order_by, lookback) -> DataFrame:
    merged = _places(rows, order_by)
    size = max(BLOCK_ROWS, lookback)
    own = _block_of(F.col("first"), size)
    # A merged row matters to the `lookback` places after it: it also goes, as
    # context, to the blocks those places lie in.
    blocks = F.array_distinct(
        F.array(own, _block_of(F.col("last") + 1, size), _block_of(F.col("last") + lookback, size))
    )
    same_item = Window.partitionBy("group", "block", item).orderBy("first")
    near = F.col("first") - F.lag("last").over(same_item) <= lookback
    return (
        merged.withColumn("block", F.explode(blocks))
        .select("group", "copies", (F.col("block") == own).alias("counted"), near.alias("near"))
        .filter("counted")
        .groupBy("group")
        .agg(
            F.sum("copies").alias("n"),
            # every copy but the first directly follows its like
            F.sum(F.col("copies") - F.when(F.col("near"), 0).otherwise(1)).alias("p"),
        )
    )


def repeated_occurrences(
    rows: DataFrame,
    keys: Sequence[str],
    item: str,
    order_by: Sequence[str],
    values: Sequence[str],
    chunk_rows: int = C.CHUNK_ROWS,
    min_repeats: int = C.MIN_REPEATS,
    split_above: int = SPLIT_ABOVE,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of items that come up at least `min_repeats` times in a chunk.

    A group's ordered rows are cut into chunks of `chunk_rows`. Result: the item, its
    `values`, `order` (0 for the item's first row in the chunk) and `copies`, the
    number of equal occurrences: one row for each item, values and order, whatever the
    size of a group. `sketches` are those of `count_recent_repeats`.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    order_by = [c for c in _with_tail(order_by, [item, *values]) if c not in keys]
    rows = rows.select(*dict.fromkeys([*keys, item, *values, *order_by]))

    light_rows, heavy_rows = split_large(rows, keys, split_above, sketches)
    if heavy_rows is None:
        chunked = _chunk_in_window(rows, keys, order_by, chunk_rows)
        return _counted(_keep_repeats(chunked, keys, item, values, min_repeats), item, values)
    light_chunks = _chunk_in_window(light_rows, keys, order_by, chunk_rows)
    heavy_chunks = _chunk_merged(_as_group(heavy_rows, keys), order_by, chunk_rows)
    light_repeats = _keep_repeats(light_chunks, keys, item, values, min_repeats)
    heavy_repeats = _keep_repeats(heavy_chunks, ["group"], item, values, min_repeats)
    return _counted(light_repeats.unionByName(heavy_repeats), item, values)


def _counted(repeats: DataFrame, item: str, values: Sequence[str]) -> DataFrame:
    return repeats.groupBy(item, *values, "order").agg(F.sum("copies").alias("copies"))


def _keep_repeats(chunked, keys, item, values, min_repeats) -> DataFrame:
    in_chunk = Window.partitionBy(*keys, "chunk", item)
    return (
        chunked.withColumn("order", F.row_number().over(in_chunk.orderBy("place")) - 1)
        .withColumn("repeats", F.count(F.lit(1)).over(in_chunk))  # needs no further sort
        .filter(F.col("repeats") >= min_repeats)
        .select(item, *values, "order", "copies")
    )


def _chunk_in_window(rows, keys, order_by, chunk_rows) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("bigint") - 1
    return (
        rows.withColumn("place", place)
        .withColumn("chunk", F.floor(F.col("place") / chunk_rows))
        .withColumn("copies", F.lit(1).cast("bigint"))
    )


def _chunk_merged(rows, order_by, chunk_rows) -> DataFrame:
    """Merged rows cut at chunk borders, one row per place.

    The chunks a merged row fills completely all look alike: one of them is kept,
    with their number as `copies`.
    """
    first, last = F.col("first"), F.col("last")
    head = F.floor(first / chunk_rows)
    tail = F.floor(last / chunk_rows)

    def piece(chunk: Column, copies: Column, start: Column, end: Column) -> Column:
        return F.struct(
            chunk.alias("chunk"), copies.alias("copies"), start.alias("start"), end.alias("end")
        )

    pieces = F.array(
        piece(head, F.lit(1).cast("bigint"), first, F.least(last, (head + 1) * chunk_rows - 1)),
        piece(tail, (tail > head).cast("bigint"), tail * chunk_rows, last),
        piece(head + 1, tail - head - 1, (head + 1) * chunk_rows, (head + 2) * chunk_rows - 1),
    )
    return (
        _places(rows, order_by)
        .drop("copies")
        .withColumn("piece", F.explode(F.filter(pieces, lambda p: p["copies"] > 0)))
        .withColumn("place", F.explode(F.sequence("piece.start", "piece.end")))
        .withColumn("chunk", F.col("piece.chunk"))
        .withColumn("copies", F.col("piece.copies"))
        .drop("first", "last", "piece")
    )


def _as_group(rows, keys) -> DataFrame:
    """The keys as one struct column: unlike the keys it is never null, so joins on it
    keep every row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(F.struct(*keys).alias("group"), *rest)


def _places(rows, order_by) -> DataFrame:
    """Equal rows merged into `copies`, with their `first` and `last` place (from 0)."""
    merged = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    return (
        running_total(merged, "copies", order_by, ["group"])
        .withColumn("first", F.col("running") - F.col("copies"))
        .withColumn("last", F.col("running") - 1)
        .drop("running", "total")
    )


def _block_of(place: Column, size: int) -> Column:
    return F.floor(place / size)


def _with_tail(order_by: Sequence[str], tail: Sequence[str]) -> list[str]:
    """Order columns followed by those that settle ties."""
    return list(dict.fromkeys([*order_by, *tail]))

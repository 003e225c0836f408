"""Joins and lookups on keys."""

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.operators.skew import SPLIT_ABOVE, heavy_counts, heavy_keys, split_by_keys

#: Rows of a large key that are joined in one task, tasks per key at most, and equal rows handled as one.
SALT_ROWS = 1_000_000
MOST_SALTS = 4_096
COPIES = 1_000


def pair_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    split_above: int = SPLIT_ABOVE,
    salted: bool = False,
) -> DataFrame:
    """Equi-join of two keyed relations: inner, left, right or full.

    Adaptive execution splits a large key only on a side that the join may split:
    either side of an inner join, the kept side of a left or right join, none of a
    full join. Keys that are large on another side are looked for and joined apart
    (see `join_apart`). Null keys match nothing; a full join would send them all to
    one task, so there they pass it by.

    With `salted`, large keys are looked for on both sides and spread over tasks by the join itself
    (see `salted_join`), whatever the settings of the session.
    """
    on = list(on)
    if salted:
        return _join_salted(left, right, on, how, split_above)
    apart = []
    if how in ("right", "full"):
        apart.append((heavy_keys(left.select(*on), on, split_above), "inner" if how == "right" else "left"))
    if how in ("left", "full"):
        apart.append((heavy_keys(right.select(*on), on, split_above), "inner" if how == "left" else "right"))
    if how != "full":
        return join_apart(left, right, on, how, apart)
    unmatched = reduce(or_, (F.col(key).isNull() for key in on))
    joined = join_apart(left.filter(~unmatched), right.filter(~unmatched), on, how, apart)
    for side in (left, right):
        joined = joined.unionByName(side.filter(unmatched), allowMissingColumns=True)
    return joined


def join_apart(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    apart: Iterable[tuple[DataFrame | None, str]],
) -> DataFrame:
    """A join with some keys joined on their own, each list with its join type.

    A key that is large on a side exists there, so its rows on the opposite side
    always match. Its join can therefore be of a type that allows a split: a left join
    is an inner join for keys known on the right, a full join a left join for keys
    known on the left.
    """
    on = list(on)
    parts = []
    taken = None
    for heavy, join_type in apart:
        if heavy is None:
            continue
        heavy = heavy.na.drop()
        if taken is not None:
            heavy = heavy.join(taken, on, "left_anti")
        left, heavy_left = split_by_keys(left, on, heavy)
        right, heavy_right = split_by_keys(right, on, heavy)
        parts.append(heavy_left.join(heavy_right, on, join_type))
        taken = heavy
    joined = left.join(right, on, how)
    for part in parts:
        joined = joined.unionByName(part)
    return joined


def _join_salted(left: DataFrame, right: DataFrame, on: list[str], how: str, split_above: int) -> DataFrame:
    """`pair_join` with the large keys of either side joined apart, salted on their larger side."""
    unmatched = reduce(or_, (F.col(key).isNull() for key in on))
    passed_by = [side.filter(unmatched) for side, kept in ((left, "left"), (right, "right")) if how in (kept, "full")]
    left, right = left.filter(~unmatched), right.filter(~unmatched)
    counts = [heavy_counts(side.select(*on), on, split_above) for side in (left, right)]
    if all(c is not None for c in counts):
        both = counts[0].join(counts[1].withColumnRenamed("key_rows", "other_rows"), on, "full")
        both = both.fillna(0, ["key_rows", "other_rows"])
        counts = [
            both.filter("key_rows >= other_rows").drop("other_rows"),
            both.filter("key_rows < other_rows").drop("key_rows").withColumnRenamed("other_rows", "key_rows"),
        ]
    parts = []
    # a key that is large on a side is there, so its rows on the other side all match
    for listed, kind, large_left in (
        (counts[0], "left" if how in ("left", "full") else "inner", True),
        (counts[1], "right" if how in ("right", "full") else "inner", False),
    ):
        if listed is not None:
            keys = listed.select(*on)
            left, heavy_left = split_by_keys(left, on, keys)
            right, heavy_right = split_by_keys(right, on, keys)
            parts.append(salted_join(heavy_left, heavy_right, on, kind, listed, large_left))
    joined = left.join(right, on, how)
    for part in parts:
        joined = joined.unionByName(part)
    for rows in passed_by:
        joined = joined.unionByName(rows, allowMissingColumns=True)
    return joined


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, listed: DataFrame, large_left: bool = True
) -> DataFrame:
    """Equi-join of the rows of the `listed` keys (`on`, key_rows), few enough to broadcast.

    The rows of the larger side are dealt by a hash of the whole row to as many salts as the key
    has stretches of SALT_ROWS rows, and the rows of the other side go to each of them. `how` may keep
    unmatched rows of the larger side alone. Equal rows would share a salt: they are
    counted first and dealt in bundles of COPIES. Which salt a row has depends on nothing but its
    values, so a task that is run again gives the same.
    """
    on = list(on)
    names = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    large, other = (left, right) if large_left else (right, left)
    salts = F.least(F.ceil(F.col("key_rows") / SALT_ROWS), F.lit(MOST_SALTS)).cast("int")
    salts = F.broadcast(listed.select(*on, F.greatest(salts, F.lit(1)).alias("_salts")))
    bundles = F.sequence(F.lit(0), ((F.col("_copies") - 1) / COPIES).cast("int"))
    dealt = (
        large.groupBy(*large.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .join(salts, on)
        .withColumn("_bundle", F.explode(bundles))
        .withColumn("_salt", F.pmod(F.xxhash64(*large.columns, "_bundle"), F.col("_salts")).cast("int"))
        .withColumn("_copies", F.least(F.col("_copies") - F.col("_bundle") * COPIES, F.lit(COPIES)).cast("int"))
        .drop("_salts", "_bundle")
    )
    repeated = other.join(salts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    sides = (dealt, repeated.drop("_salts")) if large_left else (repeated.drop("_salts"), dealt)
    joined = sides[0].join(sides[1], [*on, "_salt"], how)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)


def last_written(writes: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key, the values of the last write in `order_by` order.

    Spark keeps one row per key in each task before it shuffles, so a key written
    very often is no burden.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order_by))
    return (
        writes.select(*dict.fromkeys([*keys, *order_by, *values]))
        .withColumn("nth", F.row_number().over(newest_first))
        .filter(F.col("nth") == 1)
        .select(*keys, *values)
    )


def look_up(rows: DataFrame, single: DataFrame, keys: Sequence[str], heavy: DataFrame | None = None) -> DataFrame:
    """Left join to a relation with at most one row per key.

    `heavy` lists the keys with very many `rows` (see `heavy_keys`). Their rows stay
    where they are: `single` has no more rows for them than there are such keys, few
    enough to broadcast.
    """
    if heavy is None:
        return rows.join(single, list(keys), "left")
    other_rows, heavy_rows = split_by_keys(rows, keys, heavy)
    other_single, heavy_single = split_by_keys(single, keys, heavy)
    return other_rows.join(other_single, list(keys), "left").unionByName(
        heavy_rows.join(F.broadcast(heavy_single), list(keys), "left")
    )


def look_up_last(
    rows: DataFrame,
    writes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    defaults: Mapping[str, object],
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Left lookup of the last written values; a miss gives the defaults."""
    latest = last_written(writes, keys, order_by, list(defaults))
    found = look_up(rows, latest, keys, heavy_keys(rows, keys, split_above))
    return found.withColumns({name: F.coalesce(F.col(name), F.lit(v)) for name, v in defaults.items()})

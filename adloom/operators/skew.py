"""Finding keys too large for one task."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_ABOVE = 5_000_000
MAX_HEAVY_KEYS = 100_000
SAMPLED_ROWS = 10_000
#: Items a sketch follows. It misses no key with more than about 4/SKETCH_ITEMS of all rows.
SKETCH_ITEMS = 65_536
MAX_SKETCHED_KEYS = 10_000


def heavy_keys(
    rows: DataFrame, keys: Sequence[str], above: int = SPLIT_ABOVE, most: int = MAX_HEAVY_KEYS
) -> DataFrame | None:
    """The keys with more than about `above` rows, or None (see `heavy_counts`)."""
    found = heavy_counts(rows, keys, above, most)
    return None if found is None else found.select(*keys)


def heavy_counts(
    rows: DataFrame,
    keys: Sequence[str],
    above: int = SPLIT_ABOVE,
    most: int = MAX_HEAVY_KEYS,
) -> DataFrame | None:
    """The keys with more than about `above` rows, and about how many (`key_rows`), or None.

    Being listed never changes an answer, only the way it is computed. So the rows may
    be counted on a sample, large enough for a key of `above` rows to show
    `SAMPLED_ROWS` times; every listed key does exist in `rows`. A key is listed from
    `above` rows or 1/`most` of all rows on, whichever is more: at most `most` keys can
    have as many, so the list is whole, and bounded enough to be broadcast.
    """
    keyed = rows.select(*keys)
    fraction = min(1.0, SAMPLED_ROWS / max(above, 1))
    if fraction < 1:
        keyed = keyed.sample(fraction, seed=0)
    seen = Observation()
    largest = (
        keyed.observe(seen, F.count(F.lit(1)).alias("rows"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("key_rows"))
        .filter(F.col("key_rows") > above * fraction)
        .orderBy(F.desc("key_rows"))
        .limit(most)
    )
    counted = largest.collect()
    least = max(above * fraction, seen.get["rows"] / most) if counted else 0
    found = [(*(r[k] for k in keys), round(r["key_rows"] / fraction)) for r in counted if r["key_rows"] > least]
    if not found:
        return None
    return rows.sparkSession.createDataFrame(found, T.StructType([*keyed.schema.fields, T.StructField("key_rows", T.LongType())]))


def split_by_keys(rows: DataFrame, keys: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of the heavy keys). `heavy` comes from `heavy_keys`; a
    null key is a key like any other."""
    listed = F.broadcast(heavy.toDF(*(f"heavy_{key}" for key in keys)))
    same = reduce(and_, (F.col(key).eqNullSafe(F.col(f"heavy_{key}")) for key in keys))
    return rows.join(listed, same, "left_anti"), rows.join(listed, same, "left_semi")


def key_name(keys: Sequence[str]) -> Column:
    """A 64-bit name of a key by its text, so that it is the same however the key is stored."""
    return F.xxhash64(*(F.col(key).cast("string") for key in keys))


def key_sketch(keys: Sequence[str]) -> Column:
    """An aggregate that follows the most frequent keys in bounded memory; sketches of parts
    of a table can be combined."""
    return F.call_function("approx_top_k_accumulate", key_name(keys), F.lit(SKETCH_ITEMS))


def sketched_keys(
    sketches: DataFrame, above: int = SPLIT_ABOVE, most: int = MAX_SKETCHED_KEYS
) -> DataFrame | None:
    """`key_name` of the keys with more than about `above` rows, or None, from `sketches` (rows, sketch) of the parts of
    a table, without looking at it.

    As with `heavy_keys` a key is listed from 1/`most` of all rows on, so the list is bounded.
    """
    combined = sketches.agg(
        F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(SKETCH_ITEMS)).alias("sketch"), F.sum("rows").alias("rows")
    )
    best = F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(most))
    found = combined.select("rows", F.explode(best).alias("best")).select("rows", "best.*")
    listed = found.filter((F.col("count") > above) & (F.col("count") > F.col("rows") / most)).collect()
    if not listed:
        return None
    return sketches.sparkSession.createDataFrame([(r["item"],) for r in listed], "key_name bigint")


def split_large(
    rows: DataFrame, keys: Sequence[str], above: int = SPLIT_ABOVE, sketches: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than about `above` rows or None).

    With `sketches` of the rows' table (see `key_sketch`) the rows are not looked at to find
    such keys.
    """
    if sketches is None:
        heavy = heavy_keys(rows, keys, above)
        return (rows, None) if heavy is None else split_by_keys(rows, keys, heavy)
    listed = sketched_keys(sketches, above)
    if listed is None:
        return rows, None
    named = rows.withColumn("key_name", key_name(keys))
    return tuple(part.drop("key_name") for part in split_by_keys(named, ["key_name"], listed))

"""Mixing sources to target weights along a curriculum.

A source's share of the mix changes over training: its weight at time t in [0, 1] is a
straight line, and the integral of that line is its demand for tokens up to t. The rows of a
source form a stream in random but fixed order, repeated as often as the source's target asks.
The training position of a row's copy is the time at which demand reaches it: the inverse of
the cumulative demand at the tokens before it. What lies beyond the whole demand isn't taken.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import FILE_ROWS, WORD, numbered, offsets, stored, unused

REPEATS = 3
SEED = 20240501
#: Change of a source's weight from begin to end, as a part of its mean: the weights 1, 2, 3 fall, stay and rise.
SLOPES = (-0.6, 0.0, 0.6)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """`sizes` (source, source_size) with weight, target and slope.

    Sources in order of their code points (null last) get `weights` in turn. The targets share
    the sum of all sizes by weight; one stops at `repeats` times its source's size and the rest
    of its share goes to the others by weight, until none is above. The table of sources is one
    row per source; only sums over it reach the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    turn = place % len(weights)
    of_turn = F.array(*[F.lit(float(w)) for w in weights])
    slopes = F.array(*[F.lit(float(SLOPES[i % len(SLOPES)])) for i in range(len(weights))])
    sizes = sizes.select(
        "source", "source_size", F.get(of_turn, turn).alias("weight"), F.get(slopes, turn).alias("slope")
    )
    sizes = stored(sizes, "sources")
    most = F.col("source_size") * F.lit(float(repeats))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = most < F.col("weight") * F.lit(level)
        held, weight, n = sizes.agg(
            F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n == capped or not weight:
            break
        level, capped = (total - (held or 0.0)) / weight, n
    return sizes.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _position(before: Column, target: Column, slope: Column) -> Column:
    """The time at which a demand of target * (t + slope * (t * t - t)) reaches `before`."""
    part = F.when(target > 0, before / target).otherwise(F.lit(1.0))
    linear = 1 - slope
    root = F.sqrt(F.greatest(linear * linear + 4 * slope * part, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, part).otherwise((root - linear) / (2 * slope))


def schedule(
    docs: DataFrame, weights: tuple = (1, 2, 3), repeats: int = REPEATS, seed: int = SEED, row: str | None = None
) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken, whole and
    positions.

    `taken` counts the words the mix takes from the row, repeats included; `positions` has the
    training position, 0 to 1, of each copy taken; `whole` is how many of the copies lie for at least
    half within the demand. Rows without words are taken as empty. Rows that repeat a doc_id
    follow one another in the stream. Null sources are one source, null texts have size 0; more
    columns are ignored and an empty table gives an empty result. `row` may name a column that
    numbers the rows of `docs`: it is returned too, and rows that repeat a doc_id, or have none, lie
    apart in the stream by their texts.
    """
    order, own = F.xxhash64(F.lit(seed), "doc_id", *(["text"] if row else [])), [row] if row else []
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), order.alias("_order"), *own)
    rows = stored(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    placed = offsets(rows, "source", "_order", ["doc_id", "size", *own], "size")
    named = targets.withColumnRenamed("source", "_source")
    joined = placed.join(named, F.col("source").eqNullSafe(F.col("_source")))
    size, target = F.col("size"), F.col("target")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: (F.col("before") + k * F.col("source_size")).cast("double")
    )
    taken = F.aggregate(
        copies, F.lit(0.0),
        lambda sum_, begin: sum_ + F.greatest(F.least(target - begin, size.cast("double")), F.lit(0.0)),
    )
    inside = F.filter(copies, lambda begin: begin < target)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        F.floor(taken).cast("long").alias("taken"),
        F.size(F.filter(copies, lambda begin: begin + size / 2 < target)).alias("whole"),
        F.transform(inside, lambda begin: _position(begin, target, F.col("slope"))).alias("positions"),
        *own,
    )


def in_order(planned: DataFrame, number: str | None = None) -> DataFrame:
    """One row per copy taken, range-sorted by training position: doc_id, source, size, copy, position and rank.

    `rank` counts the copies in order from 0; ties are settled by doc_id (null first), copy and the column `number`
    of `planned`, which is returned too. The sorted copies lie in files by range, so a rank is the place in the file and
    the rows of the files before it: one row per file is all that meets.
    """
    own = [number] if number else []
    each = planned.select("doc_id", "source", "size", *own, F.posexplode("positions").alias("copy", "position"))
    lying = numbered(stored(each.orderBy("position", "doc_id", "copy", *own), "order"), "_place")
    file = F.floor(F.col("_place") / FILE_ROWS)
    counts = lying.groupBy(file.alias("_file")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = lying.withColumn("_file", file).join(counts, "_file")
    rank = F.col("_before") + F.col("_place") % FILE_ROWS
    return ranked.select(*each.columns, rank.alias("rank"))


def mixed(docs: DataFrame, weights: tuple = (1, 2, 3), repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Per row of `docs` (doc_id, text, source) what `schedule` tells, and `ranks`: the place of each copy taken among
    all copies in order of training.

    Null, empty and repeated rows and empty tables as in `schedule`; rows that repeat a doc_id are kept apart.
    """
    rows = numbered(docs, unused(docs, "_row"))
    rows = rows.select("doc_id", "text", "source", F.col(rows.columns[-1]).alias("number"))
    planned = stored(schedule(rows, weights, repeats, seed, row="number"), "planned")
    copies = in_order(planned, "number").groupBy("number").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    none = F.array().cast("array<long>")
    return planned.join(copies, "number", "left").withColumn("ranks", F.coalesce("ranks", none)).drop("number")

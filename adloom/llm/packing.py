"""Sharding by vector bin packing.

Groups of equal texts are items with three sizes: bytes, words and rows. Each item, largest
first, goes to the shard where the dot product of its sizes with the shard's residual
capacity is highest. Small groups are packed in bundles by the hash of their text, large ones
alone, so the number of items has a fixed bound whatever the input. A group larger than a shard's
share can't stay together: its rows are dealt over PARTS items of their own.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import offsets, stored
from adloom.llm.curriculum import words_in

SHARDS = 16
#: Bundles per shard. A group above a bundle's mean size is an item of its own, so there are at most
#: four times as many items: one for each bundle and for each such group by bytes, words and rows.
BUNDLES = 512
PARTS = 256
LAW = "bytes"


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (bytes, words, rows), placed by dot product with residual capacity."""
    share = items / np.maximum(items.sum(axis=0), 1.0)
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    placed = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        placed[i] = at = int(np.argmax(residual @ share[i]))
        residual[at] -= share[i]
    return placed


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of `docs` (doc_id, text; more are ignored): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the bytes of the text and one more, a null text counts as empty; equal texts share
    a shard unless they exceed a shard's capacity. The law that holds is `bytes`: sizes of shards
    are near equal, as are words and rows. `slot` counts a shard's rows from 0 without a gap;
    `grown_shard` is null, as no law for more shards is kept. Null and repeated doc_ids are rows
    like others, also where the text is equal; an empty table gives an empty result. Slots, and the shards of
    groups above a shard's share, also depend on where a row is in the files of `docs`.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), words_in(text).alias("words"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        # with a number that is kept with the row: rows equal in all else must not meet in one part
        F.xxhash64(F.col("doc_id"), text, F.monotonically_increasing_id()).alias("_order"),
    )
    rows = stored(rows, "rows")
    # crc32 and length besides the hash: unequal texts that share all three would only share a shard
    key = ["group", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(
        F.sum("size").alias("bytes"), F.sum("words").alias("all_words"), F.count("*").alias("rows")
    )
    groups = stored(groups, "groups")
    sums = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "all_words", "rows")]).first()
    part = _largest_part(sums)
    item = (
        F.when(part > 1 / shards, F.lit(2))
        .when(part > 1 / (shards * BUNDLES), F.lit(1))
        .otherwise(F.lit(0))
    )
    bundle = F.pmod("group", F.lit(shards * BUNDLES))
    kinds = groups.withColumn("kind", item)
    large = stored(kinds.filter("kind > 0"), "large")
    bundles = kinds.filter("kind = 0").groupBy(bundle.alias("bundle")).agg(
        F.sum("bytes").alias("bytes"), F.sum("all_words").alias("all_words"), F.sum("rows").alias("rows")
    )
    spread = F.when(F.col("kind") == 2, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    split = F.when(F.col("kind") == 2, F.lit(float(PARTS))).otherwise(F.lit(1.0))
    single = large.select(*key, F.explode(spread).alias("part"), *[(F.col(c) / split).alias(c) for c in ("bytes", "all_words", "rows")])
    some = bundles.orderBy("bundle").collect()
    alone = single.orderBy(*key, "part").collect()
    items = np.array([[r["bytes"], r["all_words"], r["rows"]] for r in [*some, *alone]], float).reshape(-1, 3)
    placed = pack(items, shards).tolist()
    spark = docs.sparkSession
    of_bundle = spark.createDataFrame(
        [(r["bundle"], s) for r, s in zip(some, placed)], "bundle long, bundle_shard int"
    )
    of_group = spark.createDataFrame(
        [(r["group"], r["text_crc32"], r["size"], r["part"], s) for r, s in zip(alone, placed[len(some):])],
        "group long, text_crc32 long, size long, part int, own_shard int",
    )
    own = of_group.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("part", "own_shard"))).alias("own"))
    which = F.when(F.size("own") > 1, F.pmod("_order", F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    # both lists have the fixed bound above
    joined = rows.join(F.broadcast(own), key, "left").withColumn("bundle", bundle)
    joined = joined.join(F.broadcast(of_bundle), "bundle", "left")
    shard = F.coalesce(F.element_at("own", which), "bundle_shard").alias("shard")
    dealt = stored(joined.select("doc_id", "size", "text_crc32", shard, "_order", F.lit(1).alias("one")), "dealt")
    return offsets(dealt, "shard", "_order", ["doc_id", "size"], "one").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        F.col("before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _largest_part(sums) -> Column:
    """The largest part that a group has of all bytes, words or rows."""
    parts = [F.col(c) / F.lit(float(max(1, s))) for c, s in zip(("bytes", "all_words", "rows"), sums)]
    return F.greatest(*parts)

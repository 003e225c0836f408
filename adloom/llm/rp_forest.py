"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the rows of a label again and again by a random direction, until a leaf holds
at most LEAF rows. Rows nearer to a split than half the distance at the threshold go to both
sides (spill), so a tree parts few linked pairs at any size or density, and other trees make up
for those. The split is where the two sides need the fewest comparisons. A node that no split
makes much cheaper is dense: it is split no more, and compared in pairs of blocks
that are spread over tasks. Within leaves all pairs are compared exactly; links are united over
all leaves. All levels are Spark passes over all rows, without a sample.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import components, forget, stored

COSINE = 0.93
TREES = 6
LEAF = 512
#: Width of the band of a split whose rows go to both sides, in distances at the threshold. A pair at
#: the threshold differs by a normal deviate of that distance along a random direction.
SPILL = 1.0
#: A split must bring the comparisons down to this part, or the node is a leaf however large.
WORTH = 0.8
#: Rows of a block of such a leaf, and the number of quantiles that splits are chosen from.
BLOCK = 2048
STEPS = 64
#: From so many links in a group on, common leaves are found for all pairs at once.
MANY_LINKS = 20_000


def _unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, unit): the vector of length one as doubles; only usable rows."""

    def scan(batches):
        for batch in batches:
            ids, labels, units = [], [], []
            for vec_id, label, values in zip(batch["vec_id"], batch["label"], batch["embedding"]):
                v = np.array(values, np.float64)
                scale = np.abs(v).max(initial=0.0)
                if not np.isfinite(scale) or scale == 0 or not np.isfinite(v).all():
                    continue
                v = v / scale
                ids.append(vec_id)
                labels.append(label)
                units.append((v / np.sqrt(v @ v)).tobytes())
            yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "label": labels, "unit": units})

    whole = ~F.exists("embedding", lambda x: x.isNull())
    usable = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    usable = usable.filter(whole).select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return usable.mapInPandas(scan, "vec_id long, label string, unit binary")


def _direction(path: str, dim: int, kept: dict) -> np.ndarray:
    """The random direction of a node, the same in every task."""
    if (path, dim) not in kept:
        if len(kept) > 5_000:
            kept.clear()
        seed = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little")
        kept[path, dim] = np.random.Generator(np.random.PCG64(seed)).standard_normal(dim)
    return kept[path, dim]


def _projected(nodes: DataFrame) -> DataFrame:
    """(label, path, vec_id, unit, at): the projection on the node's own direction."""

    def scan(batches):
        kept: dict = {}
        for batch in batches:
            at = [
                float(np.frombuffer(unit) @ _direction(path, len(unit) // 8, kept))
                for path, unit in zip(batch["path"], batch["unit"])
            ]
            yield batch.assign(at=np.array(at, np.float64))

    return nodes.mapInPandas(scan, "label string, path string, vec_id long, unit binary, at double")


def _cut(at: Column, width: float) -> Column:
    """(cost, cut) of the best split by the quantiles `at`: the comparisons left of those of the whole node."""

    def priced(c: Column) -> Column:
        left = F.size(F.filter(at, lambda x: x <= c + width / 2)) / (STEPS + 1)
        right = F.size(F.filter(at, lambda x: x >= c - width / 2)) / (STEPS + 1)
        return F.struct((left * left + right * right).alias("cost"), c.alias("cut"))

    return F.array_min(F.transform(at, priced))


def _leaves(vectors: DataFrame, trees: int, leaf: int, width: float) -> DataFrame:
    """(label, path, vec_id, unit, blocks) of every row in every leaf it belongs to; path starts with the tree."""
    tree = F.explode(F.array(*[F.lit(f"{t}:") for t in range(trees)]))
    nodes = vectors.select("label", tree.alias("path"), "vec_id", "unit")
    done, now = [], stored(_projected(nodes), "nodes")
    quantiles = F.percentile_approx("at", [k / STEPS for k in range(STEPS + 1)], 1000)
    while True:
        sizes = now.groupBy("label", "path").agg(F.count("*").alias("n"), quantiles.alias("quantiles"))
        sizes = stored(sizes.select("label", "path", "n", _cut(F.col("quantiles"), width).alias("best")), "sizes")
        ends = (F.col("n") <= leaf) | (F.col("best.cost") > WORTH)
        blocks = F.when(F.col("n") <= leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks")
        done.append(now.drop("at").join(sizes.filter(ends).select("label", "path", blocks), ["label", "path"]))
        large = sizes.filter(~ends).select("label", "path", F.col("best.cut").alias("cut"))
        if not large.head(1):
            break
        left, right = F.col("at") <= F.col("cut") + width / 2, F.col("at") >= F.col("cut") - width / 2
        sides = F.filter(
            F.array(F.when(left, F.concat("path", F.lit("0"))), F.when(right, F.concat("path", F.lit("1")))),
            lambda p: p.isNotNull(),
        )
        split = now.join(large, ["label", "path"])
        now = stored(_projected(split.select("label", F.explode(sides).alias("path"), "vec_id", "unit")), "nodes")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    return leaves.select("label", "path", "vec_id", "unit", "blocks")


def _first_common(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row by row the smallest leaf that is in both; leaves are padded with different negative numbers."""
    low = np.full(len(own), np.iinfo(np.int64).max)
    for k in range(own.shape[1]):
        mine = own[:, k]
        low = np.where((other == mine[:, None]).any(axis=1) & (mine < low), mine, low)
    return low


def _lower_leaf(leaves: pd.Series, leaf: int) -> np.ndarray:
    """Pair by pair of rows, whether a leaf with a smaller number holds both."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in leaves])
    owner = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    owner, flat = owner[flat < leaf], flat[flat < leaf]
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    member = np.zeros((len(leaves), int(shared.sum())), np.float32)
    member[owner[shared[column]], place[column[shared[column]]]] = 1
    return member @ member.T > 0


def _compared(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links within one leaf or between two blocks of it: per row those whose first common leaf this is, and its local root."""
    n, leaf = len(rows), int(rows["leaf"].iloc[0])
    rows = rows.sort_values("vec_id", ignore_index=True)
    ids, copies, block = rows["vec_id"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    units = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(n, -1)
    near = np.triu(units @ units.T >= least, 1)
    if rows["one"].iloc[0] != rows["two"].iloc[0]:
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    links = np.zeros(n, np.int64)
    if not len(i):
        return pd.DataFrame({"vec_id": ids[:0], "links": links[:0], "root": ids[:0]})
    if len(i) > MANY_LINKS:
        near &= ~_lower_leaf(rows["leaves"], leaf)
        links += np.array([copies[r].sum() for r in near]) + copies @ near
    else:
        width = max(map(len, rows["leaves"]))
        all_leaves = np.full((n, width), -1, np.int64)
        for k, values in enumerate(rows["leaves"]):
            all_leaves[k, : len(values)] = values
        others = np.where(all_leaves == -1, -2, all_leaves)
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            first = _first_common(all_leaves[a], others[b]) == leaf
            np.add.at(links, a[first], copies[b[first]])
            np.add.at(links, b[first], copies[a[first]])
    root = np.arange(n)
    while True:  # labels fall to the smallest neighbour until nothing changes
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = (root != np.arange(n)) | (links > 0)
    return pd.DataFrame({"vec_id": ids[linked], "links": links[linked], "root": ids[root[linked]]})


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `rows` (vec_id, embedding, label; more are ignored).

    Vectors link when labels are equal and not null and the cosine is at least `cosine`, in
    doubles. Equal vectors of a label are one node with a number of copies. Null, empty and
    zero vectors, those with null or non-finite components, of another length than their
    partner, or without an id link with nothing and are kept. An empty table gives an empty
    result. Rows that repeat an id count as copies if their vectors are equal; else their
    links are added up.
    """
    vectors = stored(_unit_vectors(rows), "vectors")
    shape = F.concat_ws("/", "label", F.length("unit").cast("string"))
    same = vectors.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    same = stored(same, "same")
    one = same.select(shape.alias("label"), F.col("node").alias("vec_id"), "unit")
    width = spill * float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    placed = _leaves(one, trees, leaf, width).withColumn("leaf", F.abs(F.xxhash64("label", "path")))
    placed = stored(placed.drop("path"), "leaves")
    of_row = placed.groupBy("label", "vec_id").agg(F.collect_set("leaf").alias("leaves"))
    copies = same.select(shape.alias("label"), F.col("node").alias("vec_id"), "copies")
    full = placed.join(of_row, ["label", "vec_id"]).join(copies, ["label", "vec_id"])

    # a row of a leaf of many blocks meets every block once
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    full = full.withColumn("block", block).select("*", other).withColumns(
        {"one": F.least("block", "other"), "two": F.greatest("block", "other")}
    )

    def compare(_, group):
        return _compared(group, cosine)

    columns = ["leaf", "one", "two", "block", "vec_id", "unit", "copies", "leaves"]
    found = full.select(*columns).groupBy("leaf", "one", "two").applyInPandas(
        compare, "vec_id long, links long, root long"
    )
    found = stored(found, "links")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    nodes = same.select("label", "unit", "node", "copies")
    nodes = nodes.join(links.withColumnRenamed("vec_id", "node"), "node", "left").join(joined, "node", "left")
    nodes = nodes.select(
        "label", "unit",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    per_id = vectors.join(nodes, ["label", "unit"]).groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    forget(placed)
    return rows.select("vec_id").join(per_id, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )

"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct n-word shingles. Sets are put in one global order, rare
shingles first, by a table of counts over all documents. Of each set only a prefix is indexed:
rare shingles one by one, frequent ones as pairs within one of 64 classes. A prefix runs on
until the shingles that two similar sets may differ in cannot break every signature, so a
similar pair always shares one. Shared signatures are only candidates: every link compares
whole sets. Shingles are equal when their 64-bit names are, hashes of all bytes of their words.

Frequent passages and large groups of near copies would make as many candidates as the square
of their number. Each set is therefore first compared with one partner; sets already connected
are not compared again, which changes no component.
"""

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import components, forget, stored

WORDS = 5
PERCENT = 80
#: Size of the table of counts, fixed whatever the input: 4 MB.
TABLE = 1 << 20
SLICE = 1 << 16
#: A shingle is frequent if its place counts so many more, or standard deviations more, than the mean.
FREQUENT = 64
DEVIATIONS = 6
#: Classes of frequent shingles; sets up to SMALL shingles index single ones, as their prefix could run out.
CLASSES = 64
SMALL = 96
ROUNDS = 2
#: Signatures that a set and its partner share, as a part of its shingles; what falls short is left for the end.
MANY = 0.04
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words up to so many bytes are hashed side by side, eight bytes a step.
SHORT = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
BLOCK_BYTES = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in the bytes and a 64-bit name of the lower-cased word.

    A name is a chain of mixing steps over the word's length and all its bytes, for long words a common hash of them.
    """
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(_IS_SPACE[b], prepend=True, append=True)
    begin, end = np.flatnonzero(edge)[0::2], np.flatnonzero(edge)[1::2]
    lower = _LOWER[np.concatenate([b, np.zeros(8, np.uint8)])]
    eights = np.ndarray((len(b) + 1,), "<u8", lower.data, strides=(1,))
    length = end - begin
    names = _mixed(length.astype(np.uint64) + _ODD[0])
    todo = np.flatnonzero(length <= SHORT)
    for at in range(0, SHORT, 8):
        todo = todo[length[todo] > at]
        if not len(todo):
            break
        part = eights[begin[todo] + at] & _MASK[np.minimum(length[todo] - at, 8)]
        names[todo] = _mixed((names[todo] ^ part) * _ODD[1] + _ODD[2])
    for i in np.flatnonzero(length > SHORT):
        names[i] = xxhash.xxh3_64_intdigest(lower[begin[i] : end[i]].tobytes())
    return begin, names


def shingle_sets(texts, n: int = WORDS):
    """Per text the sorted 64-bit names of its distinct n-word shingles; A-Z lower-cased, words by ASCII white space."""
    block, size = [], 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size > BLOCK_BYTES:
            yield from _sets_of_block(block, n)
            block, size = [], 0
    yield from _sets_of_block(block, n)


def _sets_of_block(block: list[bytes], n: int):
    begin, words = _word_names(b" ".join(block))
    starts = np.cumsum([0] + [len(x) + 1 for x in block])
    first = np.searchsorted(begin, starts)
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        total += words[i : i + len(total)] * (_ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD))))
    total = _mixed(total)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            found = np.sort(total[a : b - n + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            few = words[a:b] * _ODD[: b - a] if b - a <= len(_ODD) else words[a:b]
            yield _mixed(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _names(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a whole set as two integers."""
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(int(x) for x in np.frombuffer(digest, np.int64))


def _measured(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, d1, d2, size) per row; kind 1: (slice number, counts) per task and slice."""

    def scan(batches):
        table = np.zeros(TABLE, np.int32)
        for batch in batches:
            ids, first, second, sizes = [], [], [], []
            for doc_id, tokens in zip(batch["doc_id"], shingle_sets(batch["text"], n)):
                a, b = _names(tokens) if len(tokens) else (None, None)
                ids.append(None if doc_id is None else int(doc_id))
                first.append(a)
                second.append(b)
                sizes.append(len(tokens))
                np.add.at(table, (tokens & np.uint64(TABLE - 1)).astype(np.int64), 1)
            made = {"kind": 0, "doc_id": pd.array(ids, "Int64"), "d1": pd.array(first, "Int64"),
                    "d2": pd.array(second, "Int64"), "size": sizes, "counts": None}
            yield pd.DataFrame(made)
        for i in range(TABLE // SLICE):
            part = table[i * SLICE : (i + 1) * SLICE]
            if part.any():
                yield pd.DataFrame({"kind": [1], "doc_id": [i], "d1": [None], "d2": [None], "size": [0],
                                    "counts": [zlib.compress(part.tobytes(), 1)]})

    schema = "kind int, doc_id long, d1 long, d2 long, size int, counts binary"
    # as text, since pandas would turn integers with nulls into floats
    return docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(scan, schema)


def _count_table(measured: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables; its size is fixed."""

    def add(key, rows):
        total = np.zeros(SLICE, np.int64)
        for part in rows["counts"]:
            total += np.frombuffer(zlib.decompress(part), np.int32)
        capped = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(capped.tobytes(), 1)]})

    tasks = F.pmod(F.xxhash64("counts"), F.lit(16))

    def merge(rows, *keys):
        return rows.groupBy("doc_id", *keys).applyInPandas(add, "slice long, counts binary")

    parts = measured.filter("kind = 1").select("doc_id", "counts")
    parts = merge(parts, tasks).select(F.col("slice").alias("doc_id"), "counts")
    table = np.zeros(TABLE, np.int32)
    for i, counts in merge(parts).collect():
        table[i * SLICE : (i + 1) * SLICE] = np.frombuffer(zlib.decompress(counts), np.int32)
    return table


def _places(single: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each shingle in order, how many losses the signatures before it survive: rare shingles
    count one each, those of a class one less than their number."""
    gain = np.ones(len(single), np.int64)
    frequent = np.flatnonzero(~single)
    _, first = np.unique(group[frequent], return_index=True)
    gain[frequent[first]] = 0
    return np.cumsum(gain) - gain


def probe_length(size, percent: int):
    """How many shingles of a set must be indexed singly."""
    return size - (percent * size + 99) // 100 + 1


def signatures(tokens: np.ndarray, table: np.ndarray, limit: float, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The signatures of one set, their places, and whether they are just its first single shingles.

    Two sets that must share `o` shingles have a signature in common whose place is at most
    size - o in both.
    """
    size = len(tokens)
    count = table[(tokens & np.uint64(TABLE - 1)).astype(np.int64)]
    order = np.lexsort((tokens, count))
    probe = probe_length(size, percent)
    if size <= SMALL or count[order[-1]] <= limit:
        return tokens[order[:probe]], np.arange(probe), True
    tokens, count = tokens[order], count[order]
    single = count <= limit
    group = (tokens >> np.uint64(40)).astype(np.int64) % CLASSES
    place = _places(single, group)
    length = int(np.searchsorted(place, probe))
    rare = np.flatnonzero(single[:length])
    found, places = [tokens[rare]], [place[rare]]
    if size * percent <= SMALL * 100:  # a similar set may be small and index single shingles
        extra = np.flatnonzero(~single[:probe])
        found.append(tokens[extra])
        places.append(extra)
    frequent = np.flatnonzero(~single[:length])
    frequent = frequent[np.argsort(group[frequent], kind="stable")]
    starts = np.flatnonzero(np.diff(group[frequent], prepend=-1))
    for members in np.split(frequent, starts[1:]):
        i, j = np.triu_indices(len(members), 1)
        found.append(_mixed(tokens[members[i]] * _ODD[0] ^ _mixed(tokens[members[j]] + _ODD[1])))
        places.append(place[members[j]])
    return np.concatenate(found), np.concatenate(places), length == probe and not len(frequent)


def _postings(docs: DataFrame, table: np.ndarray, n: int, percent: int) -> DataFrame:
    """(sig, d1, meta) of each distinct set of a task once; meta packs size, place and plain."""
    mean = float(table.mean(dtype=np.float64))
    limit = FREQUENT + mean + DEVIATIONS * mean**0.5
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        seen = set()
        for batch in batches:
            made, rows = [], 0
            for tokens in shingle_sets(batch["text"], n):
                if not len(tokens):
                    continue
                name = _names(tokens)
                if name in seen:
                    continue
                seen.add(name)
                sig, place, plain = signatures(tokens, shared.value, limit, percent)
                meta = np.int64(len(tokens)) << np.int64(32) | place.astype(np.int64) << 1 | np.int64(plain)
                made.append((sig.view(np.int64), np.full(len(sig), name[0]), meta))
                rows += len(sig)
                if rows > 200_000:
                    yield _frame(made)
                    made, rows = [], 0
            if made:
                yield _frame(made)

    return docs.select("text").mapInPandas(scan, "sig long, d1 long, meta long")


def _frame(made):
    return pd.DataFrame({k: np.concatenate([m[i] for m in made]) for i, k in enumerate(("sig", "d1", "meta"))})


def _shared_only(postings: DataFrame) -> DataFrame:
    """Rows whose signature is in two sets at least, found in one pass over sorted rows."""

    def scan(batches):
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            sig = batch["sig"].to_numpy()
            ends = np.flatnonzero(sig[1:] != sig[:-1])
            # the last run may go on; of a long one only its last row waits, as the rest is known to be shared
            cut = int(ends[-1]) + 1 if len(ends) else 0
            known = left is not None and bool(left["known"].iloc[-1])
            keep = np.zeros(len(sig), bool)
            equal = sig[1:] == sig[:-1]
            keep[1:] |= equal
            keep[:-1] |= equal
            if known:
                keep[sig == sig[0]] = True
            if cut == 0 and len(sig) > 1:
                cut = len(sig) - 1
            batch["known"] = keep
            out = batch[:cut][keep[:cut]]
            left = batch[cut:]
            yield out.drop(columns="known")
        if left is not None:
            yield left[left["known"]].drop(columns="known")

    ordered = postings.repartition("sig").sortWithinPartitions("sig")
    return ordered.mapInPandas(scan, "sig long, d1 long, meta long")


def _bitmap(names: DataFrame, bits: int = 1 << 25) -> np.ndarray:
    """Which values of d1 modulo a fixed number occur: a coarse filter of 4 MB, exact joins follow."""
    slices = 64

    def pack(key, rows):
        marks = np.zeros(bits // slices, bool)
        marks[rows["at"].to_numpy()] = True
        return pd.DataFrame({"slice": [key[0]], "marks": [np.packbits(marks).tobytes()]})

    at = F.pmod("d1", F.lit(bits))
    spots = names.select((at / F.lit(bits // slices)).cast("int").alias("slice"), (at % (bits // slices)).alias("at"))
    out = np.zeros((slices, bits // slices // 8), np.uint8)
    for i, marks in spots.distinct().groupBy("slice").applyInPandas(pack, "slice int, marks binary").collect():
        out[i] = np.frombuffer(marks, np.uint8)
    return out.reshape(-1)


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the given (node, d1, d2)."""
    bits = 1 << 25
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def scan(batches):
        seen = set()
        for batch in batches:
            rows = []
            for tokens in shingle_sets(batch["text"], n):
                if not len(tokens):
                    continue
                a, b = _names(tokens)
                at = a % bits
                if (a, b) in seen or not marks.value[at >> 3] >> (7 - (at & 7)) & 1:
                    continue
                seen.add((a, b))
                rows.append((a, b, tokens.view(np.int64)))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=["d1", "d2", "tokens"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["d1", "d2", "tokens"])

    found = docs.select("text").mapInPandas(scan, "d1 long, d2 long, tokens array<long>")
    return found.join(nodes, ["d1", "d2"]).dropDuplicates(["node"]).select("node", "tokens")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose whole sets are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = both.select("a", "b", common.alias("common"), (F.size("a_tokens") + F.size("b_tokens")).alias("sum"))
    return both.filter(F.col("common") * 100 >= percent * (F.col("sum") - F.col("common"))).select("a", "b")


def _with_component(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with the component of each set; only signatures whose sets aren't all connected yet."""
    if found is None:
        return postings.withColumn("comp", F.col("node"))
    named = postings.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    spread = named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return named.join(spread.filter("low < high").select("sig", "low"), "sig")


def _near_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _overlap(a: str, b: str, percent: int):
    """How many shingles two sets of these sizes must share."""
    return F.ceil((F.col(a) + F.col(b)) * percent / F.lit(100 + percent))


def _partners(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each set one set of another component that many of its signatures lead to.

    A signature leads to the set that shares most of itself with others, as the original of
    edited copies does, and in later turns to any.
    """
    order = F.struct(F.lit(0) if turn else -F.col("part"), F.xxhash64(F.lit(turn), "node"), "node")
    leads = postings.groupBy("sig").agg(F.min_by(F.struct("node", "size", "comp"), order).alias("lead"))
    near = postings.join(leads, "sig").filter(
        (F.col("comp") != F.col("lead.comp")) & _near_sizes("size", "lead.size", percent)
    )
    shared = near.groupBy("node", F.col("lead.node").alias("other")).agg(F.count("*").alias("n"), F.first("size").alias("size"))
    many = shared.filter(F.col("n") >= F.col("size") * MANY)
    best = many.groupBy("node").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"))
    return best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _rest(postings: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """All pairs not connected yet that can be similar by the signatures they share."""
    names = ("node", "size", "place", "plain", "comp")
    x = postings.filter("comp != low").select("sig", *[F.col(c).alias(f"x_{c}") for c in names])
    y = postings.select("sig", *[F.col(c).alias(f"y_{c}") for c in names], "low")
    wanted = _overlap("x_size", "y_size", percent)
    both = x.join(y, "sig").filter(
        (F.col("x_comp") != F.col("y_comp"))
        & ((F.col("y_comp") == F.col("low")) | (F.col("x_node") < F.col("y_node")))
        & _near_sizes("x_size", "y_size", percent)
        & (F.col("x_place") <= F.col("x_size") - wanted)
        & (F.col("y_place") <= F.col("y_size") - wanted)
    )
    ends = [F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")]
    sizes = [F.least("x_size", "y_size").alias("small"), F.greatest("x_size", "y_size").alias("large")]
    pairs = both.select(*ends, *sizes, (F.col("x_plain") & F.col("y_plain")).alias("plain")).distinct()
    # if two sets index just their first shingles, the one whose prefix ends first has all that it shares
    # up to there among the shared signatures, so too few of them rule the pair out
    lists = every.filter("plain").groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    first = lists.select(F.col("node").alias("a"), F.col("sigs").alias("a_sigs"))
    second = lists.select(F.col("node").alias("b"), F.col("sigs").alias("b_sigs"))
    counted = pairs.filter("plain").join(first, "a").join(second, "b")
    after = F.floor(F.col("large") * percent / 100)  # at least what lies after the prefix of either set
    enough = F.size(F.array_intersect("a_sigs", "b_sigs")) >= _overlap("small", "large", percent) - after
    return counted.filter(enough).select("a", "b").union(pairs.filter("not plain").select("a", "b"))


def similar_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs` (doc_id, text; more columns are ignored).

    Documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest
    doc_id reachable by links. Null and blank texts have no shingles and their own component;
    fewer than n words are one shingle. Equal sets, also of repeated rows, are one node. A null
    doc_id is kept and never the smallest if its component has another. An empty table gives
    an empty result.
    """
    measured = stored(_measured(docs, n), "measured")
    table = _count_table(measured)
    rows = measured.filter("kind = 0").select("doc_id", "d1", "d2", "size")
    nodes = rows.filter("size > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = _shared_only(_postings(docs, table, n, percent)).dropDuplicates(["sig", "d1"])
    postings = shared.join(nodes, "d1").select(
        "sig", "node",
        F.shiftright("meta", 32).cast("int").alias("size"),
        F.shiftright(F.col("meta").bitwiseAND(2**32 - 1), 1).cast("int").alias("place"),
        (F.col("meta") % 2 == 1).alias("plain"),
    )
    postings = stored(postings, "postings")
    part = (F.count("*") / F.first("size")).alias("part")
    weighed = postings.join(postings.groupBy("node").agg(part), "node").select("sig", "node", "size", "part")

    def sets_of(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return stored(_sets_of(docs, nodes.join(some, "node", "left_semi"), n), "sets")

    # first one partner for each set, and for those sets again with other partners: this joins dense groups
    pairs = stored(_partners(_with_component(weighed, None), percent, 0), "pairs")
    sets = sets_of(pairs)
    dense = stored(weighed.join(sets.select("node"), "node", "left_semi"), "dense")
    links = stored(_linked(pairs, sets, percent), "links")
    found = components(links)
    for turn in range(1, ROUNDS):
        forget(links, pairs)
        pairs = stored(_partners(_with_component(dense, found), percent, turn), "pairs")
        links = stored(_linked(pairs, sets, percent), "links")
        found = _closed(links, found)
    forget(dense, sets, links, pairs)
    # then everything that may still be similar
    pairs = stored(_rest(_with_component(postings, found), postings, percent), "pairs")
    sets = sets_of(pairs)
    links = stored(_linked(pairs, sets, percent), "links")
    found = _closed(links, found)
    forget(postings, pairs, sets, links)

    least = nodes.join(found, "node").groupBy("root").agg(F.min("least").alias("component"))
    joined = found.join(least, "root").select("node", "component")
    named = nodes.join(joined, "node", "left").select("d1", "d2", F.coalesce("component", "least").alias("component"))
    return rows.join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _closed(edges: DataFrame, before: DataFrame) -> DataFrame:
    """Components of more edges and those found before."""
    stars = before.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(edges.union(stars))

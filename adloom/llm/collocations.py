"""Phrases by how much more often their words come together than apart, counted in quotient filters.

Words get whole numbers below 2^bits, the n-gram of k words is k such numbers. A keyed permutation of
n-grams, each word in turn shifted by a hash of the others, spreads them evenly and can be undone, so
the top bits (quotient) and all other bits (remainder) of the permuted n-gram are its full name: no two
n-grams ever share a counter. A filter keeps its entries in order: one bit per quotient that occurs,
one bit per entry that ends a quotient's run, the remainders and the counters. Filters of blocks of text
are merged by ranges of quotients, like sorted lists.

Only words frequent enough to be part of a phrase get a number; any other word ends a stretch, as
punctuation does, but counts as an occurrence. Pairs are counted first. The merge of a range answers each
block with one bit for each of its entries, whether the pair is frequent, so a block counts longer
n-grams only where every pair in them is.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import forget, stored

MOST_WORDS = 5
#: A phrase needs so many occurrences, and so do the words in it.
LEAST = 100
#: Phrases reported per language.
TOP = 2000
#: Sizes of work in a task: characters of a block, entries held before they are sent, entries of a range.
BLOCK_CHARS = 6_000_000
HELD = 1_000_000
RANGE_ENTRIES = 1_000_000
SALTS = 64

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)
_BREAK = b"\xff"  # never part of a word: no byte of UTF-8


def _hash(words: list[np.ndarray], left_out: int, bits: int) -> np.ndarray:
    """A number of `bits` bits from all words but one."""
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15 + left_out, np.uint64)
    for i, word in enumerate(words):
        if i != left_out:
            h = (h ^ word) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(64 - bits)


def permuted(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The words of n-grams (one array for each place, numbers below 2^bits) permuted; see `restored`."""
    words, mask = [w.astype(np.uint64) for w in words], np.uint64(2**bits - 1)
    for turn in range(len(words) + 1):
        j = turn % len(words)
        words[j] = (words[j] + _hash(words, j, bits)) & mask
    return words


def restored(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """What `permuted` was given."""
    words, mask = list(words), np.uint64(2**bits - 1)
    for turn in reversed(range(len(words) + 1)):
        j = turn % len(words)
        words[j] = (words[j] - _hash(words, j, bits)) & mask
    return words


class Filter:
    """A counting quotient filter of permuted n-grams of k words, its entries in order.

    `lanes` are the packed words, as many to a 64-bit number as fit, the first in the highest bits;
    `counts` are the occurrences.
    """

    def __init__(self, k: int, bits: int, lanes: list[np.ndarray], counts: np.ndarray):
        self.k, self.bits, self.lanes, self.counts = k, bits, lanes, counts
        self.per = 64 // bits
        #: Bits used in each lane.
        self.widths = [bits * min(self.per, k - at) for at in range(0, k, self.per)]

    @classmethod
    def of(cls, words: list[np.ndarray], bits: int) -> tuple["Filter", np.ndarray]:
        """From permuted words, in any order and repeated; also the entry of each n-gram given."""
        lanes, per = [], 64 // bits
        for at in range(0, len(words), per):
            lane = words[at].copy()
            for word in words[at + 1 : at + per]:
                lane = (lane << np.uint64(bits)) | word
            lanes.append(lane)
        return cls(len(words), bits, lanes, np.ones(len(lanes[0]), np.int64))._summed()

    def _summed(self) -> tuple["Filter", np.ndarray]:
        """Entries in order, equal ones as one; also the place of each."""
        if not len(self.counts):
            return self, np.empty(0, np.int64)
        order = np.argsort(self.lanes[0], kind="stable") if len(self.lanes) == 1 else np.lexsort(self.lanes[::-1])
        lanes = [lane[order] for lane in self.lanes]
        new = np.zeros(len(order), bool)
        new[0] = True
        for lane in lanes:
            new[1:] |= lane[1:] != lane[:-1]
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return Filter(self.k, self.bits, [x[first] for x in lanes], np.add.reduceat(self.counts[order], first)), place

    @classmethod
    def merged(cls, filters: list["Filter"]) -> tuple["Filter", np.ndarray]:
        """The sum of filters of one kind, and the place in it of each entry of theirs."""
        one = filters[0]
        lanes = [np.concatenate(parts) for parts in zip(*(f.lanes for f in filters))]
        return cls(one.k, one.bits, lanes, np.concatenate([f.counts for f in filters]))._summed()

    def words(self) -> list[np.ndarray]:
        found, mask = [], np.uint64(2**self.bits - 1)
        for lane, width in zip(self.lanes, self.widths):
            found += [(lane >> np.uint64(s)) & mask for s in range(width - self.bits, -1, -self.bits)]
        return found

    def at_least(self, least: int) -> "Filter":
        chosen = self.counts >= least
        return Filter(self.k, self.bits, [lane[chosen] for lane in self.lanes], self.counts[chosen])

    def ranges(self, n: int):
        """(range, filter) of those of `n` (below 2^32) equal ranges of first words that have entries."""
        used = min(self.bits, 32)
        first = self.lanes[0] >> np.uint64(self.widths[0] - used)
        at = ((first * np.uint64(n)) >> np.uint64(used)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for begin, end in zip(begins, [*begins[1:], len(at)]):
            yield int(at[begin]), Filter(self.k, self.bits, [x[begin:end] for x in self.lanes], self.counts[begin:end])

    def packed(self) -> bytes:
        """Quotients as bits, run ends as bits, remainders of whole bytes, counters of one byte or nine."""
        n, width = len(self.counts), self.widths[0]
        low = self.lanes[0][0]
        # quotients count from the first entry's: a range needs no bits for what lies before it
        span = int(self.lanes[0][-1] - low).bit_length()
        q = min(span, max(1, n.bit_length()))
        rest = np.uint64(span - q)
        quotient = (self.lanes[0] - low) >> rest
        occupied = np.zeros(int(quotient[-1]) + 1, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        remainders = [((self.lanes[0] - low) & np.uint64((1 << (span - q)) - 1), span - q)]
        remainders += list(zip(self.lanes[1:], self.widths[1:]))
        large = self.counts > 254
        return b"".join([
            np.array([self.k, self.bits, n, low, span, q, len(occupied), large.sum()], np.uint64).tobytes(),
            np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
            *[x.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - -(-w // 8) :].tobytes() for x, w in remainders],
            np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].tobytes(),
        ])

    @classmethod
    def unpacked(cls, data: bytes) -> "Filter":
        k, bits, n, low, span, q, slots, n_large = (int(x) for x in np.frombuffer(data, np.uint64, 8))
        at = 64

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        quotients = np.flatnonzero(np.unpackbits(take(-(-slots // 8)), count=slots)).astype(np.uint64)
        ends = np.unpackbits(take(-(-n // 8)), count=n)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
        made = cls(k, bits, [], np.zeros(n, np.int64))

        def number(width: int) -> np.ndarray:
            size = -(-width // 8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, 8 - size :] = take(n * size).reshape(n, size)
            return wide.reshape(-1).view(">u8").astype(np.uint64)

        first = (quotients[run] << np.uint64(span - q)) | number(span - q)
        made.lanes = [first + np.uint64(low), *[number(w) for w in made.widths[1:]]]
        made.counts = take(n).astype(np.int64)
        made.counts[made.counts == 255] = np.frombuffer(data, np.int64, n_large, at)
        return made


def _squeezed(codes: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed byte place by byte place, as the higher places are mostly alike."""
    return zlib.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 4)


def _unsqueezed(data: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(places.T).reshape(-1).view("<i4")


def _block(texts: list[str]) -> tuple[list[str], np.ndarray, bytes]:
    """The distinct words of texts, their counts, and the texts as places of words, -1 for a break."""
    data = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass").translate(_LOWER)
    codes, words = pd.factorize(np.array(data.replace(b"\n", b" " + _BREAK + b" ").split(), dtype=object))
    (stop,) = np.flatnonzero(words == _BREAK)
    codes = np.where(codes == stop, -1, codes - (codes > stop)).astype(np.int32)
    words = [w.decode("utf-8", "surrogatepass") for w in np.delete(words, stop)]
    return words, np.bincount(codes[codes >= 0], minlength=len(words)), _squeezed(codes)


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of text, each of one language, at rest: (block, lang, words, counts, tokens); blocks are numbered
    without large gaps."""

    def encode(batches):
        task, n, size, held = TaskContext.get().partitionId(), 0, 0, {}

        def blocks():
            nonlocal n
            for lang, texts in sorted(held.items()):
                words, counts, tokens = _block(texts)
                row = {"task": task, "nth": n, "lang": lang, "words": words, "counts": counts, "tokens": tokens}
                yield pd.DataFrame({name: [value] for name, value in row.items()})
                n += 1

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from blocks()
                    size, held = 0, {}
        yield from blocks()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "task long, nth long, lang string, words array<string>, counts array<long>, tokens binary"
    made = stored(rows.mapInPandas(encode, schema), "blocks")
    tasks = 1 + (made.agg(F.max("task")).first()[0] or 0)
    return made.select((F.col("nth") * tasks + F.col("task")).alias("block"), "lang", "words", "counts", "tokens")


def _numbered(blocks: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(block, at, id, lang, word, f) at rest: the number of each frequent word at its place in each block's words, and
    the bits of numbers.

    A word's number is its first place in all blocks, so no two words share one and none is sought
    elsewhere. Language, word and occurrences are given at that place alone, null at others.
    """
    last, most = blocks.agg(F.max("block"), F.max(F.size("words"))).first()
    most = max(1, most or 0)
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    # no word holds a line break, so word and language are one short string
    key, name = F.concat("w.words", F.lit("\n"), "lang").alias("key"), F.col("block") * most + F.col("at")
    each = each.select(key, name.alias("name"), F.col("w.counts").alias("count"))
    same = Window.partitionBy("key")
    each = each.select("key", "name", F.sum("count").over(same).alias("f"), F.min("name").over(same).alias("id"))
    own, ends = F.col("id") == F.col("name"), F.instr("key", F.lit("\n"))
    found = each.filter(F.col("f") >= least).select(
        F.expr(f"name div {most}").alias("block"), (F.col("name") % most).alias("at"), "id",
        F.when(own, F.substr("key", ends + 1)).alias("lang"), F.when(own, F.substr("key", F.lit(1), ends - 1)).alias("word"),
        F.when(own, F.col("f")).alias("f"),
    )
    return stored(found, "numbers"), max(1, int((last or 0) * most + most - 1).bit_length())


def _pairs(blocks: DataFrame, numbers: DataFrame, bits: int, ranges: int) -> DataFrame:
    """At rest, per block and range of quotients the filter of its pairs of frequent words; and per block with pairs its text
    as places of frequent words, -1 for others and breaks, and their numbers."""
    # no value is null, so both lists take the same rows in the same order
    places = numbers.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))
    joined = blocks.select("block", "tokens", F.size("words").alias("n")).join(places, "block")

    def count(batches):
        for batch in batches:
            for block, tokens, n, at, number in batch[["block", "tokens", "n", "at", "id"]].itertuples(index=False):
                order = np.argsort(at)
                table = np.full(n + 1, -1, np.int32)  # the last place is for -1
                table[at[order]] = np.arange(len(at))
                places, names = table[_unsqueezed(tokens)], number[order]
                text = _named(places, names)
                made, _ = _counted(text, np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0)), 2, bits)
                rows = [(block, k, f.packed(), None) for k, f in made.ranges(ranges)]
                if rows:
                    rows.append((block, None, _squeezed(places), zlib.compress(names.tobytes(), 1)))
                    yield pd.DataFrame(rows, columns=["block", "range", "data", "names"]).astype({"range": "Int64"})

    return stored(joined.mapInPandas(count, "block long, range long, data binary, names binary"), "pairs")


def _named(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A text's places of words as numbers of words, -1 as it is."""
    return np.append(names, -1)[places]


def _counted(text: np.ndarray, begins: np.ndarray, k: int, bits: int) -> tuple[Filter, np.ndarray]:
    """The filter of the n-grams of k words that begin at `begins`, and the entry of each."""
    return Filter.of(permuted([text[begins + j] for j in range(k)], bits), bits)


def _words_of(f: Filter) -> pd.Series:
    words = np.stack(restored(f.words(), f.bits), axis=1).astype(np.int64)
    return pd.Series(list(words), dtype=object)


def _merged_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """At rest, frequent pairs (words, a), and per block and range one bit for each entry: whether its pair is frequent."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        filters = [Filter.unpacked(f) for f in part["data"]]
        whole, place = Filter.merged(filters)
        often = whole.counts >= least
        ends = np.cumsum([len(f.counts) for f in filters])
        answers = [np.packbits(x).tobytes() for x in np.split(often[place], ends[:-1])]
        found = whole.at_least(least)
        answered = pd.DataFrame({"block": part["block"].to_numpy(), "range": part["range"].to_numpy(), "bits": answers})
        answered["n"] = np.diff(ends, prepend=0)
        phrases = pd.DataFrame({"words": _words_of(found), "a": found.counts})
        both = pd.concat([answered, phrases], ignore_index=True)
        return both.astype({"block": "Int64", "range": "Int64", "n": "Int64", "a": "Int64"}).replace({np.nan: None})

    schema = "block long, range long, bits binary, n long, words array<long>, a long"
    return stored(pairs.filter("range is not null").select("block", "range", "data").groupBy("range").applyInPandas(merge, schema), "merged")


def _longer(pairs: DataFrame, merged: DataFrame, most_words: int, bits: int, ranges: int) -> DataFrame:
    """(k, range, filter): the n-grams of 3 words and more all of whose pairs are frequent, summed in each task."""
    # the answers to a block's filter in order of ranges, that is of its entries
    answers = merged.filter("block is not null").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("range", "n", "bits"))).alias("answers")
    )
    answers = answers.select("block", F.col("answers.n").alias("n"), F.col("answers.bits").alias("bits"))
    joined = pairs.filter("range is null").select("block", "data", "names").join(answers, "block")

    def count(batches):
        held = {k: [] for k in range(3, most_words + 1)}

        def shrink() -> int:
            for k, parts in held.items():
                if len(parts) > 1:
                    held[k] = [Filter.merged(parts)[0]]
            return sum(len(f.counts) for parts in held.values() for f in parts)

        def sent():
            for k, parts in held.items():
                rows = [(k, at, f.packed()) for one in parts for at, f in one.ranges(ranges)]
                if rows:
                    yield pd.DataFrame(rows, columns=["k", "range", "filter"])
                parts.clear()

        pending = 0
        for batch in batches:
            for data, names, sizes, answered in zip(batch["data"], batch["names"], batch["n"], batch["bits"]):
                text = _named(_unsqueezed(data), np.frombuffer(zlib.decompress(names), np.int64))
                often = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, answered)]
                begins = np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0))
                _, entry = _counted(text, begins, 2, bits)
                pair = np.zeros(len(text), bool)
                pair[begins] = np.concatenate(often)[entry]
                whole = pair
                for k in range(3, most_words + 1):
                    whole = whole[:-1] & pair[k - 2 :]
                    begins = np.flatnonzero(whole)
                    if len(begins):
                        held[k].append(_counted(text, begins, k, bits)[0])
                        pending += len(held[k][-1].counts)
                if pending > HELD:
                    pending = shrink()
                    if pending > HELD // 2:
                        yield from sent()
                        pending = 0
        shrink()
        yield from sent()

    return joined.select("data", "names", "n", "bits").mapInPandas(count, "k int, range long, filter binary")


def _frequent(filters: DataFrame, least: int) -> DataFrame:
    """(words, a): the n-grams with at least `least` occurrences in the filters of all tasks."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found = Filter.merged([Filter.unpacked(f) for f in part["filter"]])[0].at_least(least)
        return pd.DataFrame({"words": _words_of(found), "a": found.counts})

    return filters.groupBy("k", "range").applyInPandas(merge, "words array<long>, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables at rest of `docs` (lang, text): (lang, word, f, id) of words and (words, a) of phrases of 2 to
    `most_words` words that occur at least `least` times, and (lang, n) of all word occurrences."""
    blocks = _blocks(docs)
    summed = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    n = stored(blocks.groupBy("lang").agg(F.sum(summed).alias("n")), "totals")
    numbers, bits = _numbered(blocks, least)
    vocabulary = stored(numbers.filter("word is not null").select("lang", "word", "f", "id"), "vocabulary")
    ranges = 1 + (vocabulary.agg(F.sum("f")).first()[0] or 0) // RANGE_ENTRIES
    pairs = _pairs(blocks, numbers, bits, ranges)
    forget(blocks, numbers)
    merged = _merged_pairs(pairs, least)
    phrases = merged.filter("block is null").select("words", "a")
    longer = _frequent(_longer(pairs, merged, most_words, bits, ranges), least)
    phrases = stored(phrases.unionByName(longer), "phrases")
    forget(pairs, merged)
    return vocabulary, phrases, n


def collocations(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, absorb_percent: int = 100, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of `docs` (lang, text) that score best in their language.

    A phrase's score is floor(1000 a n / (l r)) at the cut into two parts, of l and r occurrences, that
    scores lowest, the first of equal ones. A phrase in a longer one with `absorb_percent` of its
    occurrences is dropped: it suffices to look at phrases of one word more, as each phrase
    between the two has no fewer occurrences than the longer. Ranks go by score, occurrences and the
    phrase's bytes. A null lang is `und`, a null text is empty, copies count as often as they occur, more
    columns are ignored and an empty table gives an empty result.
    """
    vocabulary, phrases, totals = phrase_counts(docs, least, most_words)
    counts = phrases.unionByName(vocabulary.select(F.array("id").alias("words"), F.col("f").alias("a")))
    size, at = F.size("words"), F.col("cut")
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "words", "a", "cut", F.slice("words", F.lit(1), at).alias("left"), F.slice("words", at + 1, size).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("words").alias(side), F.col("a").alias(name)), side)
    # n is the same for all cuts of a phrase, but the floor is not: it comes in before the lowest is sought
    langs = vocabulary.join(totals, "lang").select("id", "lang", "n")
    cuts = cuts.join(langs, F.get("words", F.lit(0)) == F.col("id"))
    cuts = cuts.withColumns({f"_{c}": F.col(c).cast("decimal(19,0)") for c in "anlr"})
    score = F.expr("(_a * _n * 1000) div (_l * _r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest")
    scored = cuts.groupBy("words", "a", "lang", "n").agg(lowest)
    parts = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = phrases.filter(size > 2).select(F.explode(parts).alias("words"), F.col("a").alias("_longer"))
    longer = longer.groupBy("words").agg(F.max("_longer").alias("_longer"))
    absorbed = F.coalesce(100 * F.col("_longer") >= absorb_percent * F.col("a"), F.lit(False))
    alone = scored.join(longer, "words", "left").filter(~absorbed)
    alone = alone.select("words", "lang", "a", "lowest.l", "lowest.r", "n", "lowest.score")
    spelled = alone.select("words", F.posexplode("words").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("_spelled"))
    named = alone.join(spelled, "words").withColumn("phrase", F.array_join("_spelled.word", " "))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each of a fixed number of parts first, so that a language doesn't fill a task
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(SALTS))).orderBy(*order)
    some = named.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

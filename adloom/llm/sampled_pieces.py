"""Sampled segmentation into SentencePiece pieces and lossless decoding.

A text's segmentations are the paths of a lattice of pieces. Forward filtering adds up the
weight of all paths to each place, backward sampling then draws one path from the end, each
with its exact probability. The draws come from a generator seeded by the row's key, so a row
always gets the same sample, wherever it is computed. No piece reaches over the start of a run
of spaces or over a line end, so the lattice falls into words and the filter is computed once
per distinct word of a task.

The model is a public one with merge ranks instead of probabilities; a piece's weight follows
Zipf's law, (rank + SHIFT) ** -alpha. Small alpha gives more varied segmentations.
"""

import re
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 20240501
SHIFT = 2.7
MARK = "▁"
#: Stands for a mark that the text itself holds; as half a surrogate pair it occurs in no text.
OWN_MARK = "\udfff"
#: Edges kept per task before the table of words is begun anew.
MOST_EDGES = 8_000_000
#: Characters of text sampled together.
BLOCK_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_WORDS = 2_048
#: Most places of a text hold no piece of a length; a table of so many bits tells most of them.
SIEVE_BITS = 18
_PARTS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class Pieces:
    """The pieces of a model, their weights and the lattices of the words met so far."""

    def __init__(self, model: str, alpha: float):
        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        self.alpha, self.text, self.byte, self.bytes_of = alpha, {}, {}, {}
        for i in range(loaded.get_piece_size()):
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value], self.bytes_of[i] = i, bytes([value])
            elif not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i)):
                self.text[piece], self.bytes_of[i] = i, piece.replace(MARK, " ").encode()
        if len(self.byte) < 256:
            raise ValueError("the model needs byte pieces")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.text if len(p) > 1):
            raise ValueError("a piece reaches over the start of a word")
        self.longest = max(map(len, self.text))
        ids = np.array(list(self.text.values()))
        self.weight = dict(zip(self.text, ((ids + SHIFT) ** -alpha).tolist()))
        self._tables = [self._by_length(n) for n in range(1, self.longest + 1)]
        self.fallback = (loaded.get_piece_size() + SHIFT) ** -alpha / 256
        self._ascii = np.array([self.byte[i] for i in range(128)], np.int32)
        self.forget()

    def forget(self) -> None:
        """Lattice edges, grouped by the place they end at: start place, piece, cumulative share.

        Place 0 of a word has no edge; `first` has the edges' range for every place of all words.
        """
        self.places: dict[str, int] = {}
        self.start, self.piece, self.share = array("i"), array("i"), array("d")
        self.first = array("q", [0])

    def add(self, word: str) -> int:
        """The place of the word's end, after forward filtering."""
        text, weight, longest = self.text, self.weight, self.longest
        base = len(self.first) - 1
        self.first.append(len(self.start))
        mass = [1.0]
        for end in range(1, len(word) + 1):
            total, shares = 0.0, []
            for begin in range(max(0, end - longest), end):
                piece = word[begin:end]
                w = weight.get(piece)
                if w is not None:
                    total += mass[begin] * w
                    self.start.append(base + begin)
                    self.piece.append(text[piece])
                    shares.append(total)
            if not shares:  # a character that no piece holds goes byte by byte: piece -1
                total = mass[end - 1] * self.fallback
                self.start.append(base + end - 1)
                code = ord(word[end - 1])
                self.piece.append(self.byte[code] if code < 128 else -code - 1)
                shares.append(total)
            self.share.extend(s / total for s in shares)
            self.first.append(len(self.start))
            mass.append(total)
            if total < 2.0**-500:  # only ratios within reach of one piece matter; a power of two rounds nothing
                low = max(0, end - longest)
                mass[low:] = [m * 2.0**500 for m in mass[low:]]
        self.places[word] = base + len(word)
        return base + len(word)

    def _by_length(self, n: int) -> tuple[np.ndarray, ...]:
        """Hashes of the pieces of n characters in order, their ids, weights and characters, and which low bits
        of a mixed hash occur among them."""
        pieces = [p for p in self.text if len(p) == n]
        codes = np.array([[ord(c) for c in p] for p in pieces], np.uint64).reshape(-1, n)
        h = np.zeros(len(pieces), np.uint64)
        for k in range(n):
            h = h * _BASE + codes[:, k]
        order = np.argsort(h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces share a hash")
        ids = np.array([self.text[p] for p in pieces], np.int32)[order]
        occurs = np.zeros(1 << SIEVE_BITS, bool)
        occurs[_sieve(h)] = True
        values = np.array([self.weight[p] for p in pieces])[order]
        return h[order], ids, values, codes[order], occurs

    def add_many(self, words: list[str]) -> None:
        """The lattices of words of up to 32 characters, many side by side."""
        some = sorted((w for w in words if len(w) <= 32), key=len)
        for k in range(0, len(some), BLOCK_WORDS):
            block = some[k : k + BLOCK_WORDS]
            self._add_block(block, len(block[-1]))
        for w in words:
            if len(w) > 32:
                self.add(w)

    def _add_block(self, words: list[str], width: int) -> None:
        n, reach = len(words), min(width, self.longest)
        lengths = np.array([len(w) for w in words])
        filled = np.arange(width) < lengths[:, None]
        codes = np.zeros((n, width), np.uint64)
        codes[filled] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        # by word, place of the end and begin: a piece of k + 1 characters lies at reach - 1 - k
        weights, ids = np.zeros((n, width, reach)), np.zeros((n, width, reach), np.int32)
        h, covered = np.zeros((n, width), np.uint64), np.zeros((n, width), bool)
        for k in range(reach):  # pieces of k + 1 characters that end at each place
            h[:, k:] = (h[:, k - 1 : width - 1] if k else h) * _BASE + codes[:, k:]
            table, piece, value, text, occurs = self._tables[k]
            if not len(table):
                continue
            row, place = np.nonzero(filled[:, k:] & occurs[_sieve(h[:, k:])])
            wanted = h[row, place + k]
            got = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            hit = np.flatnonzero(table[got] == wanted)
            row, place, got = row[hit], place[hit], got[hit]
            # equal hashes of unequal text can't be excluded, so the characters decide
            same = (codes[row[:, None], place[:, None] + np.arange(k + 1)] == text[got]).all(axis=1)
            row, place, got = row[same], place[same], got[same]
            at = (row * width + place + k) * reach + (reach - 1 - k)
            weights.ravel()[at], ids.ravel()[at] = value[got], piece[got]
            covered[row, place + k] = True
        row, place = np.nonzero(filled & ~covered)  # characters that no piece ends at go byte by byte
        code = codes[row, place].astype(np.int64)
        weights[row, place, reach - 1] = self.fallback
        ids[row, place, reach - 1] = np.where(code < 128, self._ascii[np.minimum(code, 127)], -code - 1)
        # each word's sums are its own, so its shares are the same in any block
        mass, shares = np.zeros((n, reach + width)), np.empty((n, width, reach))
        mass[:, reach - 1] = 1.0
        for e in range(width):
            sums = np.cumsum(mass[:, e : e + reach] * weights[:, e], axis=1)
            total = sums[:, -1]
            mass[:, reach + e] = total
            shares[:, e] = sums / np.where(total > 0, total, 1.0)[:, None]
        at = np.flatnonzero(weights.ravel() > 0)
        piece, share = ids.ravel()[at], shares.ravel()[at]
        at, back = np.divmod(at, reach)
        row, end = np.divmod(at, width)
        begin, end = end + back - (reach - 1), end + 1
        base = len(self.first) - 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
        counts = np.bincount(base[row] + end - base[0], minlength=int(base[-1] - base[0]))
        self.first.frombytes((len(self.start) + np.cumsum(counts)).tobytes())
        self.start.frombytes((base[row] + begin).astype(np.int32).tobytes())
        self.piece.frombytes(piece.tobytes())
        self.share.frombytes(share.tobytes())
        self.places.update(zip(words, (base[:-1] + lengths).tolist()))

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """One sampled path for each text as piece ids."""
        cut = [_PARTS.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) for text in texts]
        known = self.places
        self.add_many(list(set().union(*cut).difference(known)))
        counts = np.array([len(words) for words in cut])
        ends = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, counts.sum())
        return self._walk(ends, counts, seeds)

    def _walk(self, place: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
        """Backward sampling of all words of the texts side by side, one piece a step."""
        first, start = np.frombuffer(self.first, np.int64), np.frombuffer(self.start, np.int32)
        piece, share = np.frombuffer(self.piece, np.int32), np.frombuffer(self.share, np.float64)
        word = np.concatenate([np.arange(c, dtype=np.uint64) for c in counts]) if len(counts) else np.empty(0, np.uint64)
        draw = np.repeat(seeds.astype(np.uint64), counts) + word * np.uint64(0x9E3779B97F4A7C15)
        at, steps, found = np.arange(len(place)), np.zeros(len(place), np.int64), []
        while len(at):
            draw = draw + np.uint64(0xD1B54A32D192ED03)
            u = (_mixed(draw) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[place].copy()
            todo = np.flatnonzero(share[edge] < u)
            while len(todo):
                edge[todo] += 1
                todo = todo[share[edge[todo]] < u[todo]]
            found.append((at, piece[edge]))
            steps[at] += 1
            place = start[edge]
            go = first[place] < first[place + 1]
            at, place, draw = at[go], place[go], draw[go]
        after = np.cumsum(steps)
        ids = np.empty(int(after[-1]) if len(after) else 0, np.int32)
        for step, (words, pieces) in enumerate(found):
            ids[after[words] - 1 - step] = pieces
        last = np.concatenate([[0], after])[np.cumsum(counts)]
        return [self._spelled(part) for part in np.split(ids, last[:-1])] if len(counts) else []

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece as bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        spelled = [self._bytes(-int(ids[k]) - 1) for k in odd]
        length = np.ones(len(ids), np.int64)
        length[odd] = [len(x) for x in spelled]
        out = np.repeat(ids, length)
        for k, x in zip(np.cumsum(length)[odd], spelled):
            out[k - len(x) : k] = x
        return out

    def _bytes(self, code: int) -> list[int]:
        return [self.byte[b] for b in (MARK if chr(code) == OWN_MARK else chr(code)).encode()]

    def decode(self, ids) -> str:
        """The text: pieces as bytes, without the space added in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


_loaded: dict[tuple, Pieces] = {}


def pieces_of(model: str, alpha: float) -> Pieces:
    """The model of this process; its table of words stays for the next task."""
    if (model, alpha) not in _loaded:
        _loaded[model, alpha] = Pieces(model, alpha)
    return _loaded[model, alpha]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sieve(h: np.ndarray) -> np.ndarray:
    """The place of a hash in a table of 2 ** SIEVE_BITS; its low bits are those of the last character alone."""
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SIEVE_BITS)


def _groups(texts: list[str]):
    """Ranges of rows of about BLOCK_CHARS characters together."""
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars > BLOCK_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(
    docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, check: bool = False,
    keep: tuple[str, ...] | list[str] = (), most_edges: int = MOST_EDGES,
) -> DataFrame:
    """`key`, `ids` (array of int), `n_pieces`, with `check` `lossless`, and the columns `keep` (of type long) per row of
    `docs` (key, text).

    ids are one segmentation drawn with probability proportional to the product of its pieces'
    weights. The seed is taken from the key (null as a key of its own) and `seed`, so repeated
    rows get the same sample. A null text gives null ids and n_pieces 0, an empty one the one
    piece of the leading space. `lossless` tells whether decoding gives the text back. More
    columns are ignored; an empty table gives an empty result. `most_edges` bounds the table of lattices that
    a task keeps: fewer take less memory and more time, and give the same samples.
    """

    def scan(batches):
        pieces = pieces_of(model, alpha)
        for batch in batches:
            keys, texts = batch["key"].tolist(), [t or "" for t in batch["text"]]
            given = batch["text"].notna().to_numpy()
            for begin, end in _groups(texts):
                if len(pieces.start) > most_edges:
                    pieces.forget()
                seeds = [xxhash.xxh64_intdigest(str(k), seed=seed) for k in keys[begin:end]]
                found = pieces.sample(texts[begin:end], np.array(seeds, np.uint64))
                for i in range(begin, end, 512):
                    part = found[i - begin : min(i + 512, end) - begin]
                    yes = given[i : i + len(part)]
                    made = {"key": keys[i : i + len(part)], "ids": [x if y else None for x, y in zip(part, yes)],
                            "n_pieces": [len(x) if y else 0 for x, y in zip(part, yes)]}
                    made |= {name: batch[name].to_numpy()[i : i + len(part)] for name in keep}
                    if check:
                        made["lossless"] = [pieces.decode(x.tolist()) == t for x, t in zip(part, texts[i:end])]
                    yield pd.DataFrame(made)

    schema = "key string, ids array<int>, n_pieces int" + ", lossless boolean" * check + "".join(f", {name} long" for name in keep)
    kind = docs.schema[key].dataType
    made = docs.select(F.col(key).cast("string").alias("key"), "text", *keep).mapInPandas(scan, schema)
    return made.select(F.col("key").cast(kind).alias(key), *made.columns[1:])


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """`rows` (ids, more columns are kept) with `text`; null for null ids."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        pieces = pieces_of(model, ALPHA)
        return ids.map(lambda x: None if x is None else pieces.decode(x.tolist()))

    return rows.withColumn("text", text_of("ids"))

"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words (runs of letters, lower case) and their beginnings of four and
five letters, hashed to 2**20 places. The score is a logistic of a bias, the weights of the terms
present and, for each pair of them, the dot product of their factors: a pair may count for more
than its parts, such as an insult with the mention of a group. Terms without a clear tie to the
label, by themselves or within the texts that hold another term with one, have no weight, so a long
text does not drown in chance. Pairs of which neither term has a tie of its own are not sought.
"""

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 20
FACTORS = 8
#: At most so many labelled rows of each class are expected in the fit, chosen by a hash of the id.
FIT_ROWS = 6_000
EPOCHS = 15
SEED = 20240501
#: A term must be in this many texts of the fit and this many standard deviations off chance.
LEAST_TEXTS = 3
LEAST_Z = 3.5
#: As a term beside a chosen one is one of millions of such pairs, its tie must be stronger.
LEAST_PAIR_Z = 6.0
_LETTERS = re.compile(r"[^\W\d_]+")
_MOST_WORDS = 100_000


class _Terms(dict):
    """The places of a word and its beginnings; emptied when it grows large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _MOST_WORDS:
            self.clear()
        made = {f"w:{word}", f"4:{word[:4]}", f"5:{word[:5]}"}
        self[word] = places = tuple(xxhash.xxh32_intdigest(t) % PLACES for t in sorted(made))
        return places


_terms = _Terms()


def terms(text: str | None) -> np.ndarray:
    """The distinct places of a text's terms in order."""
    words = set(_LETTERS.findall((text or "").lower()))
    found = [p for w in words for p in _terms[w]]
    return np.unique(np.array(found, np.int64))


def _tied_beside(labels: np.ndarray, rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Places whose terms are tied to the label within the texts that hold another chosen term.

    The tie is the root of the likelihood ratio, which stays sound for small counts. Only terms in
    enough texts of the fit can be tied; they are numbered without gaps, so that counting needs no sort.
    """
    often = np.flatnonzero(np.bincount(np.concatenate([*rows, chosen[:0]]), minlength=PLACES) >= LEAST_TEXTS)
    at = np.full(PLACES, -1, np.int64)
    at[often] = np.arange(len(often))
    kept = [at[r][at[r] >= 0] for r in rows]
    holders: dict[int, list[int]] = {int(p): [] for p in chosen}
    is_chosen = np.isin(np.arange(PLACES), chosen)
    for i, r in enumerate(rows):
        for p in r[is_chosen[r]]:
            holders[int(p)].append(i)
    tied = np.zeros(len(often), bool)
    for some in holders.values():
        marked, clean = [kept[i] for i in some if labels[i]], [kept[i] for i in some if not labels[i]]
        n, toxic = len(some), len(marked)
        if not 0 < toxic < n:
            continue
        one, other = (np.bincount(np.concatenate(part), minlength=len(often)) for part in (marked, clean))
        enough = np.flatnonzero(one + other >= LEAST_TEXTS)
        one, every = one[enough].astype(float), (one + other)[enough]
        ratio = np.zeros(len(enough))
        for with_term, without, all_of in ((one, toxic - one, toxic), (every - one, n - toxic - every + one, n - toxic)):
            share = all_of / n
            for seen, size in ((with_term, every), (without, n - every)):
                ratio += 2 * seen * np.log(np.maximum(seen, 1e-300) / np.maximum(size * share, 1e-300))
        tied[enough[ratio >= LEAST_PAIR_Z**2]] = True
    return often[tied]


def _fit(labels: np.ndarray, rows: list[np.ndarray]) -> dict:
    """Bias, chosen places, their weights and factors, by adaptive gradient steps in small batches."""
    n, toxic = len(labels), int(labels.sum())
    counts = np.zeros((2, PLACES))
    for y, r in zip(labels, rows):
        counts[y, r] += 1
    every, rate = counts.sum(axis=0), max(toxic, 1) / max(n, 1)
    z = (counts[1] - every * rate) / np.sqrt(np.maximum(every * rate * (1 - rate), 1e-9))
    places = np.flatnonzero((every >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z))
    places = np.union1d(places, _tied_beside(labels, rows, places))
    at = np.full(PLACES, -1, np.int64)
    at[places] = np.arange(len(places))
    kept = [at[r][at[r] >= 0] for r in rows]
    rng = np.random.Generator(np.random.PCG64(SEED))
    w, v = np.zeros(len(places)), rng.normal(0, 0.01, (len(places), FACTORS))
    # both classes weigh the same, so that rare toxic rows aren't outvoted
    weigh = np.where(labels == 1, n / (2 * max(toxic, 1)), n / (2 * max(n - toxic, 1)))
    bias = 0.0 if 0 < toxic < n else float(np.log((toxic + 1) / (n - toxic + 1)))
    past_w, past_v, past_b = np.full(len(places), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS if toxic and toxic < n else 0):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            batch = order[k : k + 64]
            some = [i for i in batch if len(kept[i])]
            bare = [i for i in batch if not len(kept[i])]  # texts without a chosen term pull at the bias alone
            alone = (1 / (1 + np.exp(-bias)) - labels[bare]) * weigh[bare]
            if not some:
                past_b += alone.mean() ** 2
                bias -= 0.1 * alone.mean() / np.sqrt(past_b)
                continue
            flat = np.concatenate([kept[i] for i in some])
            length = np.array([len(kept[i]) for i in some])
            owner = np.repeat(np.arange(len(some)), length)
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            sums = np.add.reduceat(v[flat], begin)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((v[flat] ** 2).sum(axis=1), begin))
            score = bias + np.add.reduceat(w[flat], begin) + pairs
            miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) * weigh[some]
            used, inverse = np.unique(flat, return_inverse=True)
            pull = np.bincount(inverse, miss[owner]) / len(some) + 1e-4 * w[used]
            turn = (miss[owner, None] * (sums[owner] - v[flat])) / len(some)
            turn = np.stack([np.bincount(inverse, turn[:, f]) for f in range(FACTORS)], axis=1) + 1e-4 * v[used]
            past_w[used] += pull**2
            past_v[used] += turn**2
            w[used] -= 0.2 * pull / np.sqrt(past_w[used])
            v[used] -= 0.02 * turn / np.sqrt(past_v[used])
            slope = (miss.sum() + alone.sum()) / len(batch)
            past_b += slope**2
            bias -= 0.1 * slope / np.sqrt(past_b)
    return {"bias": bias, "places": places, "weights": w, "factors": v}


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The model from `labels` (doc_id, toxic) and the texts of `docs`.

    Only rows whose crc32(doc_id as text) mod 5 isn't 0 are learned from; of each class those
    with the smallest hashes, about `fit_rows`. Null labels or ids are left out. A doc_id with both labels
    gives a row of each; of rows that repeat a doc_id only the one with the smallest terms is learned from,
    and equal texts of one label count once. Without rows of both classes the score is the share of toxic ones for any text.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "_id"), 1) / F.lit(float(2**63))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    most = F.when(F.col("_y") == 1, fit_rows / max(1, sizes.get(1, 0))).otherwise(fit_rows / max(1, sizes.get(0, 0)))
    chosen = known.filter(share < most)
    # the choice has a fixed bound, so it may be sent to all executors
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")

    def extract(batches):
        for batch in batches:
            yield pd.DataFrame({"y": batch["_y"], "row": batch["_id"], "places": [terms(t) for t in batch["text"]]})

    found = texts.mapInPandas(extract, "y int, row long, places array<int>")
    # one row for each id and label, so that repeated ids don't fill the one task that learns
    found = found.groupBy("row", "y").agg(F.min("places").alias("places"))

    def train(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pd.concat(parts).sort_values(["row", "y"])
        labels_of, rows, seen = [], [], set()
        for y, places in zip(table["y"], table["places"]):
            row = np.asarray(places, np.int64)
            if (y, row.tobytes()) not in seen:  # a copied text counts once
                seen.add((y, row.tobytes()))
                labels_of.append(y)
                rows.append(row)
        m = _fit(np.array(labels_of, np.int64), rows)
        yield pd.DataFrame({"bias": [m["bias"]], "places": [m["places"].tobytes()], "weights": [m["weights"].tobytes()],
                            "factors": [m["factors"].tobytes()]})

    schema = "bias double, places binary, weights binary, factors binary"
    made = found.repartition(1).mapInPandas(train, schema).collect()
    if not made:
        return {"bias": 0.0, "places": np.empty(0, np.int64), "weights": np.empty(0), "factors": np.empty((0, FACTORS))}
    m = made[0]
    return {
        "bias": m["bias"], "places": np.frombuffer(m["places"], np.int64), "weights": np.frombuffer(m["weights"]),
        "factors": np.frombuffer(m["factors"]).reshape(-1, FACTORS),
    }


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """`docs` (text, more columns are kept) with the score of each whole text in column `name`, 0 to 1.

    Null and empty texts have no terms and get the score of the bias.
    """
    at = np.full(PLACES, -1, np.int32)
    at[model["places"]] = np.arange(len(model["places"]))
    shared = docs.sparkSession.sparkContext.broadcast((at, model["bias"], model["weights"], model["factors"]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        at, bias, w, v = shared.value
        out = np.full(len(texts), bias)
        for i, text in enumerate(texts):
            row = at[terms(text)]
            row = row[row >= 0]
            if len(row):
                f = v[row]
                out[i] += w[row].sum() + 0.5 * float((f.sum(axis=0) ** 2 - (f**2).sum(axis=0)).sum())
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn(name, score(docs["text"]))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) per row of `docs` (doc_id, text).

    A null doc_id counts as empty text for `held_out`. More columns are ignored, repeated rows
    are scored alike, and an empty table gives an empty result.
    """
    rows = scored(docs.select("doc_id", "text"), learn(docs, labels, fit_rows))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

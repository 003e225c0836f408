"""Languages by a string kernel.

The kernel of two texts is the number of n-grams of 1 to 3 characters that are in both, over the root of the
product of how many are in each: presence, not frequency, of a blended spectrum. Landmark texts span
a Nyström approximation of its feature space, in which one ridge regression per language is fitted
against the rest. A task scores texts in batches: presence of landmark n-grams times landmarks times weights.
"""

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts in the fit: at most about so many different ones per language, of at most so many characters each.
FIT_ROWS = 1500
FIT_CHARS = 20_000
#: Languages in the fit: those with the most different texts.
MOST_LANGS = 500
#: Landmarks of all languages together, but at least LEAST_LANDMARKS of each.
LANDMARKS = 96
LEAST_LANDMARKS = 4
RIDGE = 0.1
SEED = 13
BATCH = 128
UNKNOWN = "und"

_is_letter = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _is_letter


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of 1 to 3 characters, ascending; none if there is no letter.

    Case is ignored, what isn't a letter counts as one space, and a space stands before and after the text.
    A character takes 21 bits and is at least 1, so n-grams of unequal lengths differ too.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    after = np.concatenate([[False], letter[:-1]])
    points = np.where(letter, points, 32)[letter | after]
    one = np.pad(points, (1, int(letter[-1])), constant_values=32).astype(np.uint64) + np.uint64(1)
    two = one[:-1] << np.uint64(21) | one[1:]
    three = two[:-1] << np.uint64(21) | one[2:]
    return np.concatenate([np.unique(one), np.unique(two), np.unique(three)])


class Model:
    """The n-grams of the landmarks, which landmarks hold them, and weights of the kernel with each landmark."""

    def __init__(self, langs, vocabulary, landmarks, sizes, weights, bias):
        self.langs, self.vocabulary, self.landmarks, self.sizes = langs, vocabulary, landmarks, sizes
        self.weights, self.bias = weights, bias

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        found = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for row, own in zip(found, texts):
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            row[at[self.vocabulary[at] == own]] = 1
        return found

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """The kernel of each text with each landmark."""
        own = np.array([max(1, len(t)) for t in texts], float)
        return (self.presence(texts) @ self.landmarks) / np.sqrt(own[:, None] * self.sizes[None, :])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Per text and language: near 1 for the text's language, near 0 for others."""
        return self.kernel(texts) @ self.weights + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, `und` without a letter or without a learned language, and its score, 0 to 1."""
        names, best = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.langs:
            sets = [grams(t) for t in texts]
            known = [i for i, s in enumerate(sets) if len(s)]
            for begin in range(0, len(known), BATCH):
                rows = known[begin : begin + BATCH]
                scores = self.scores([sets[i] for i in rows])
                for i, at, score in zip(rows, scores.argmax(axis=1), scores.max(axis=1)):
                    names[i], best[i] = self.langs[at], float(min(1.0, max(0.0, score)))
        return names, best

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, langs=np.array(self.langs, dtype=str), vocabulary=self.vocabulary, landmarks=self.landmarks.astype(bool),
            sizes=self.sizes, weights=self.weights, bias=self.bias,
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Model":
        x = np.load(io.BytesIO(data))
        return cls(x["langs"].tolist(), x["vocabulary"], x["landmarks"].astype(np.float32), x["sizes"], x["weights"], x["bias"])


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of texts and their languages; the first texts of each language are its landmarks."""
    sets = [grams(t) for t in texts]
    rows = [i for i, s in enumerate(sets) if len(s)]
    names = sorted({langs[i] for i in rows})
    each = max(LEAST_LANDMARKS, landmarks // max(1, len(names)))
    chosen = [i for name in names for i in [i for i in rows if langs[i] == name][:each]]
    empty = np.empty(0, np.uint64)
    vocabulary = np.unique(np.concatenate([empty, *(sets[i] for i in chosen)]))
    sizes = np.array([len(sets[i]) for i in chosen], float)
    model = Model(names, vocabulary, np.empty((0, 0), np.float32), sizes, np.empty((0, 0)), np.empty(0))
    if not names:
        return model
    model.landmarks = np.ascontiguousarray(model.presence([sets[i] for i in chosen]).T)
    values, vectors = np.linalg.eigh(model.kernel([sets[i] for i in chosen]))
    # repeated landmarks have no direction of their own
    whole = values > 1e-6 * values.max()
    root = vectors[:, whole] / np.sqrt(values[whole])
    features = np.concatenate([model.kernel([sets[i] for i in rows[b : b + BATCH]]) @ root for b in range(0, len(rows), BATCH)])
    targets = np.array([[langs[i] == name for name in names] for i in rows], float)
    mean, share = features.mean(axis=0), targets.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(centred.shape[1]), centred.T @ (targets - share))
    model.weights, model.bias = root @ solved, share - mean @ solved
    return model


def _held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model:
    """A model of about `fit_rows` different texts per language of `docs` (doc_id, text, lang), chosen by a hash,
    for the MOST_LANGS languages with the most texts.

    Rows that are held out (crc32 of doc_id leaves 2 by 4), have no lang or no text, or texts above
    FIT_CHARS characters take no part. Of equal texts one counts, under its first language.
    """
    rows = docs.filter(~_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") <= FIT_CHARS))
    rows = rows.select("lang", "text", F.xxhash64(F.lit(SEED), "text").alias("at"))
    n = rows.groupBy("at").agg(F.min("lang").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))
    n = n.orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    share = F.shiftrightunsigned("at", 1) / F.lit(float(2**63))
    # at most MOST_LANGS rows
    chosen = rows.join(F.broadcast(n), "lang").filter(share < F.lit(fit_rows) / F.col("n"))
    chosen = chosen.groupBy("at").agg(F.min(F.struct("lang", "text")).alias("first")).select("at", "first.*")

    def train(batches):
        parts = [b for b in batches if len(b)]
        every = pd.concat(parts).sort_values(["at", "text"]) if parts else pd.DataFrame({"text": [], "lang": []})
        yield pd.DataFrame({"model": [fit(every["text"].tolist(), every["lang"].tolist(), landmarks).to_bytes()]})

    made = chosen.repartition(1).mapInPandas(train, "model binary").collect()
    return Model.from_bytes(made[0][0]) if made else fit([], [])


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred and score (0 to 1).

    Whole texts are scored, by nothing but their characters. A null text or one without a letter (a
    character of Unicode's letter classes) is `und` with score 0, as are all texts if no language was
    learned. A null doc_id counts as an empty one; repeated rows get equal results, more columns are
    ignored and an empty table gives an empty result.
    """
    data = (learn(docs) if model is None else model).to_bytes()

    def score(batches):
        made = Model.from_bytes(data)
        for batch in batches:
            names, best = made.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": best})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType.fromDDL("doc_id string, held_out boolean, lang_pred string, score double")
    kind = docs.schema["doc_id"].dataType
    return rows.mapInPandas(score, schema).withColumn("doc_id", F.col("doc_id").cast(kind))

"""Personal data by patterns and a semi-Markov conditional random field.

Plain e-mail addresses, IP addresses, card and phone numbers have fixed patterns and are always
found. Other spellings (a phone number without country code, an address with "(at)") are left
to a model: it scores whole candidate spans by features of the span and its surroundings, and
dynamic programming over spans of bounded length picks the boundaries and kinds with the
highest sum, jointly for a stretch of text. It is trained by likelihood, forward and backward
over all segmentations, on stretches around pattern matches of a bounded sample of rows.
"""

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: A span has at most so many atoms: runs of digits, of letters, or single other characters.
MOST_ATOMS = 20
AROUND = 24
#: Rows with pattern matches that the model is trained on, about, chosen by a hash of the text.
FIT_ROWS = 300
EPOCHS = 8
SEED = 20240501

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_TRIGGER = re.compile(r"@|[(\[{] ?at ?[)\]}]|\+?\(?[0-9][0-9 ().-]{6,}[0-9]")
_AT = re.compile(r"@| ?[(\[{] ?at ?[)\]}] ?")
_CUES = re.compile(r"(tel|phone|call|fax|mobile)|(mail|contact|write)|(\bip\b|host|server)|(card|visa|credit)", re.I)
_INSIDE = set(" ().-@+%_[]{}")


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind, in order."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at  # the run of allowed characters before the sign, not before the last match
        while begin > end and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, 0, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around anything that could be personal data."""
    parts: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        begin, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if parts and begin <= parts[-1][1]:
            parts[-1][1] = max(end, parts[-1][1])
        else:
            parts.append([begin, end])
    return [(a, b) for a, b in parts]


FEATURES = ("bias", "digits<7", "digits 7-9", "digits 10-11", "digits 12-13", "digits 14-19", "digits>19", "letters",
            "at", "two at", "dot after at", "octets", "luhn", "not luhn", "plus", "parenthesis", "dash", "dots",
            "space", "glued left", "glued right", "digit near left", "digit near right", "cue phone", "cue mail",
            "cue ip", "cue card", "long", "unbalanced")
_AT_PLACE = {name: i for i, name in enumerate(FEATURES)}


def _features(text: str, begin: int, end: int) -> list[int]:
    """The features that hold for the span."""
    span = text[begin:end]
    digits = _digits(span)
    n, names = len(digits), ["bias"]
    names.append("digits<7" if n < 7 else "digits 7-9" if n < 10 else "digits 10-11" if n < 12
                 else "digits 12-13" if n < 14 else "digits 14-19" if n < 20 else "digits>19")
    if any(c.isalpha() for c in span):
        names.append("letters")
    at = _AT.findall(span)
    if at:
        names.append("at" if len(at) == 1 else "two at")
        if re.search(r"[A-Za-z0-9]( ?[(\[{] ?dot ?[)\]}] ?|\.)[A-Za-z]", span[span.rfind(at[-1]) :]):
            names.append("dot after at")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        names.append("octets")
    if 14 <= n <= 19:
        names.append("luhn" if luhn(digits) else "not luhn")
    for name, mark in (("plus", "+"), ("parenthesis", "("), ("dash", "-"), ("dots", "."), ("space", " ")):
        if mark in span:
            names.append(name)
    if begin and text[begin - 1].isalnum() and text[begin].isalnum():
        names.append("glued left")
    if end < len(text) and text[end].isalnum():
        names.append("glued right")
    if re.search(r"[0-9][ ().+-]{0,2}$", text[max(0, begin - 3) : begin]):
        names.append("digit near left")
    if re.match(r"[ ().-]{0,2}[0-9]", text[end : end + 3]):
        names.append("digit near right")
    cue = None
    for cue in _CUES.finditer(text, max(0, begin - AROUND), begin):
        pass
    if cue:
        names.append(("cue phone", "cue mail", "cue ip", "cue card")[cue.lastindex - 1])
    if end - begin > 40:
        names.append("long")
    if span.count("(") != span.count(")"):
        names.append("unbalanced")
    return [_AT_PLACE[x] for x in names]


def _candidates(text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Atom boundaries of a stretch and the spans (first atom, atom after, features) that may be entities."""
    bounds = [begin] + [m.end() for m in _ATOM.finditer(text, begin, end)]
    atoms = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    spans = []
    for i, first in enumerate(atoms):
        if not (first[0].isalnum() or first in "+("):
            continue
        digit, at = 0, False
        for j in range(i, min(i + MOST_ATOMS, len(atoms))):
            atom = atoms[j]
            if not (atom[0].isalnum() or atom in _INSIDE):
                break
            digit += len(atom) if atom[0].isdigit() else 0
            at = at or atom == "@" or atom == "at"
            if (digit >= 4 or at) and (atom[0].isalnum() or atom == ")") and (at or not atom[0].isalpha()):
                spans.append((i, j + 1, _features(text, bounds[i], bounds[j + 1])))
    return bounds, spans


def best_segmentation(n: int, spans: list, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, after, kind) of the entities with the highest sum of scores over n atoms; an atom outside scores 0."""
    by_end: dict[int, list] = {}
    for i, j, features in spans:
        by_end.setdefault(j, []).append((i, weights[:, features].sum(axis=1)))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, scores in by_end.get(j, ()):
            kind = int(np.argmax(scores))
            if best[i] + scores[kind] > best[j]:
                best[j], back[j] = best[i] + float(scores[kind]), (i, kind)
    found, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            found.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return found[::-1]


def _gradient(n: int, spans: list, gold: set, weights: np.ndarray) -> np.ndarray:
    """Observed minus expected features, summed over all segmentations forward and backward."""
    scores = [weights[:, f].sum(axis=1) for _, _, f in spans]
    mass = [float(np.logaddexp.reduce(s)) for s in scores]
    starts, ends = {}, {}
    for k, (i, j, _) in enumerate(spans):
        starts.setdefault(i, []).append(k)
        ends.setdefault(j, []).append(k)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1]] + [forward[spans[k][0]] + mass[k] for k in ends.get(j, ())])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1]] + [backward[spans[k][1]] + mass[k] for k in starts.get(i, ())])
    pull = np.zeros_like(weights)
    for k, (i, j, f) in enumerate(spans):
        expected = np.exp(forward[i] + scores[k] + backward[j] - forward[n])
        pull[:, f] -= expected[:, None]
        for kind in range(len(KINDS)):
            if (i, j, kind) in gold:
                pull[kind, f] += 1
    return pull


def _train(texts: list[str]) -> np.ndarray:
    """Weights by kind and feature."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -3.0
    cases = []
    for text in texts:
        known = pattern_spans(text)
        for begin, end in _stretches(text):
            inside = [s for s in known if begin <= s[0] and s[2] <= end]
            if not inside:
                continue
            bounds, spans = _candidates(text, begin, end)
            place = {b: i for i, b in enumerate(bounds)}
            gold = {(place[a], place[b], k) for a, k, b in inside if a in place and b in place}
            cases.append((len(bounds) - 1, spans, gold))
    rng, past = np.random.Generator(np.random.PCG64(SEED)), np.full(weights.shape, 1e-6)
    for _ in range(EPOCHS):
        for c in rng.permutation(len(cases)):
            n, spans, gold = cases[c]
            # at times the sign of a country code is hidden, so that numbers without it are learned too
            hide = rng.random() < 0.3
            seen = [(i, j, [x for x in f if not (hide and FEATURES[x] == "plus")]) for i, j, f in spans]
            pull = _gradient(n, seen, gold, weights) - 0.002 * weights
            past += pull**2
            weights += 0.3 * pull / np.sqrt(past)
    return weights


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from about `fit_rows` different texts with pattern matches; without any, no span is ever added."""
    rows = docs.select("text").filter(F.col("text").isNotNull())
    rows = rows.select("text", F.xxhash64(F.lit(SEED), "text").alias("at"))
    likely = rows.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|[0-9][ ().-]?[0-9][ ().-]?[0-9][ ().-]?[0-9]"))
    n = likely.select("at").distinct().count()
    share = F.shiftrightunsigned("at", 1) / F.lit(float(2**63))
    chosen = likely.filter(share < min(1.0, fit_rows / max(1, n))).dropDuplicates(["at"])

    def train(batches):
        parts = [b for b in batches if len(b)]
        texts = pd.concat(parts).sort_values(["at", "text"])["text"].tolist() if parts else []
        yield pd.DataFrame({"weights": [_train(texts).tobytes()]})

    (made,) = chosen.repartition(1).mapInPandas(train, "weights binary").collect()
    return np.frombuffer(made[0]).reshape(len(KINDS), len(FEATURES))


def model_spans(text: str, weights: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of entities that overlap no known span."""
    found = []
    for begin, end in _stretches(text):
        bounds, spans = _candidates(text, begin, end)
        for i, j, kind in best_segmentation(len(bounds) - 1, spans, weights):
            a, b = bounds[i], bounds[j]
            if all(b <= s or e <= a for s, _, e in known):
                found.append((a, kind, b))
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text; more are ignored): doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans and n_added.

    The counts and the digest are those of the fixed patterns; `spans` also has what the model
    adds. A null text counts as empty, repeated rows get equal results and an empty table an
    empty one. Whole texts are searched, however long.
    """
    weights = learn(docs) if weights is None else weights

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                known = pattern_spans(text)
                added = model_spans(text, weights, known)
                digest = hashlib.sha256(_listed(known).encode()).hexdigest()
                rows.append((*[sum(s[1] == k for s in known) for k in range(4)], digest, _listed(known + added), len(added)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pd.concat([batch[["key"]], pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    schema = "key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    kind = docs.schema["doc_id"].dataType
    made = docs.select(F.col("doc_id").cast("string").alias("key"), "text").mapInPandas(scan, schema)
    return made.select(F.col("key").cast(kind).alias("doc_id"), *made.columns[1:])

"""Operators on documents against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from adloom.llm import block_names, curriculum, jaccard_join, packing, pii, sampled_pieces, toxicity


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(texts):
    """The component of each text by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("frequent, small", [(64, 96), (-1000, 4), (2, 40)])
def test_similar_documents_equal_all_pairs(spark, monkeypatch, frequent, small):
    """Also with every shingle frequent, so that pairs of shingles are indexed."""
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 30, 90, 200]))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base * 6:
        edited = list(b)
        for _ in range(rnd.randrange(0, max(2, len(b) // 25))):
            edited[rnd.randrange(len(b))] = f"new{rnd.random()}"
        texts.append(" ".join(edited + ["tail"] * rnd.randrange(0, 12)))
    texts += ["shared passage of many words " * 1 + " ".join(base[3][:20]) + f" own {i}" for i in range(10)] + ["", None]
    limits = {"FREQUENT": frequent, "SMALL": small, "CLASSES": 4, "DEVIATIONS": 0}
    original = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "_postings", _postings_with(limits, original))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(docs).collect()}
    assert got == {i: (len(shingles(t)), r) for i, (t, r) in enumerate(zip(texts, roots(texts)))}


def _postings_with(limits, original):
    """Postings computed with other limits, also in Python workers."""
    import pandas as pd

    def postings(docs, table, n, percent):
        limit = limits["FREQUENT"] + float(table.mean())

        def scan(batches):
            jaccard_join.SMALL, jaccard_join.CLASSES = limits["SMALL"], limits["CLASSES"]
            for batch in batches:
                for tokens in jaccard_join.shingle_sets(batch["text"], n):
                    if len(tokens):
                        sig, place, plain = jaccard_join.signatures(tokens, table, limit, percent)
                        meta = np.int64(len(tokens)) << np.int64(32) | place.astype(np.int64) << 1 | np.int64(plain)
                        d1 = jaccard_join._names(tokens)[0]
                        yield pd.DataFrame({"sig": sig.view(np.int64), "d1": d1, "meta": meta})
            jaccard_join.SMALL, jaccard_join.CLASSES = 96, 64

        return docs.select("text").mapInPandas(scan, "sig long, d1 long, meta long")

    return postings


def test_unequal_words_have_unequal_names(spark):
    """Words on which names by polynomials fail, and words of every length alone and among others."""
    rng = random.Random(8)
    for n in (64, 1024, 2048):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = one.translate({97: "b", 98: "a"})
        names = jaccard_join._word_names(f"{one} {other} {one.upper()}".encode())[1].tolist()
        assert names[0] == names[2] != names[1]
        table = spark.createDataFrame([(1, f"{one} x y z"), (2, f"{other} x y z")], "doc_id long, text string")
        assert [r["component_id"] for r in jaccard_join.similar_documents(table).orderBy("doc_id").collect()] == [1, 2]
    some = ["".join(rng.choice("abAéü　") for _ in range(rng.randint(1, 90))).encode() for _ in range(400)]
    names = jaccard_join._word_names(b" ".join(some))[1].tolist()
    assert names == [int(jaccard_join._word_names(w)[1][0]) for w in some]
    lower = {w.lower() for w in some}
    assert len(set(names)) == len(lower)


def test_similar_documents_awkward(awkward, empty):
    got = jaccard_join.similar_documents(awkward).collect()
    assert len(got) == 11 and {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (3, 4, 5))
    assert jaccard_join.similar_documents(empty).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_exact_duplicates_equal_brute_force(spark, awkward, block):
    got = block_names.exact_duplicates(awkward, block).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = Counter(squeeze(t) for _, t in rows)
    assert Counter((r["doc_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(
        (i, groups[squeeze(t)], hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows
    )
    assert sum(r["kept"] for r in got) == len(groups)
    assert {r["keep_id"] for r in got if r["doc_id"] == 1} == {1} and {r["keep_id"] for r in got if r["doc_id"] == 3} == {5}


def test_names_do_not_depend_on_the_order_of_a_shuffle(spark, awkward):
    """Blocks and pairs of them are named by where they are in the table, however rows are dealt."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    names = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        names.append({(r["row"], r["n"], r["name"]) for r in block_names.identities(awkward, 3).collect()})
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert names[0] == names[1]


def test_exact_duplicates_empty(empty):
    assert block_names.exact_duplicates(empty).collect() == []


def test_schedule(awkward, empty):
    got = curriculum.schedule(awkward).collect()
    assert len(got) == 11
    for source in {r["source"] for r in got}:
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= len(rows)
        assert rows[0]["target"] <= 3 * rows[0]["source_size"] + 1e-9
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        assert all(0 <= p <= 1 for r in rows for p in r["positions"])
    total = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in total.values()) - sum(s for _, s in total.values())) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, curriculum.schedule(awkward.repartition(5)).collect()))
    assert curriculum.schedule(empty).collect() == []
    order = [r["position"] for r in curriculum.in_order(curriculum.schedule(awkward)).collect()]
    assert order == sorted(order) and order


def _plain_mix(rows, weights=(1, 2, 3), repeats=3):
    """(doc_id, size, source_size, target, taken, positions) per (order, doc_id, text, source), by plain loops."""
    streams = {}
    for order, doc_id, text, source in rows:
        streams.setdefault(source, []).append((order, doc_id, len(words(text))))
    names = sorted(streams, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for *_, n in streams[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    slope = {s: (-0.6, 0.0, 0.6)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > repeats * size[s]}
        target |= {s: repeats * size[s] if s in over else weight[s] * level for s in free}
        left -= sum(target[s] for s in over)
        if not over:
            break
        free -= over
    made = []
    for s in names:
        at = 0
        for _, doc_id, n in sorted(streams[s], key=lambda r: (r[0], r[1] or -1)):
            begins = [at + k * size[s] for k in range(repeats)]
            taken = sum(max(0.0, min(n, target[s] - b)) for b in begins)
            times = []
            for b in (b for b in begins if b < target[s]):
                low, high = 0.0, 1.0  # demand grows with time: halve until it meets
                for _ in range(60):
                    t = (low + high) / 2
                    low, high = (t, high) if target[s] * (t + slope[s] * (t * t - t)) < b else (low, t)
                times.append(high)
            made.append((doc_id, n, size[s], target[s], int(taken), times))
            at += n
    return made


@pytest.mark.parametrize("large", [1, 40])
def test_mixed_equals_plain_loops(spark, awkward, empty, large):
    """Sizes, caps, targets, words taken, and the ranks by training position."""
    rng = random.Random(large)
    rows = [(i, "w " * rng.randint(0, 30) * (large if i % 3 else 1), "abcé"[i % 3 if i % 7 else 3]) for i in range(300)]
    rows += [(None, f"w x{i}", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for table in (docs, awkward):
        named = table.selectExpr(f"xxhash64({curriculum.SEED}, doc_id, text)", "doc_id", "text", "source").collect()
        want = _plain_mix([tuple(r) for r in named])
        got = curriculum.mixed(table).collect()
        key = lambda r: (r[0] or -1, r[1], r[4], len(r[5]))
        have = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["positions"]) for r in got), key=key)
        for a, b in zip(have, sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
        assert sorted(p for r in have for p in r[5]) == pytest.approx(sorted(p for r in want for p in r[5]), abs=1e-6)
        ranked = sorted((rank, p) for r in got for rank, p in zip(r["ranks"], sorted(r["positions"]), strict=True))
        assert [rank for rank, _ in ranked] == list(range(len(ranked))) and [p for _, p in ranked] == sorted(p for _, p in ranked)
    assert curriculum.mixed(empty).collect() == []


def test_positions_follow_the_demand(spark):
    """A source whose weight falls comes early: half of its demand is met before half the time."""
    rows = [(i, "one two three", s) for i, s in enumerate(["a", "b", "c"] * 200)]
    got = curriculum.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    middle = {s: np.median([p for r in got if r["source"] == s for p in r["positions"]]) for s in "abc"}
    assert middle["a"] < 0.45 < middle["b"] < 0.55 < middle["c"]


def test_shards(spark, awkward, empty):
    rows = [(i, f"text {i % 700} " * (1 + i % 13), "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.shards_of(docs).collect()
    sizes, counts, slots, groups = Counter(), Counter(), {}, {}
    for r in got:
        text = rows[r["doc_id"]][1]
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text.encode()))
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(text, set()).add(r["shard"])
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert len(packing.shards_of(awkward).collect()) == 11 and packing.shards_of(empty).collect() == []
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    loads = Counter(r["shard"] for r in packing.shards_of(hot).collect())
    assert max(loads.values()) < 1.3 * min(loads.values())


def test_toxicity_learns_words_and_pairs(spark, awkward, empty):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w, y = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(30)], i % 4 == 0
        rows.append((i, " ".join(w + ["scoundrel"] * y)))
        labels.append((i, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    rest = toxicity.toxicity(awkward, known).collect()
    assert len(rest) == 11 and all(0 <= r["score"] <= 1 for r in rest)
    assert toxicity.toxicity(empty, known).collect() == []


def test_toxicity_pairs_alone():
    """Neither term alone tells the label, only both together."""
    rnd = np.random.default_rng(1)
    both = rnd.integers(0, 2, (3000, 2))
    rows = [np.array([10 * (1 + a), 500 * (1 + b)]) for a, b in both]
    labels = (both[:, 0] == both[:, 1]).astype(int)
    least, toxicity.LEAST_Z = toxicity.LEAST_Z, 0.0
    epochs, toxicity.EPOCHS = toxicity.EPOCHS, 60
    model = toxicity._fit(labels, rows)
    toxicity.LEAST_Z, toxicity.EPOCHS = least, epochs
    at = {p: i for i, p in enumerate(model["places"])}
    score = lambda r: model["bias"] + sum(model["weights"][at[p]] for p in r) + float(np.dot(*[model["factors"][at[p]] for p in r]))  # noqa: E731,E501
    assert np.mean([(score(r) > 0) == y for r, y in zip(rows[:300], labels)]) > 0.95


def test_toxicity_of_a_term_that_is_neutral_alone():
    """With production constants: a group's name is in as many toxic as other texts, but toxic beside an insult."""
    rnd = np.random.default_rng(2)
    insult, group, rows, labels = 11, 22, [], []
    toxic = {(True, True): 0.9, (True, False): 0.1, (False, True): 0.0, (False, False): 0.2}
    for _ in range(4000):
        has = rnd.random() < 0.2, rnd.random() < 0.5
        rows.append(np.unique([p for p, h in zip((insult, group), has) if h] + list(rnd.integers(1000, 1400, 20))))
        labels.append(int(rnd.random() < toxic[has]))
    model = toxicity._fit(np.array(labels), rows)
    assert insult in model["places"] and group in model["places"]
    at = {p: i for i, p in enumerate(model["places"])}

    def score(*terms):
        v = model["factors"][[at[p] for p in terms]]
        return model["bias"] + model["weights"][[at[p] for p in terms]].sum() + (v.sum(0) ** 2 - (v**2).sum(0)).sum() / 2

    assert score(insult, group) > 0 > max(score(insult), score(group))


def test_toxicity_ties_beside_another_term():
    """Places tied to the label beside a chosen term, against plain counting."""
    rnd = np.random.default_rng(4)
    labels = rnd.integers(0, 2, 400)
    rows = []
    for y in labels:
        marks = [7] * int(rnd.random() < 0.5) + [8] * int(y and rnd.random() < 0.7)
        rows.append(np.unique(np.array([*rnd.integers(50, 90, 6), *marks], np.int64)))
    least, toxicity.LEAST_PAIR_Z = toxicity.LEAST_PAIR_Z, 2.0
    got = toxicity._tied_beside(labels, rows, np.array([7, 8, 60]))
    toxicity.LEAST_PAIR_Z = least
    want = set()
    for chosen in (7, 60):  # 8 is in toxic texts alone
        held = [(y, r) for y, r in zip(labels, rows) if chosen in r]
        n, toxic = len(held), sum(y for y, _ in held)
        for term in {int(t) for _, r in held for t in r}:
            cells = Counter((int(y), term in r) for y, r in held)
            with_term = cells[0, True] + cells[1, True]
            ratio = 0.0
            for (y, has), seen in cells.items():
                expected = (toxic if y else n - toxic) * (with_term if has else n - with_term) / n
                ratio += 2 * seen * math.log(seen / expected) if seen else 0.0
            if with_term >= toxicity.LEAST_TEXTS and ratio >= 4.0:
                want.add(term)
    assert 8 in want and set(got.tolist()) == want
    assert not len(toxicity._tied_beside(labels, rows, np.array([], np.int64)))


def test_toxicity_of_repeated_ids(spark):
    """Repeats of a labelled id and of its label don't change the model but for the smallest of its texts."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("abcdefgh ", k=40)) + " scoundrel" * (i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    once = toxicity.learn(docs, known)
    often = toxicity.learn(docs.union(docs).union(docs.filter("doc_id = 8")), known.union(known))
    assert len(once["places"]) and all(np.array_equal(once[k], often[k]) for k in once)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_pattern_spans_equal_plain_expressions():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab@.1290+- ()ä") for _ in range(rnd.randrange(50)))
        assert pii.pattern_spans(text) == brute_spans(text), text


def test_best_segmentation_equals_all_segmentations():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        spans = [(i, j, [0, k % 5]) for k, (i, j) in enumerate(combinations(range(6), 2))]
        weights = rnd.normal(0, 1, (4, 5))

        def best(at):
            if at == 5:
                return 0.0
            return max([best(at + 1)] + [weights[:, f].sum(axis=1).max() + best(j) for i, j, f in spans if i == at])

        got = pii.best_segmentation(5, spans, weights)
        total = sum(weights[k][f].sum() for a, b, k in got for i, j, f in spans if (i, j) == (a, b))
        assert abs(total - best(0)) < 1e-9


def test_personal_data_adds_spans(spark, awkward, empty):
    rnd = random.Random(7)
    number = lambda: f"({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    rows = [(i, f"please call +1 {number()} or write to u{i}@mail{i}.example.org now") for i in range(200)]
    docs = spark.createDataFrame(rows + [(999, f"call me at {number()} today")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[0]["n_phone"] == 1 and got[0]["n_email"] == 1
    assert got[999]["n_phone"] == 0 and got[999]["spans"] == "phone:11:25"
    assert len(pii.personal_data(awkward).collect()) == 11 and pii.personal_data(empty).collect() == []


def test_personal_data_learns_each_text_once(spark):
    """Copies of a text, however many, are one text of the fit."""
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} or write to u{i}@mail{i}.example.org" for i in range(10)]
    once = spark.createDataFrame([(t,) for t in texts], "text string")
    often = spark.createDataFrame([(t,) for t in texts for _ in range(20 if t == texts[3] else 1)], "text string")
    assert (pii.learn(once) == pii.learn(often)).all()


def test_personal_data_is_learned_from_long_stretches():
    """A stretch of thousands of characters without a gap between numbers is learned from like a short one."""
    numbers = " ".join(f"+49 30 {5550000 + i}, " for i in range(200))
    assert max(b - a for a, b in pii._stretches(numbers)) > 2000
    bare = pii._train(["nothing here"])
    assert (bare == pii._train(["no number"])).all() and not (pii._train([numbers]) == bare).all()


def test_gradient_of_all_segmentations():
    """Observed minus expected features against a sum over every segmentation."""
    rnd = np.random.default_rng(3)
    n, spans = 4, [(0, 1, [0]), (0, 2, [1, 2]), (1, 3, [0, 3]), (2, 4, [2]), (3, 4, [1])]
    weights = rnd.normal(size=(len(pii.KINDS), 4))
    gold = {(0, 2, 1), (3, 4, 0)}

    def ways(at):
        if at == n:
            yield []
            return
        for rest in ways(at + 1):
            yield rest
        for k, (i, j, _) in enumerate(spans):
            if i == at:
                for kind in range(len(pii.KINDS)):
                    for rest in ways(j):
                        yield [(k, kind), *rest]

    every = list(ways(0))
    mass = np.array([np.exp(sum(weights[kind, spans[k][2]].sum() for k, kind in way)) for way in every])
    want = np.zeros_like(weights)
    for way, share in zip(every, mass / mass.sum()):
        for k, kind in way:
            want[kind, spans[k][2]] -= share
    for k, (i, j, f) in enumerate(spans):
        for kind in range(len(pii.KINDS)):
            want[kind, f] += (i, j, kind) in gold
    assert np.allclose(pii._gradient(n, spans, gold, weights), want)


def test_pieces(awkward, empty):
    got = sampled_pieces.encode(awkward, check=True)
    rows = got.collect()
    assert len(rows) == 11 and all(r["lossless"] for r in rows if r["ids"] is not None)
    assert [r["n_pieces"] for r in rows if r["doc_id"] in (3, 4)] == [0, 1]
    texts = {r["text"] for r in sampled_pieces.decode(got).collect()}
    assert texts == {r["text"] for r in awkward.collect()}
    again = sampled_pieces.encode(awkward.repartition(4)).collect()
    assert sorted((r["doc_id"] or 0, r["ids"] or []) for r in again) == sorted((r["doc_id"] or 0, r["ids"] or []) for r in rows)
    assert sampled_pieces.encode(empty).collect() == []


def test_pieces_are_drawn_with_their_probability():
    pieces = sampled_pieces.Pieces(sampled_pieces.MODEL, 1.0)

    def paths(word):
        if not word:
            yield [], 1.0
        for i in range(1, len(word) + 1):
            if word[:i] in pieces.weight:
                for rest, p in paths(word[i:]):
                    yield [pieces.text[word[:i]], *rest], p * pieces.weight[word[:i]]

    every = list(paths("▁then"))
    total, n = sum(p for _, p in every), 20_000
    seen = Counter(tuple(x) for x in pieces.sample(["then"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919)))
    assert max(abs(seen[tuple(s)] / n - p / total) for s, p in every) < 0.01
    one, many = sampled_pieces.Pieces(sampled_pieces.MODEL, 1.0), sampled_pieces.Pieces(sampled_pieces.MODEL, 1.0)
    for w in ("▁▁the", "ünä", "　"):
        one.add(w)
        many.add_many([w])
    assert one.start == many.start and one.piece == many.piece and one.first == many.first
    assert np.allclose(one.share, many.share)


def test_shares_do_not_depend_on_the_block():
    """Bit for bit: a word alone, among others in any order, and by the plain loop."""
    rng = random.Random(5)
    every = ["▁" * rng.randint(0, 2) + "".join(rng.choice("theainoü　") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    every = list(dict.fromkeys(every))
    block, back = (sampled_pieces.Pieces(sampled_pieces.MODEL, 1.0) for _ in range(2))
    block.add_many(every)
    back.add_many(every[::-1])
    plain = sampled_pieces.Pieces(sampled_pieces.MODEL, 1.0)
    for w in every:
        plain.forget()
        plain.add(w)
        for p in (block, back):
            a, b = p.first[p.places[w] - len(w)], p.first[p.places[w] + 1]
            assert p.share[a:b] == plain.share and p.piece[a:b] == plain.piece


def test_shards_of_rows_equal_in_all_columns(spark):
    """A third of all rows without an id and of one text: bytes and rows stay even, slots have no gap."""
    same = spark.range(40_000).selectExpr("cast(null as long) as doc_id", "repeat('one text ', 20) as text")
    other = spark.range(80_000).selectExpr("id as doc_id", "concat('text ', id, repeat(' word', cast(id % 40 as int))) as text")
    docs = same.union(other)
    got = packing.shards_of(docs).collect()
    assert len(got) == 120_000 and sum(r["doc_id"] is None for r in got) == 40_000
    slots, size = {}, Counter()
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    assert max(abs(v - mean) for v in size.values()) <= 0.05 * mean

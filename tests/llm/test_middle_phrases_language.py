"""Fill-in-the-middle, phrases and languages against brute force, on awkward rows and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from adloom.llm import collocations, fill_middle, language_kernel
from adloom.llm import queries as bound


def table(spark, tables, name="documents"):
    return spark.read.parquet(f"{tables}/{name}.parquet")


# fill-in-the-middle


def made_by_loops(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", prefix, middle
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", prefix, middle


def test_middle_equals_loops(spark, awkward, empty):
    odd = [(100 + i, t) for i, t in enumerate(["a<P>b", "x<S", "<S<M", "P>x <", "$1 \\ {2}", "\x00\n\r é\U0001f44d", "a" * 400_000 + " b" * 200_000])]
    docs = awkward.unionByName(spark.createDataFrame(odd * 3, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame([(i, f"un{i} mot\n à {i}" * (i % 7)) for i in range(200, 400)], "doc_id long, text string"), allowMissingColumns=True)
    got = fill_middle.restored(fill_middle.transformed(docs)).collect()
    wanted = Counter((r["doc_id"], *made_by_loops(r["doc_id"], r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n"], r["form"], r["output"], r["prefix"], r["middle"]) for r in got) == wanted
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], r["restored"]) for r in got) == texts
    assert fill_middle.restored(fill_middle.transformed(empty)).collect() == []


def test_middle_query_has_whole_results(spark, tables):
    got = {r["doc_id"]: r for r in bound.op11_fill_middle(spark, tables).collect()}
    for r in table(spark, tables).collect():
        n, form, output, prefix, middle = made_by_loops(r["doc_id"], r["text"])
        row, digest = got[r["doc_id"]], lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (row["n"], row["form"], row["output_sha256"]) == (n, form, digest(output))
        assert row["restored_sha256"] == digest(r["text"] or "")
        assert row["prefix_chars"] == (None if prefix is None else len(prefix))
        assert row["middle_chars"] == (None if middle is None else len(middle))


# phrases


def phrases_by_loops(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {
        (lang, w[i : i + k])
        for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)
        if 100 * a >= 100 * f[lang, w[i : i + k]]
    }
    each = {}
    for (lang, w), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        if (lang, w) not in inside:
            each.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:c]], f[lang, w[c:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, x in each.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])
    }


@pytest.mark.parametrize("block, held, entries, least", [(8_000_000, 10**6, 10**6, 5), (3_000, 500, 300, 3), (1, 1, 50, 20)])
def test_phrases_equal_loops(spark, tables, monkeypatch, block, held, entries, least):
    """Also with blocks, filters and ranges so small that all steps of merging are taken."""
    docs = table(spark, tables).select("lang", "text").limit(60).collect()
    rows = [(r["lang"], r["text"]) for r in docs]
    rows += [(None, "Red Rose, red rose; \t red rose! a b\ta b\x0ca b a b a b \x85 x" * 9), ("und", "a b a b"), ("de", None), ("fr", "")]
    rows += [("xx", "one two three four five six. " * 30)] * 2
    monkeypatch.setattr(collocations, "BLOCK_CHARS", block)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", entries)
    made = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = collocations.collocations(made.withColumn("score", made["text"]), least=least, top=40)
    assert {tuple(r) for r in found.collect()} == phrases_by_loops(rows, least, 40)


def test_phrases_awkward(spark, awkward, empty):
    docs = awkward.withColumns({"lang": awkward["source"], "words": awkward["text"], "a": awkward["text"]})
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in collocations.collocations(docs, least=2).collect()} == phrases_by_loops(rows, 2)
    assert collocations.collocations(empty.withColumn("lang", empty["source"])).collect() == []
    assert collocations.collocations(docs, least=10**6).collect() == []


def test_phrase_scores_pass_64_bits(spark):
    """The product 1000 a n of two counts near 2^40 is exact."""
    a, n, left, right = 2**40 + 1, 2**41 + 3, 2**40 + 5, 2**40 + 7
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    row = row.selectExpr(*[f"cast({c} as decimal(19,0)) as _{c}" for c in "anlr"])
    assert row.selectExpr("(_a * _n * 1000) div (_l * _r)").first()[0] == 1000 * a * n // (left * right)


@pytest.mark.parametrize("k, bits", [(2, 1), (2, 3), (3, 17), (5, 17), (5, 25), (4, 33), (2, 40)])
def test_filters_lose_nothing(k, bits):
    rng = np.random.default_rng(k * bits)
    words = [rng.integers(0, 2**bits, 3000) for _ in range(k)]
    words = [np.concatenate([w, w[:900], np.repeat(w[:1], 300)]) for w in words]
    wanted = Counter(zip(*[w.tolist() for w in words]))

    def back(f):
        return {tuple(t[:-1]): t[-1] for t in zip(*[w.tolist() for w in collocations.restored(f.words(), bits)], f.counts.tolist())}

    permuted = collocations.permuted(words, bits)
    assert all((a == b).all() for a, b in zip(collocations.restored(permuted, bits), words))
    one, entry = collocations.Filter.of(permuted, bits)
    assert back(one) == wanted
    assert all((w[entry] == p).all() for w, p in zip(one.words(), permuted))
    tripled = collocations.Filter.unpacked(collocations.Filter.merged([one] * 3)[0].packed())
    assert back(tripled) == {w: 3 * c for w, c in wanted.items()}
    parts = [collocations.Filter.unpacked(f.packed()) for _, f in one.ranges(5)]
    assert sum(len(f.counts) for f in parts) == len(one.counts) and back(collocations.Filter.merged(parts)[0]) == wanted


# languages


def test_kernel_equals_sets():
    texts = ["Der  Hund, das Ü-Ei 12", "the dog's\tegg", "ÉTÉ été", "日本 語x", "İI ß"]
    sets = []
    for text in texts:
        lower = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        sets.append({lower[i : i + n] for n in (1, 2, 3) for i in range(len(lower) - n + 1)})
    model = language_kernel.fit(texts, ["de", "en", "fr", "ja", "tr"])
    got = model.kernel([language_kernel.grams(t) for t in texts])
    wanted = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(got, wanted, atol=1e-6)
    # with every text a landmark, the fit is kernel ridge regression on centred data
    k, y = np.array(wanted), np.eye(5)
    h = np.eye(5) - 0.2
    dual = h @ k @ h
    fitted = dual @ np.linalg.solve(dual + language_kernel.RIDGE * np.eye(5), h @ y) + 0.2
    assert np.allclose(model.scores([language_kernel.grams(t) for t in texts]), fitted, atol=1e-4)
    assert model.predict(texts)[0] == ["de", "en", "fr", "ja", "tr"]


def test_languages_of_held_out_rows(spark, tables):
    docs = table(spark, tables.replace("0.001", "0.01"))
    got = {r["doc_id"]: r for r in bound.op13_language_id(spark, tables.replace("0.001", "0.01")).collect()}
    assert len(got) == docs.count()
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {i for i, r in got.items() if r["held_out"]}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert len(right) > 200 and sum(right) >= 0.99 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_learn_from_text_and_lang_alone(spark, tables):
    """Held-out rows' languages, null languages, other columns and the order of rows change nothing."""
    docs = table(spark, tables)
    plain = {r["doc_id"]: tuple(r) for r in language_kernel.languages(docs).collect()}
    held = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) as lang", "'x' as held_out", "text as score")
    changed = {r["doc_id"]: tuple(r) for r in language_kernel.languages(held.repartition(5)).collect()}
    assert changed == plain and "zz" not in {r[2] for r in plain.values()}


def test_languages_awkward(spark, awkward, empty):
    docs = awkward.withColumns({"lang": awkward["source"], "lang_pred": awkward["text"]})
    got = language_kernel.languages(docs).collect()
    assert len(got) == 11
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (3, 4, 5))
    assert language_kernel.languages(empty.withColumn("lang", empty["source"])).collect() == []
    unlabelled = docs.withColumn("lang", docs["text"].substr(9, 0).try_cast("int").cast("string"))
    assert {r["lang_pred"] for r in language_kernel.languages(unlabelled).collect()} == {"und"}

"""Operators on pages and vectors, and the pipeline."""

import gzip
import hashlib
import io
import os
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import curriculum, main_text, rp_forest, warc
from adloom.llm.common import numbered, released, stored


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "long enough, " * 100 + "</p>"
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", None), (5, "u", ""),
            (6, "u", "ü\r\n\r\nWARC/1.0\r\n"), (None, "u", big), (7, "u", "small"), (8, "u", "small")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    return made.withColumns({c: made["url"] for c in ("payload", "text", "value", "headers")})


def test_archives_round_trip(spark, pages):
    got = warc.archived(pages).collect()
    assert len(got) == 10 and all(r["intact"] for r in got)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None) == kinds[7] and kinds[None][1] == 3
    for r in pages.collect():
        body = (r["html"] or "").encode()
        match = [g for g in got if g["page_id"] == r["page_id"]][0]
        assert (match["payload_bytes"], match["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert warc.archived(pages.limit(0)).collect() == []


def test_archives_are_inflated_piece_by_piece():
    """Several members, one that inflates a thousandfold, and a stream cut at any byte."""
    parts = [b"a" * 5_000_000, b"", bytes(range(256)) * 300]
    whole = b"".join(gzip.compress(p) for p in parts)
    pieces = list(warc._inflated(io.BytesIO(whole)))
    assert b"".join(pieces) == b"".join(parts) and max(map(len, pieces)) <= warc._PIECE
    least, warc._PIECE = warc._PIECE, 7
    small = gzip.compress(b"some text, some text") + gzip.compress(b"more")
    assert b"".join(warc._inflated(io.BytesIO(small))) == b"some text, some textmore"
    warc._PIECE = least
    assert list(warc._inflated(io.BytesIO(b""))) == []


def test_main_text(pages):
    page = """<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">accept</div>
    <article><h1>Title &amp; more</h1><p><b>First, with, commas.<br><p>Second &lt;part&gt;</p><ul><li><a href=y>see</a></ul>
    <div id="comments"><p>What a reader, any reader, says</p></div></article><aside>side</aside><footer>foot</footer>"""
    assert main_text.main_text(page) == "Title & more First, with, commas. Second <part>"
    assert main_text.main_text(None) == main_text.main_text("<script>x</script>") == ""
    deep = "<div>" * 5000 + "<p>deep</p>"
    assert main_text.main_text(deep) == "deep"
    assert len(main_text.extracted(pages).collect()) == 10 and main_text.extracted(pages.limit(0)).collect() == []


def test_main_text_of_sections():
    """The whole article: short sections, lists, tables, captions and references too."""
    long = "".join(f"<p>Paragraph {i}, with, some, commas, and more words in it than a short one has.</p>" for i in range(8))
    references = "<h2>References</h2><ol><li><a href=x>First work</a></li><li><a href=y>Second work</a></li></ol>"
    page = f"""<body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>Short lead.</p><section><h2>One</h2>{long}</section>
    <section><h2>Two</h2><p>Brief, but part of it.</p></section><h3>Three</h3><ul><li>item</li></ul><table><tr><td>cell</td></tr></table>
    <figure><img src=z><figcaption>A caption</figcaption></figure><pre>code</pre><dl><dt>term</dt><dd>meaning</dd></dl>
    <ul><li><a href=z>A linked work</a>, by its author</li></ul><section>{references}</section>
    <div class="related"><a href=x>elsewhere</a></div></article><footer>foot</footer></body>"""
    got = main_text.main_text(page)
    every = ["Title", "Short lead.", "One", "Paragraph 7", "Two Brief, but part of it.", "Three item", "cell", "A caption", "code", "term",
             "meaning", "A linked work, by its author", "References First work Second work"]
    assert [x for x in every if x not in got] == [] and not any(x in got for x in ("menu", "elsewhere", "foot"))
    boxes = f"<body><div><div>{long}</div><h4>Then</h4><ul><li>short item</li></ul><p>End.</p><ul><li><a href=x>link</a></ul></div></body>"
    assert main_text.main_text(boxes).endswith("Then short item End.")


IN_ARTICLE = "<body><article>%s<p>Long text, with commas, and more, so that it counts as text.</p></article></body>"
KEPT = ['<h2 class="section-header">K</h2>', '<h2 class="entry-header">K</h2>', '<p class="ad-hoc">K</p>', '<p class="share-price">K</p>',
        '<section id="related-work">K</section>', '<section id="social-history"><p>K</p></section>', '<div class="widget-text">K</div>',
        "<math>K</math>", '<div class="entry-header"><h1>K</h1></div>', "<p title='a > b'>K</p>", "1 < 2 <3 K", "<p>x</z >K"]
DROPPED = ['<div class="ad">K</div>', '<div class="cookie-notice">K</div>', '<div id="ad-300x250">K</div>', '<div class="commentsArea">K</div>',
           '<ul class="share-buttons"><li>K</ul>', '<section id="related-posts">K</section>', '<div class="newsletter signup">K</div>',
           '<div class="x sidebar-left">K</div>', "<script>K</script>", "<!-- K -->", "<div hidden>K</div>", "<p title='K'>x</p>"]


@pytest.mark.parametrize("part", KEPT + DROPPED)
def test_main_text_by_classes(part):
    assert ("K" in main_text.main_text(IN_ARTICLE % part)) == (part in KEPT)


@pytest.mark.parametrize("unit", ["<a ", "<b>", '<a href="', "</z ", "<i>", "<ul><li><a>x</a>", "<a '\">", "<a \"<'", "<p><b>"])
@pytest.mark.parametrize("tail", [">", "</q>" * 20_000])
def test_main_text_of_broken_markup_in_linear_time(unit, tail):
    page, begin = unit * (300_000 // len(unit)) + tail, time.process_time()
    main_text.main_text(page)
    assert time.process_time() - begin < 20  # a few seconds; with the square of the page it takes minutes


@pytest.mark.parametrize("leaf", [16, 512])
def test_near_vectors_equal_brute_force(spark, leaf):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (60, 24))
    made = np.repeat(centres, 6, axis=0) + rng.normal(0, 0.12, (360, 24))
    made = np.concatenate([made, made[:40], np.repeat(made[:1], 30, axis=0)])
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(made)]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 0), (9004, [1.0, None], 0), (9005, [], 0),
           (9006, [1.0] * 24, None), (9007, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in rp_forest.near_vectors(table, leaf=leaf, trees=8).collect()}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    label = np.arange(len(made)) % 2
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    found = np.array([got[i]["n_links"] for i in range(len(made))])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.97 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9008)) and len(got) == len(made) + 7
    assert rp_forest.near_vectors(table.limit(0)).collect() == []


def test_near_vectors_of_a_large_group(spark):
    """A group of near copies larger than many leaves, with production parameters."""
    rng = np.random.default_rng(6)
    group = rng.normal(0, 1, 64) + rng.normal(0, 0.2, (5000, 64))
    made = np.concatenate([group, rng.normal(0, 1, (5000, 64))])
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(made)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in rp_forest.near_vectors(table).collect()}
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(made))])
    assert links.sum() > 10_000_000 and (found <= links).all() and found.sum() >= 0.999 * links.sum()


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, tables).cache()
        assert docs.columns == columns and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before.count()
    assert corpus_pipeline.to_pieces(spark, docs, tables).count() == docs.count()


def test_pipeline_stages_with_null_and_repeated_ids(spark):
    """Every stage's rows against brute force where ids tell little."""
    import corpus_pipeline

    word = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    near = lambda i, k: f"{word(i)} end{k}"
    rows = [(None, word(i)) for i in range(8)] + [(None, f" {word(i)}  ") for i in range(8)]
    rows += [(7, word(20)), (7, word(21)), (7, word(21)), (8, near(22, 1)), (9, near(22, 2)), (9, word(23))]
    rows += [(None, near(24, k)) for k in range(3)] + [(None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "abc"[i % 3]) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    plain = lambda found: sorted(("" if r["text"] is None else "".join(r["text"].split()), r["doc_id"] or -1) for r in found)
    squeezed = {}
    for i, t in rows:
        squeezed.setdefault("".join((t or "").split()), i)
    copies = corpus_pipeline.drop_copies(spark, docs, None).cache()
    assert plain(copies.collect()) == sorted((t, i or -1) for t, i in squeezed.items())
    apart = corpus_pipeline.drop_near_copies(spark, copies, None).cache()
    kept, left = {r["text"] for r in apart.collect()}, apart.count()
    assert near(22, 1) in kept and near(22, 2) not in kept and {word(20), word(21), word(23)} <= kept
    assert len([t for t in kept if t and t.startswith(word(24))]) == 1 and left == copies.count() - 3
    mixed = corpus_pipeline.mix_sources(spark, apart, None).collect()
    wanted = sum(r["whole"] for r in curriculum.schedule(apart).collect())
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed)
    assert abs(len(mixed) - wanted) <= 3 and max(times.values()) <= curriculum.REPEATS
    assert len(mixed) <= curriculum.REPEATS * left


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Columns named like those of the stages, empty documents, labels of one class or none."""
    import corpus_pipeline

    names = ["_score", "_row", "_position", "row", "number", "place", "group", "doc"]
    rows = [(i, f"text {i} of " + "some words " * i, "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(12)]
    rows += [(None, None, None, *[None] * 8), (3, "", "a", *[None] * 8)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)
    for k, (some, marks) in enumerate([(rows, [(1, 1), (2, 1)]), (rows, []), ([], [(1, 0), (2, 1)]), ([], [])]):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame(some, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, at).write.parquet(f"{at}/{j}")
            docs = spark.read.parquet(f"{at}/{j}")
            assert docs.columns == ["doc_id", "text", "source", *names]
            if j == 0:
                assert docs.count() == len(some)
            if j in (1, 2):  # of the null and the empty text the one with an id stays
                assert {(r["doc_id"], r["place"]) for r in docs.collect()} == {(r[0], r[8]) for r in some if r[0] is not None}
        got = corpus_pipeline.to_pieces(spark, docs, at).collect()
        assert len(got) == docs.count() and len({r["place"] for r in got}) == len(got) and bool(got) == bool(some)


def test_rows_of_a_sorted_table_keep_their_order(spark, tmp_path):
    spark.range(5_000).repartition(7).orderBy("id").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    rows = numbered(table, "n").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == list(range(5_000))
    joined = numbered(table.join(table.withColumnRenamed("id", "j"), F.col("id") % 7 == F.col("j")), "n")
    assert joined.select("n").distinct().count() == joined.count()


def test_released_tables_are_gone(spark):
    with released(spark):
        made = stored(spark.range(10), "released")
        files = made.inputFiles()
        assert made.count() == 10
    assert files and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)

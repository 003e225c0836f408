"""The operators bound to the given tables, one query each, and SQL to check them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import (
    block_names, collocations, curriculum, fill_middle, jaccard_join, language_kernel, main_text, packing, pii, rp_forest,
    sampled_pieces, toxicity, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark, sf_dir):
    """The sampled pieces of every document and whether decoding gives the text back."""
    docs = _table(spark, sf_dir, "documents")
    return sampled_pieces.encode(docs, check=True).select("doc_id", "n_pieces", "lossless", "ids")


def op2_mixing(spark, sf_dir):
    planned = curriculum.mixed(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "positions", "ranks")


def op3_sharding(spark, sf_dir):
    return packing.shards_of(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    found = block_names.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pii(spark, sf_dir):
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_html(spark, sf_dir):
    return main_text.extracted(_table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    found = warc.archived(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_vectors(spark, sf_dir):
    return rp_forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_fill_middle(spark, sf_dir):
    made = fill_middle.restored(fill_middle.transformed(_table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_language_id(spark, sf_dir):
    return language_kernel.languages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_mixing, op3_sharding, op4_exact_dedup, op5_toxicity, op6_pii, op7_html,
             op8_jaccard_join, op9_warc, op10_near_vectors, op11_fill_middle, op12_collocations, op13_language_id)
    return {q.__name__: q for q in every}


_EXACT = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS s
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(s) AS text_sha256
FROM d
"""

_JACCARD = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * n_common >= 80 * (p.n + q.n - n_common)
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents
    UNION
    SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""

_WARC = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages
), q AS (
    SELECT page_id, n, s, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s, n) END AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN last IS NOT NULL AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND last <> page_id THEN last END AS refers_to
FROM q
"""


_MIDDLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
    FROM documents
), h AS (
    SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda i:
        CAST('0x' || substr(s, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS h
    FROM d
), f AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90
                THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z
    FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
              ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_PHRASES = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), f AS (
    SELECT lang, w[i:i + k - 1] AS x, count(*) AS a
    FROM places CROSS JOIN range(1, 6) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(x) = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM f WHERE len(x) > 1 AND a >= 100
), cuts AS (
    SELECT *, unnest(range(1, len(x))) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.x, c.a, c.k, p.a AS l, q.a AS r, n, (1000::HUGEINT * c.a * n) // (p.a::HUGEINT * q.a) AS score
    FROM cuts c JOIN f p ON p.lang = c.lang AND p.x = c.x[1:c.k]
         JOIN f q ON q.lang = c.lang AND q.x = c.x[c.k + 1:] JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1
), inner_begins AS (
    SELECT lang, x, a, unnest(range(1, len(x) + 1)) AS i FROM candidates
), inside AS (
    SELECT lang, x[i:i + k - 1] AS y, max(a) AS longer
    FROM inner_begins CROSS JOIN range(2, 5) AS t(k) WHERE i + k - 1 <= len(x) AND k < len(x) GROUP BY 1, 2
), named AS (
    SELECT s.lang, array_to_string(s.x, ' ') AS phrase, s.a, s.l, s.r, s.n, CAST(s.score AS BIGINT) AS score
    FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.y = s.x
    WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
       phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose whole result it can express."""
    return {
        "op4_exact_dedup": _EXACT, "op8_jaccard_join": _JACCARD, "op9_warc": _WARC, "op11_fill_middle": _MIDDLE,
        "op12_collocations": _PHRASES,
    }

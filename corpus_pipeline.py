"""A corpus from raw documents to sampled pieces, stage by stage.

Each stage takes the rows that the one before kept, as a table at rest, and returns all columns
of `documents`, whatever their names; the last returns pieces. Rows with nulls in any column pass
like others, empty texts too, and an empty table gives an empty result. Ids may be null or repeated,
so a stage matches rows by a number of their own: a table at rest is numbered where it lies.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import block_names, curriculum, jaccard_join, sampled_pieces, toxicity
from adloom.llm.common import forget, new_folder, numbered, released, unused

#: Lattice edges kept by a task of the last stage, whose workers share their memory with what earlier stages left.
PIECE_EDGES = 3_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine rejects.

    Null and empty texts get the score of the model's bias. Without labels of both classes nothing can be
    told, and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, score = toxicity.learn(docs, labels), unused(docs, "_score")
    if not len(model["places"]):
        return docs
    return toxicity.scored(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, whatever the ids; null and blank texts are one group."""
    row = unused(docs, "_row")
    rows = numbered(docs, row)
    found = block_names.exact_duplicates(rows.select("doc_id", "text", row), row=row)
    kept = found.filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (null last), then the first, of each group of similar texts.

    Texts without words are similar to none, so all of them stay.
    """
    row = unused(docs, "_row")
    rows = numbered(docs, row)
    found = jaccard_join.similar_documents(rows.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    # joined by row, not by group, as a group may hold a third of all rows
    placed = found.join(rows.select(F.col(row).alias("number"), "doc_id"), "number")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number"))
    kept = placed.groupBy("group").agg(first.alias("first")).select(F.col("first.number").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, whole, range-sorted by training position.

    A copy is in if at least half of it lies within its source's demand. A document without words
    is in as often as its place in its source's stream lies within the demand; null sources are one source.
    """
    row, position = unused(docs, "_row"), unused(docs, "_position")
    rows = numbered(docs, row)
    narrow = rows.select("doc_id", "text", "source", F.col(row).alias("number"))
    planned = curriculum.schedule(narrow, row="number").filter("whole > 0")
    copies = F.explode(F.slice("positions", 1, F.col("whole"))).alias(position)
    joined = rows.join(planned.select(F.col("number").alias(row), copies), row)
    return joined.orderBy(position, "doc_id", row).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and place of each row.

    `place` orders the rows as they lie in `docs`: that of training, if `docs` was written in its order.
    """
    place = unused(docs, "_place")
    rows = numbered(docs, place).select("doc_id", "text", F.col(place).alias("place"))
    return sampled_pieces.encode(rows, keep=["place"], most_edges=PIECE_EDGES).select("doc_id", "n_pieces", "ids", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: The fit, the curriculum's order and the sampled pieces have no SQL form; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    What a stage keeps at rest is removed when its result is written, its input when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget(before)
        docs = before = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

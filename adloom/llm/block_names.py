"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text without white space is cut into blocks of a fixed number of characters. Equal blocks
sort together and get one integer name: the smallest number of a block of this content, where
blocks are numbered once, in the scan, and a pair has the number of its first block. Names
of adjacent blocks are then paired and the pairs named alike, until each document has one
name. Texts are equal exactly when they have as many blocks and the same last name; no hash
is trusted on the way. Copies of a block meet as partial minima, so a block that a third of
all documents share costs no task more than others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import SPACE, forget, stored

BLOCK = 4096


def squeezed(text: Column) -> Column:
    """The text without white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _blocks(docs: DataFrame, block: int, row: str | None) -> DataFrame:
    """(row, n, at, no, value, doc): the blocks of each row in order; an empty text has one empty block.

    `row` numbers the rows of this scan, unless a column is named that does, and `no` their blocks, which needs a table at rest; `doc`
    comes with the first block of a row.
    """
    whole = docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"), "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("chars"), squeezed(F.col("text")).alias("whole"),
    )
    n = F.greatest(F.ceil(F.length("whole") / block), F.lit(1)).cast("int")
    facts = F.struct("doc_id", "chars", F.sha2(F.col("whole").cast("binary"), 256).alias("sha"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("whole", i * block + 1, F.lit(block)))
    cut = whole.withColumn("n", n).select("row", "n", facts.alias("facts"), F.posexplode(parts).alias("at", "value"))
    cut = cut.withColumn("no", F.monotonically_increasing_id())
    return cut.select("row", "n", "at", "no", "value", F.when(F.col("at") == 0, F.col("facts")).alias("doc"))


def _named(parts: DataFrame, *content: str) -> DataFrame:
    """`parts` with `name` in place of `content`: equal content gets one integer, the smallest `no`
    of a part that holds it. `no` comes with the part, as rows may be numbered anew after a shuffle."""
    names = parts.groupBy(*content).agg(F.min("no").alias("name"))
    return parts.join(names, list(content)).select(*[c for c in parts.columns if c not in content or c == "n"], "name")


def identities(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(row, n, name, doc) per row of `docs` (doc_id, text): equal (n, name) means equal text."""
    now = stored(_named(_blocks(docs, block, row), "value"), "names")
    tables, size = [now], 1
    whole, left = now.filter("n = 1").drop("no"), now.filter("n > 1")
    while left.head(1):
        even, at = F.col("at") % 2 == 0, F.floor(F.col("at") / 2).cast("int").alias("at")
        pairs = left.groupBy("row", "n", at).agg(
            F.max(F.when(even, F.col("no"))).alias("no"),
            F.max(F.when(even, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second"),
        )
        now, size = stored(_named(pairs, "first", "second", "n"), "names"), size * 2
        tables.append(now)
        done = now.filter(F.col("n") <= size).join(tables[0].filter("at = 0").select("row", "doc"), "row")
        whole = whole.unionByName(done.select("row", "n", "at", "doc", "name"))
        left = now.filter(F.col("n") > size)
    found = stored(whole.select("row", "n", "name", "doc"), "identities")
    forget(*tables)
    return found


def exact_duplicates(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text; more columns are ignored): doc_id, keep_id, group_size, kept,
    text_sha256 and name, the integer all equal texts of the same number of blocks share.

    Texts are equal when they are after deleting white space; null counts as empty and all such
    rows are one group. The row with most characters in the original text stays, then the
    smallest doc_id (null last), then the first row: of rows repeated whole exactly one is kept.
    `row` may name a column that numbers the rows of `docs`; it is returned as `row`.
    An empty table gives an empty result.
    """
    facts = identities(docs, block, row).select("row", "n", "name", "doc.*")
    first = F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = facts.groupBy("n", "name").agg(F.min(first).alias("best"), F.count("*").alias("size"))
    return facts.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "name",
        *(["row"] if row else []),
    )

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (1, "the quick brown fox jumps over it", "a"), (1, "the quick brown fox jumps over it", "a"),
        (2, "The  QUICK brown\tfox jumps over it", "b"), (3, None, "a"), (4, "", None), (None, "the quick brown fox", "c"),
        (5, "   ", "b"), (6, long, "a"), (7, long + " more", "a"), (8, "ein ▁ Wort\n　日本 \U0001f44d", None),
        (9, "x", "c"),
    ]
    schema = "doc_id long, text string, source string"
    made = spark.createDataFrame(rows, schema)
    clash = {c: made["text"] for c in ("size", "shard", "keep_id", "score", "component_id", "row", "node", "_score", "before")}
    return made.withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

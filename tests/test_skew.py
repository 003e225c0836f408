import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adloom.operators.repeats import count_recent_repeats, repeated_occurrences
from adloom.operators.skew import heavy_counts, heavy_keys, key_name, key_sketch, sketched_keys, split_by_keys, split_large
from adloom.sources.readers import read_sketches, read_tsv
from adloom.sources.schemas import layout
from adloom.sources.writers import write_tsv
from tests.helpers import values


def test_listed_keys(spark):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(1, "b")] * 3 + [(None, "a")] * 4, "k int, g string")
    assert values(heavy_keys(rows, ["k", "g"], above=3)) == [(1, "a"), (None, "a")]
    # a key is listed from a quarter of all rows on; none has more than all
    assert values(heavy_keys(rows, ["k", "g"], above=2, most=4)) == [(1, "a"), (None, "a")]
    assert heavy_keys(rows, ["k", "g"], above=2, most=1) is None
    assert heavy_keys(rows, ["k", "g"], above=5) is None


def test_large_keys_are_found_on_a_sample(spark):
    rows = spark.range(300_000).selectExpr("case when id % 3 = 0 then -1 else id % 5000 end as k")
    assert values(heavy_keys(rows, ["k"], above=50_000)) == [(-1,)]
    assert heavy_keys(rows, ["k"], above=150_000) is None


def test_split_keeps_every_row(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    for listed in [[1], [None], [1, None], [7]]:
        heavy = spark.createDataFrame([(k,) for k in listed], "k int")
        others, found = split_by_keys(rows, ["k"], heavy)
        assert {r.k for r in found.collect()} <= set(listed)
        assert values(others.union(found)) == values(rows)


def test_counts_of_large_keys(spark):
    rows = spark.createDataFrame([(1,)] * 5 + [(2,)] * 3 + [(None,)] * 4, "k int")
    assert values(heavy_counts(rows, ["k"], above=3)) == [(1, 5), (None, 4)]


def sketches_of(spark, parts):
    made = [p.agg(F.count(F.lit(1)).alias("rows"), key_sketch(["g", "k"]).alias("sketch")) for p in parts]
    return made[0].unionByName(made[1])


def test_sketches_of_parts_are_combined(spark):
    """A key that is large only in all parts together; null keys; keys stored as other types."""
    first = spark.range(30_000).selectExpr("'u' as g", "if(id % 3 = 0, -1, id) as k")
    second = spark.range(9_000).selectExpr("if(id % 2 = 0, null, 'u') as g", "cast(if(id % 2 = 0, null, -1) as int) as k")
    both = sketches_of(spark, [first, second])
    named = {r[0]: r["name"] for r in first.union(second).select("k", key_name(["g", "k"]).alias("name")).distinct().collect() if r[0] in (-1, None)}
    assert [r[0] for r in sketched_keys(both, 12_000).collect()] == [named[-1]]
    assert {r[0] for r in sketched_keys(both, 4_000).collect()} == {named[-1], named[None]}
    assert sketched_keys(both, 20_000) is None and sketched_keys(both, 1, most=2) is None
    rows = first.union(second)
    light, heavy = split_large(rows, ["g", "k"], 4_000, both)
    assert heavy.columns == ["g", "k"] and heavy.count() == 19_000 and values(light.union(heavy)) == values(rows)


@pytest.mark.parametrize("split_above", [0, 3, 100, 10**9])
def test_written_rows_are_scanned_once(spark, tmp_path, monkeypatch, split_above):
    """With the sketch kept with the text no job looks for large keys, and the answers are the same."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(9), rng.choice("abcdef"), rng.randrange(60)) for _ in range(600)]
    schema = "user bigint, item string, at int"
    path = str(tmp_path / "rows")
    assert write_tsv(spark.createDataFrame(rows, schema), path, 3, ["user"]) == 600
    read = read_tsv(spark, path, layout(schema))
    assert read.count() == 600
    sketches = read_sketches(spark, path)
    plain = count_recent_repeats(read, ["user"], "item", ["at"], 3)
    chunks = repeated_occurrences(read, ["user"], "item", ["at"], ["at"], 10, 2)

    def not_asked(*args):
        raise AssertionError("the rows were looked at")

    monkeypatch.setattr("adloom.operators.skew.heavy_keys", not_asked)
    found = count_recent_repeats(read, ["user"], "item", ["at"], 3, split_above, sketches)
    assert values(found) == values(plain)
    if split_above == 10**9:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    again = repeated_occurrences(read, ["user"], "item", ["at"], ["at"], 10, 2, split_above, sketches)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, chunks.collect()))


def test_text_without_a_sketch(spark, tmp_path):
    write_tsv(spark.range(3), str(tmp_path / "rows"))
    assert read_sketches(spark, str(tmp_path / "rows")) is None

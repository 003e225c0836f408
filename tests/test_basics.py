import random

import pytest
from pyspark.sql import functions as F

from adloom.operators import keyed
from adloom.operators.keyed import pair_join
from adloom.plans import basics
from adloom.sources.readers import read_lines
from tests.helpers import values

LEFT = [("p", "oak"), ("q", "elm"), ("r", "ash"), ("s", "fir")]
RIGHT = [("p", "tall"), ("q", "wide"), ("r", "old"), ("t", "young")]
BOTH = [("p", "oak", "tall"), ("q", "elm", "wide"), ("r", "ash", "old")]


@pytest.mark.parametrize("split_above", [10**9, 0])
@pytest.mark.parametrize("how, extra", [
    ("inner", []), ("left", [("s", "fir", None)]), ("right", [("t", None, "young")]),
    ("full", [("s", "fir", None), ("t", None, "young")]),
])
def test_joins(spark, how, extra, split_above):
    left = spark.createDataFrame(LEFT, "k string, a string")
    right = spark.createDataFrame(RIGHT, "k string, b string")
    assert values(pair_join(left, right, ["k"], how, split_above)) == sorted(BOTH + extra, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joins_with_large_keys_on_either_side(spark, how):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(60)] + [(7, i) for i in range(20)]
    right = [(rng.choice([1, 4, 5, 9, 9, 9, None]), i) for i in range(60)]
    left_rows = spark.createDataFrame(left, "k int, a int")
    right_rows = spark.createDataFrame(right, "k int, b int")
    assert values(pair_join(left_rows, right_rows, ["k"], how, 12)) == values(left_rows.join(right_rows, ["k"], how))


def test_drop_incomplete(spark):
    rows = [(1, "birch", 0.5), (2, "77", 1.5), (3, "larch", 2.5), (4, None, 3.5), (5, "", float("nan"))]
    frame = spark.createDataFrame(rows, "label int, sentence string, double_value double")
    assert [r[0] for r in values(basics.drop_incomplete(frame), "label")] == [1, 2, 3]


def test_word_count_over_a_folder(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("leaf root\nleaf bark")
    assert values(basics.word_count(read_lines(spark, str(tmp_path)))) == [("bark", 2), ("leaf", 4), ("root", 2)]


@pytest.mark.parametrize("line, words", [
    ("a  b ", [("", 1), ("a", 1), ("b", 1)]), ("   ", []), ("", [("", 1)]), (" a", [("", 1), ("a", 1)]),
])
def test_blanks_in_words(spark, line, words):
    assert values(basics.word_count(spark.createDataFrame([(line,)], "value string"))) == words


def test_group_members(spark):
    numbers = spark.createDataFrame([(n,) for n in [1, 2, 3, 4]], "n int")
    grouped = basics.group_members(numbers, basics.parity(F.col("n")), "n")
    found = {r.label: [m.member for m in r.members] for r in grouped.collect()}
    assert found == {"even": [2, 4], "odd": [1, 3]}


def test_group_members_come_in_bounded_pieces(spark):
    numbers = spark.range(100).selectExpr("id").union(spark.createDataFrame([(4,)] * 50, "id bigint"))
    pieces = basics.group_members(numbers, basics.parity(F.col("id")), "id", span=10).collect()
    assert max(len(r.members) for r in pieces) == 5
    assert sum(m.copies for r in pieces for m in r.members) == 150


def test_square(spark):
    numbers = spark.createDataFrame([(n,) for n in range(1, 7)] + [(2147483647,)], "n int")
    assert [r.square for r in basics.square(numbers, "n").orderBy("n").collect()] == [
        1, 4, 9, 16, 25, 36, 2147483647**2]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("split_above", [0, 30, 10**9])
def test_salted_join_equals_plain_join(spark, monkeypatch, how, split_above):
    """Keys large on one side, on both and on none, null keys, equal rows and keys without a match."""
    monkeypatch.setattr(keyed, "SALT_ROWS", 7)
    monkeypatch.setattr(keyed, "COPIES", 5)
    rng = random.Random(9)
    left = [(rng.choice([1, 1, 1, 2, 3, 4, 9, None]), rng.choice("xy"), i % 3 * i) for i in range(260)]
    right = [(rng.choice([2, 2, 2, 1, 3, 5, 7, None]), rng.choice(["p", None])) for i in range(110)]
    a = spark.createDataFrame(left, "k int, g string, v int").repartition(3)
    b = spark.createDataFrame(right, "k int, w string").repartition(2)
    found = pair_join(a, b, ["k"], how, split_above, salted=True)
    assert found.columns == ["k", "g", "v", "w"] and values(found) == values(a.join(b, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("equal", [True, False])
def test_a_third_of_all_rows_is_spread_over_tasks(spark, monkeypatch, how, equal):
    """In a session with plain settings, and also if the rows of the key are all alike."""
    monkeypatch.setattr(keyed, "SALT_ROWS", 2_000)
    plain = spark.newSession()
    plain.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain.conf.set("spark.sql.shuffle.partitions", "32")
    value = "1" if equal else "id"
    left = plain.range(90_000).selectExpr("if(id % 3 = 0, -1, id) as k", f"{value} as v")
    right = plain.range(1000).selectExpr("id - 1 as k", "id as w")
    joined = pair_join(left, right, ["k"], how, 20_000, salted=True)
    assert joined.count() == left.join(right, ["k"], how).count()
    of_key = joined.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in of_key) == 30_000 and len(of_key) >= 8 and max(r["count"] for r in of_key) < 9_000

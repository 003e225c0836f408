import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adloom.operators import running
from adloom.operators.running import running_total, segment_bounds, segment_of
from adloom.plans.positions import position_quantile, position_value
from tests.helpers import rounded, values

CELLS = "site_set string, site_id string, position_id string, req_cnt string, ret_cnt string, real_cost_micros string, scene string"
ROWS = [
    ("25", "1", "1", "100", "150", "2000000", "1"),
    ("25", "1", "2", "100", "60", "1000000", "1"),
    ("25", "1", "2", "200", "60", "2000000", ""),
    ("25", "1", "3", "50", "100", "1", "1"),
    ("25", "1", "4", "50", "200", "1", "8"),
    ("25", "9", "5", "50", "200", "1", "1"),
    ("25", "1", "6", "", "200", "1", "1"),
    ("24", "1", "7", "50", "200", "1", "1"),
    ("25", "1", "", "50", "200", "1", "1"),
]
TYPED = "site_set int, site_id bigint, position_id bigint, req_cnt bigint, ret_cnt bigint, real_cost_micros double, scene bigint"


def typed():
    return [tuple(None if c == "" else float(c) if i == 5 else int(c) for i, c in enumerate(r)) for r in ROWS]


@pytest.mark.parametrize("form", ["text", "typed"])
def test_position_value_and_quantile(spark, form):
    table = spark.createDataFrame(ROWS, CELLS) if form == "text" else spark.createDataFrame(typed(), TYPED)
    found = position_value(table, excluded_sites=[9], excluded_scenes=[8])
    assert rounded(found) == [(1, 100, 20.0), (2, 300, 10.0)]
    assert rounded(position_quantile(found, "20240101")) == [
        (20240101, 1, 100, 20.0, 100, 0), (20240101, 2, 300, 10.0, 75, 0)]


def test_bad_number_raises(spark):
    table = spark.createDataFrame([("25", "1", "x1", "1", "200", "1", "1")], CELLS)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        position_value(table).collect()


@pytest.mark.parametrize("segments", [1, 3, 16])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_total_against_plain_sum(spark, segments, keys):
    """A third of the values are equal, and one group holds most rows."""
    rng = random.Random(segments)
    rows = [
        (0 if rng.random() < 0.7 else rng.randrange(5), 0.0 if rng.random() < 0.34 else rng.random(), i, rng.randrange(9))
        for i in range(700)
    ]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g int, v double, i int, m bigint")
    expected, sums = [], {}
    for g, v, i, m in sorted(rows):
        key = g if keys else None
        sums[key] = sums.get(key, 0) + m
        expected.append((g, v, i, m, sums[key]))
    if not keys:
        expected, total = [], 0
        for g, v, i, m in sorted(rows, key=lambda r: (r[1], r[2])):
            total += m
            expected.append((g, v, i, m, total))
    found = running_total(frame, "m", ["v", "i"], keys, segments)
    assert values(found, "g", "v", "i", "m", "running") == sorted(expected, key=repr)
    totals = {r.g: r.total for r in found.collect()}
    wanted = {g: (sum(r[3] for r in rows if r[0] == g) if keys else sum(r[3] for r in rows)) for g in totals}
    assert totals == wanted


def placed_in(rows, columns, segments):
    bounds = segment_bounds(rows, columns, segments).scalar()
    return rows.withColumn("bounds", bounds).withColumn("segment", segment_of(columns, "bounds"))


def test_equal_values_are_spread_over_segments(spark):
    """Equal leading values do not pile up in one segment."""
    rows = spark.range(4000).selectExpr("0.0D as v", "id as i", "1L as m")
    placed = placed_in(rows, ["v", "i"], 8)
    sizes = [r["count"] for r in placed.groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_segments_are_ranges(spark):
    """Nulls, not-a-number, nested and text columns are placed in Spark's own order."""
    rng = random.Random(5)
    rows = [
        ((rng.choice("abcé"), rng.choice([None, 1, 2])), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, float("inf")]), None if i % 9 == 0 else i)
        for i in range(900)
    ]
    frame = spark.createDataFrame(rows, "g struct<a: string, b: int>, v float, i int").distinct()
    columns = ["g", "v", "i"]
    placed = placed_in(frame, columns, 7).withColumn("place", F.row_number().over(Window.orderBy(*columns)))
    found = [r["segment"] for r in placed.orderBy("place").collect()]
    assert found == sorted(found) and set(found) == set(range(7))


@pytest.mark.parametrize("partitions", [1, 13])
def test_bounds_depend_on_the_rows_alone(spark, monkeypatch, partitions):
    monkeypatch.setattr(running, "SEGMENT_ROWS", 100)
    monkeypatch.setattr(running, "SAMPLED", 512)
    rows = spark.range(3000).selectExpr("id * 7919 % 3001 as v", "1L as m")
    found = segment_bounds(rows.repartition(partitions, "v"), ["v"]).first()["bounds"]
    assert found == segment_bounds(rows, ["v"]).first()["bounds"] and len(found) == 29
    total = running_total(rows.repartition(partitions, "v"), "m", ["v"])
    expected = {v: i + 1 for i, v in enumerate(sorted(id * 7919 % 3001 for id in range(3000)))}
    assert {r["v"]: r["running"] for r in total.collect()} == expected


def test_nothing_is_written_and_shuffles_are_shared(spark, tmp_path):
    """No checkpoint; an aggregated input is scanned once for bounds, sums and result."""
    spark.range(2000).selectExpr("id % 500 as v", "1L as m").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).groupBy("v").agg(F.sum("m").alias("m"))
    found = running_total(rows, "m", ["v"], segments=4)
    found = found.select("v", "m", "running", "total")
    assert sorted(tuple(r) for r in found.collect()) == [(v, 4, 4 * v + 4, 2000) for v in range(500)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan
    assert "ReusedExchange" in plan


def test_empty_input(spark):
    rows = spark.createDataFrame([], "position_id bigint, req_cnt bigint, cpr double")
    assert position_quantile(rows, "20240101").collect() == []

import pytest

from adloom.operators.keyed import last_written, look_up_last
from adloom.plans.consistency import score_consistency
from adloom.sources.schemas import SCORE_TRACKING, layout
from tests.helpers import records, values


def record(**changes):
    ads = [
        {"aindex": 1, "adgroup_id": 9, "product_id": "p", "advertiser_id": 3, "is_in_reranking": True,
         "pctr": 300000, "adjusted_pcvr": 0.5},
        {"aindex": 2, "pctr": 300000, "adjusted_pcvr": 0.5},
        {"aindex": 3, "pctr": 300000},
    ]
    mixer = {"exp_ids": [1], "ads": ads} | changes.pop("mixer", {})
    tracks = [
        {"ads": [{"aindex": 1, "ctr": 100000, "cvr": 100000}]},
        {"ads": None},
        {"ads": [{"aindex": 1, "ctr": 500000, "cvr": 400000}, {"aindex": 2, "ctr": 1}]},
    ]
    return {"page": {"site_set": 25}, "positions": [{"retrieval_tracks": tracks, "mixer_track": mixer}]} | changes


def scores(spark, *rows):
    return values(score_consistency(records(spark, layout(SCORE_TRACKING), list(rows))))


def test_last_track_wins(spark):
    assert scores(spark, record()) == [(9, 133, "p", 3)]


def test_positions_left_out(spark):
    unranked = [{"aindex": 1, "pctr": 300000, "adjusted_pcvr": 0.5}]
    assert scores(
        spark, record(page={"site_set": 24}), record(mixer={"om_ad_type": 1}), record(mixer={"exp_ids": []}),
        record(mixer={"ads": unranked}), record(positions=None), record(positions=[{"mixer_track": None}]),
        record(positions=[{"mixer_track": record()["positions"][0]["mixer_track"]}]),
    ) == []


def test_unset_index_looks_up_zero(spark):
    ads = [{"is_in_reranking": True, "pctr": 500000, "adjusted_pcvr": 1.0, "adgroup_id": 4}]
    row = record(mixer={"ads": ads})
    row["positions"][0]["retrieval_tracks"].append({"ads": [{"aindex": 0, "ctr": 500000, "cvr": 1000000}]})
    assert scores(spark, row) == [(4, 100, "", 0)]


def test_huge_ratio_is_held_at_the_largest_int(spark):
    ads = [{"aindex": 1, "is_in_reranking": True, "pctr": 1, "adjusted_pcvr": 1e-9}]
    assert scores(spark, record(mixer={"ads": ads})) == [(0, 2147483647, "", 0)]


def test_many_scores_are_searched_once_per_ad(spark):
    ads = [{"aindex": i, "adgroup_id": i, "is_in_reranking": True, "pctr": 500000, "adjusted_pcvr": 1.0} for i in range(200)]
    row = record(mixer={"ads": ads})
    early = [{"aindex": i % 500, "ctr": 500000, "cvr": 1000 * i} for i in range(1000)]
    row["positions"][0]["retrieval_tracks"] = [{"ads": early}]
    found = score_consistency(records(spark, layout(SCORE_TRACKING), [row]))
    ratios = {ad: ratio for ad, ratio, _, _ in values(found)}
    # the later of two scores counts: 0.5 * (i + 500) / 1000 * 100 / 0.5, cut to a whole number
    assert len(ratios) == 200 and all(abs(ratios[i] - (i + 500) / 10) <= 1 for i in range(200))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_position(") == 1


@pytest.mark.parametrize("split_above", [10**9, 1, 0])
def test_look_up_last(spark, split_above):
    writes = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 5, 50)], "key int, at int, score int")
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (4,)], "key int")
    found = look_up_last(rows, writes, ["key"], ["at"], {"score": 0}, split_above)
    assert values(found) == [(1, 20), (2, 50), (2, 50), (3, 0), (4, 0), (4, 0)]


def test_writes_are_thinned_before_the_shuffle(spark):
    writes = spark.range(10).selectExpr("id % 2 as key", "id as at", "id as score")
    plan = last_written(writes, ["key"], ["at"], ["score"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange hashpartitioning")[1]

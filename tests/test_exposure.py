import pytest

from adloom.plans import exposure
from adloom.sources.schemas import PAGE_VIEW, layout
from tests.helpers import records, values

DETAIL_COLUMNS = (
    "id trace_id position_id ping_time user_id open_id login_open_id media_specified_id article_id reward_time "
    "exp_id placement_type adgroup_id ad_type video_style_id video_duration pctr pcvr ecpm creative_id creative_size "
    "vertical_ids product_type brand_id os_version age gender education sdk_version app_version site_id"
).split()


def page(**fields):
    return {"id": "v1", "page": {"site_id": 1}} | fields


def test_detail(spark):
    full = page(
        login_openid="l", id_locators={"openid": "o", "encrypted_id": b"\xab\x01", "media_specified_id": "m"},
        device={"os_version": "9", "sdk_version": "s", "brand_id": 4}, user={"age": 30, "gender": 1, "education": 2},
        positions=[{
            "id": 10, "exp_ids": [4, 8, 7], "reward_time": 3, "article_id": 6,
            "triggers": [{"key": 8, "value": 1}, {"key": 9, "value": 4}, {"key": 9, "value": 5}],
            "imps": [{"id": "t1", "ping_time": 5, "ad": {"adgroup_id": 100, "vertical_ids": [1, 2], "smart_pcvr": 0.5}}],
        }],
    )
    bare = page(id="v2", id_locators={"openid": "o2"}, positions=[{"imps": [{"id": "t2"}]}])
    other = page(id="v3", page={"site_id": 5}, positions=[{"imps": [{"id": "t3"}]}])
    found = exposure.exposure_detail(records(spark, layout(PAGE_VIEW), [full, bare, other]), [1], [7, 8])
    assert found.columns == DETAIL_COLUMNS
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"v1", "v2"}
    assert rows["v1"].user_id == "ab01" and rows["v1"].exp_id == 8 and rows["v1"].placement_type == 4
    assert rows["v1"].vertical_ids == "1,2" and rows["v1"].age == 30 and rows["v1"].pcvr == 0.5
    assert rows["v2"].user_id == "o2" and rows["v2"].exp_id == 0 and rows["v2"].placement_type == -1
    assert rows["v2"].vertical_ids == "" and rows["v2"].adgroup_id == 0 and rows["v2"].os_version == ""


def test_cost(spark):
    def imp(trace, goal):
        return {"id": trace, "bill_cpm_micros": 2_500_000, "ad": {"goal": goal}}

    log = records(spark, layout(PAGE_VIEW), [page(positions=[{"imps": [imp("a", None), imp("b", 5), {"id": "c"}]}])])
    assert values(exposure.impression_cost(log, [1])) == [
        ("v1", "a", 2.5, 2.5), ("v1", "b", 2.5, 0.0), ("v1", "c", 0.0, 0.0)]


def test_play(spark):
    plays = spark.createDataFrame(
        [("v1", "t1", 5000, 1), ("v1", "t1", 3, 2), ("v1", "t2", 1000, 1), ("v2", "t3", 1001, 2), (None, "t4", 4, 2)],
        "id string, trace_id string, play_end_time int, finish_type int")
    assert values(exposure.play_times(plays)) == [("v1", "t1", 5, 3), ("v1", "t2", 1000, None), ("v2", "t3", 1, 1)]


@pytest.fixture
def three(spark):
    detail = spark.createDataFrame([("v1", "t1", 1), ("v1", "t2", 1), ("v2", "t9", 2)], "id string, trace_id string, site_id bigint")
    cost = spark.createDataFrame([("v1", "t1", 2.5, 0.0)], "id string, trace_id string, expose_cost double, expose_gmv double")
    play = spark.createDataFrame([("v1", "t2", 7, None)], "id string, trace_id string, play_time int, click_play_time int")
    return detail, cost, play


def test_dataset(three):
    assert values(exposure.exposure_dataset(*three)) == [
        ("v1", "t1", 1, 2.5, 0.0, 0, 0), ("v1", "t2", 1, 0.0, 0.0, 7, 0), ("v2", "t9", 2, 0.0, 0.0, 0, 0)]
    assert values(exposure.exposure_dataset(*three[:2])) == [
        ("v1", "t1", 1, 2.5, 0.0, 0, 0), ("v1", "t2", 1, 0.0, 0.0, 0, 0), ("v2", "t9", 2, 0.0, 0.0, 0, 0)]


@pytest.mark.parametrize("split_above", [10**9, 0])
def test_unset_ids_match_nothing(spark, three, split_above):
    detail, cost, play = three
    unset = [("", "", 3), ("", "t1", 3), ("v1", "", 3), (None, "t1", 3), ("v1", None, 3)]
    detail = detail.union(spark.createDataFrame(unset * 4, detail.schema))
    cost = cost.union(spark.createDataFrame([(i, t, 1.0, 1.0) for i, t, _ in unset] * 5, cost.schema))
    play = play.union(spark.createDataFrame([(i, t, 6, 2) for i, t, _ in unset], play.schema))
    found = exposure.exposure_dataset(detail, cost, play, split_above=split_above)
    got = [tuple(r) for r in found.collect()]
    assert sorted(r[2:] for r in got if r[2] == 3) == [(3, 0.0, 0.0, 0, 0)] * 20
    assert sorted(r for r in got if r[2] != 3) == values(exposure.exposure_dataset(*three))


def test_unset_ids_do_not_meet(spark, three):
    detail, cost, _ = three
    many = spark.range(1000).selectExpr("'' as id", "'' as trace_id", "id as site_id")
    spread = exposure._spread(detail.union(many))
    assert spread.select("spread").distinct().count() == 1001
    plan = exposure.exposure_dataset(detail.union(many), cost)._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert joined.count("spread") == 2


@pytest.mark.parametrize("files", [None, 2])
def test_write_replaces_only_its_day(spark, three, tmp_path, files):
    path = str(tmp_path / "wide")
    dataset = exposure.exposure_dataset(*three)
    for day in ["20240101", "20240102", "20240101"]:
        exposure.write_exposure_dataset(dataset, path, day, files)
    back = spark.read.parquet(path)
    assert back.groupBy("dayno", "site_id").count().count() == 4 and back.count() == 6

import pytest
from pyspark.sql import functions as F

from adloom.plans import metrics
from adloom.sources.schemas import PAGE_VIEW, layout
from tests.helpers import records, rounded, values


@pytest.fixture(scope="module")
def log(spark):
    def ad(**fields):
        return fields

    first = {
        "process_time": 1704067200, "partition_datetime": "2024010108", "page": {"site_id": 1},
        "positions": [
            {"id": 10, "exp_ids": [7, 8, 99], "imps": [
                {"bill_cpm_micros": 1_500_000,
                 "ad": ad(adgroup_id=100, goal=5, second_goal=0, target_cpa=250, product_type=1),
                 "clicks": [
                     {"bill_cpc_micros": 2_000_000, "traces": [
                         {"action_type": 5, "trade_type": 0}, {"action_type": 6, "trade_type": 0}]},
                     {"traces": []}]},
                {"ad": ad(adgroup_id=100, goal=5, second_goal=0, target_cpa=250, product_type=1, gmv_bias=1.2)},
            ]},
            {"id": 11, "exp_ids": [], "imps": [
                {"bill_cpm_micros": 1,
                 "ad": ad(adgroup_id=101, goal=204, target_cpa=100, product_type=25, gmv_bias=0.5)}]},
        ],
    }
    second = {
        "process_time": 1704067200, "partition_datetime": "2024010109", "page": {"site_id": 1},
        "positions": [
            {"id": 10, "exp_ids": [7, 7], "imps": [
                {"bill_cpm_micros": 0,
                 "ad": ad(adgroup_id=102, goal=204, second_goal=0, target_cpa=100, product_type=25, gmv_bias=2.0),
                 "clicks": [{"bill_cpc_micros": 500_000, "traces": [
                     {"action_type": 204, "trade_type": 3}, {"action_type": 204, "trade_type": 1}]}]}]},
        ],
    }
    return records(spark, layout(PAGE_VIEW), [first, second])


COLUMNS = [
    "site_id", "position_id", "exp_id", "adgroup_id", "goal", "second_goal", "target_cpa", "partition_time",
    "conv", "cost", "gmv", "imps", "clicks", "gmv_bias",
]
EXPECTED = [
    (1, 10, 7, 100, 5, 0, 250, "20240101", 1, 3.5, 2.5, 2, 2, 2.2),
    (1, 10, 7, 102, 204, 0, 100, "20240101", 2, 1.0, 2.0, 2, 2, 4.0),
    (1, 10, 8, 100, 5, 0, 250, "20240101", 1, 3.5, 2.5, 2, 2, 2.2),
]


def test_merged(log):
    merged = metrics.merged_metrics(log, log, log, [7, 8])
    assert merged.columns == metrics.KEYS + metrics.MEASURES
    assert rounded(merged, *COLUMNS) == EXPECTED
    assert {r.process_time for r in merged.collect()} == {"20240101"}


def test_merge_equals_sum_of_parts(log):
    parts = [
        metrics.exposure_metrics(log, [7, 8]),
        metrics.click_metrics(log, [7, 8]),
        metrics.conversion_metrics(log, [7, 8]),
    ]
    assert rounded(metrics.merge_summed(*parts), *COLUMNS) == EXPECTED


def test_requested_id_zero_is_left_out(spark):
    row = {"partition_datetime": "2024010100", "positions": [{"exp_ids": [0, 3], "imps": [{"ad": {}}]}]}
    log = records(spark, layout(PAGE_VIEW), [row])
    found = metrics.exposure_metrics(log, [0, 3])
    assert values(found, "exp_id", "site_id", "position_id", "adgroup_id", "imps", "gmv_bias") == [(3, 0, 0, 0, 1, 1.0)]


def test_write_counts_rows_and_merges(spark, log, tmp_path):
    counts = metrics.write_metrics(log, log, log, [7, 8], str(tmp_path / "out"))
    assert counts == {"expo_data": 3, "click_data": 3, "trace_data": 3, "merge_data": 3}
    assert rounded(spark.read.parquet(str(tmp_path / "out" / "merge_data")), *COLUMNS) == EXPECTED


def test_one_shuffle_for_the_merge(log):
    plan = metrics.merged_metrics(log, log, log, [7, 8])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_process_time_does_not_follow_session_zone(spark, log):
    # 17:00 UTC is the next day eight hours ahead
    late = log.withColumn("process_time", F.lit(1704128400).cast("bigint"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ["UTC", "America/New_York", "Asia/Tokyo"]:
            spark.conf.set("spark.sql.session.timeZone", name)
            days = {r.process_time for r in metrics.exposure_metrics(late, [7]).collect()}
            assert days == {"20240102"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("partitions", [1, 5])
def test_order_and_partitions_do_not_matter(spark, tables, partitions):
    from adloom.bindings.logs import EXPERIMENTS, derive_page_views

    pages = derive_page_views(spark, tables)
    expected = metrics.merged_metrics(pages, pages, pages, EXPERIMENTS)
    shuffled = pages.orderBy(F.rand(partitions)).repartition(partitions)
    assert values(metrics.merged_metrics(shuffled, shuffled, shuffled, EXPERIMENTS)) == values(expected)

import pytest

from adloom.plans import calibration
from adloom.sources.schemas import PAGE_VIEW, layout
from tests.helpers import records, rounded, values

RATES = [("A", 100, 10, 1), ("B", 50, 0, 0)]


@pytest.fixture
def extract(spark):
    first = [("A", .1, .01), ("A", .2, .02), ("A", .3, .03)]
    first += [(p, .9, .9) for p in ["B", "B", "C1", "C2", "C3", "C4", "C5", "A", "A"]]
    second = [("A", .3, .03), ("A", .2, .02), ("A", .1, .01)] + [("B", .5, .05)] * 3
    rows = [(1, user, *row, time) for user, seen in [("u1", first), ("u2", second)] for time, row in enumerate(seen)]
    return spark.createDataFrame(
        rows, "site_id bigint, open_id string, quality_product_id string, pctr float, pcvr float, ping_time int"
    )


@pytest.fixture
def rates(spark):
    return spark.createDataFrame(
        RATES, "quality_product_id string, exposure_cnt bigint, click_cnt bigint, active_cnt bigint"
    )


@pytest.mark.parametrize("split_above", [10**9, 7, 0])
def test_macro_and_pooled(extract, rates, split_above):
    occurrences = calibration.repeated_predictions(extract, split_above=split_above)
    assert sum(r.copies for r in occurrences.collect()) == 9
    assert rounded(calibration.bias_macro(occurrences, rates)) == [
        (order, 1.0, 0.8, 150, 10, 1) for order in range(3)]
    assert rounded(calibration.bias_pooled(occurrences, rates)) == [
        (order, 2.75, -0.7, 0.3, 0.03, 250, 20, 2) for order in range(3)]


def test_another_key_is_used_on_both_sides(spark, extract, rates):
    occurrences = calibration.repeated_predictions(extract.withColumnRenamed("quality_product_id", "ad"), key="ad")
    biases = calibration.bias_macro(occurrences, rates.withColumnRenamed("quality_product_id", "ad"), key="ad")
    assert biases.count() == 3


def test_extract(spark):
    def page(goal, vertical_ids, user="u", site=1):
        ad = {"goal": goal, "vertical_ids": vertical_ids, "rerank_pctr": 250000, "adjusted_pcvr": 0.5}
        return {"page": {"site_id": site}, "id_locators": {"openid": user},
                "positions": [{"id": 3, "imps": [{"ping_time": 9, "ad": ad}]}]}

    rows = [
        page(5, [21474838583, 21474836980]), page(5, [5]), page(5, []), page(5, None),
        page(None, []), page(0, []), page(7, []), page(5, [], user=""), page(5, [], user=None), page(5, [], site=3),
    ]
    found = calibration.impression_extract(records(spark, layout(PAGE_VIEW), rows), [1, 2])
    assert values(found, "second_class_id", "class_id") == [(0, 0), (0, 0), (0, 0), (2103, 21)]
    assert found.columns[:4] == ["site_id", "open_id", "position_id", "scene"] and len(found.columns) == 18
    row = found.first()
    assert (row.pctr, row.pcvr, row.scene, row.quality_product_id, row.ping_time) == (0.25, 0.5, 0, "", 9)
    types = [f.dataType.simpleString() for f in found.schema]
    assert types == [
        "bigint", "string", "bigint", "bigint", "string", "bigint", "int", "string", "int", "int", "bigint",
        "float", "float", "bigint", "bigint", "int", "int", "int"]


def test_actual_rates(spark):
    rows = [
        ("20240101", 25, 5, "1", "1", "0", "A"), ("20240101", 25, 204, "2", "0", "1", "A"),
        ("20240102", 25, 5, "9", "9", "9", "A"), ("20240101", 24, 5, "9", "9", "9", "A"),
        ("20240101", 25, 7, "9", "9", "9", "A"), ("20240101", 25, None, "9", "9", "9", "A"),
        ("20240101", 25, 0, "9", "9", "9", "A"), ("20240101", 25, 5, "4", "1", "1", None),
    ]
    table = spark.createDataFrame(
        rows, "process_date string, site_set int, smart_optimization_goal int, valid_exposure_cnt string, "
        "valid_click_cnt string, active_num string, quality_product_id string")
    assert values(calibration.actual_rates(table, "20240101")) == [("A", 3, 1, 1), (None, 4, 1, 1)]


def test_means_do_not_depend_on_order(spark):
    """Means over products, to the last digit, whatever the partitions."""
    occurrences = spark.range(3000).selectExpr(
        "concat('p', id % 997) as quality_product_id", "cast(id % 3 as int) as order", "rand(1) as pctr", "rand(2) as pcvr",
        "1L as copies")
    rates = spark.range(997).selectExpr(
        "concat('p', id) as quality_product_id", "id * 7919 % 997 + 3 as exposure_cnt", "id % 13 as click_cnt", "id % 5 as active_cnt")
    occurrences = spark.createDataFrame(occurrences.collect(), occurrences.schema)
    found = [
        values(calibration.bias_macro(occurrences.repartition(n, "quality_product_id"), rates.repartition(n)))
        for n in (1, 16)
    ]
    assert found[0] == found[1] and all(r[1] is not None for r in found[0])

import os

import pytest
from pyspark.sql import functions as F

from adloom.functions import dates, ids, scalars
from adloom.plans import metrics
from adloom.plans.calibration import EXTRACT_FIELDS
from adloom.sources import readers, writers
from adloom.sources.schemas import IMPRESSION_EXTRACT, PAGE_VIEW, layout, narrow
from tests.helpers import records, values


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def log(spark):
    row = {"id": "v", "process_time": 5, "partition_datetime": "2024010108", "page": {"site_id": 1},
           "positions": [{"id": 3, "exp_ids": [7], "imps": [{"ad": {"adgroup_id": 2}, "bill_cpm_micros": 4}]}]}
    return records(spark, layout(PAGE_VIEW), [row])


def test_narrow():
    schema = narrow(layout(PAGE_VIEW), ["page.site_id", "positions.imps.ad.goal", "positions.id"])
    assert schema.simpleString() == (
        "struct<page:struct<site_id:bigint>,positions:array<struct<id:bigint,imps:array<struct<ad:struct<goal:int>>>>>>")
    with pytest.raises(ValueError):
        narrow(layout(PAGE_VIEW), ["page.nothing"])
    with pytest.raises(ValueError):
        narrow(layout(PAGE_VIEW), ["id.part"])


def test_narrow_schema_reaches_the_scan(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    read = readers.read_records(spark, str(tmp_path / "lo*"), metrics.EXPOSURE_FIELDS)
    found = metrics.exposure_metrics(read, [7])
    assert values(found, "adgroup_id", "imps", "cost") == [(2, 1, 0.000004)]
    scan = found._jdf.queryExecution().toString()
    assert "quality_product_id" not in scan and "clicks:array" not in scan


def test_named_log_by_day_and_hour(spark, log, tmp_path):
    root = str(tmp_path / "logs")
    for name, hour in [("exposure", "2024010108"), ("exposure", "2024010109"), ("exposure", "2024010208"), ("click", "2024010108")]:
        log.withColumns({"log": F.lit(name), "date": F.lit(hour)}).write.mode("append").partitionBy("log", "date").parquet(root)
    fields = metrics.EXPOSURE_FIELDS
    assert readers.read_log(spark, root, "exposure", "20240101", fields).count() == 2
    assert readers.read_log(spark, root, "exposure", "2024010109", fields).count() == 1
    day = readers.read_log(spark, root, "click", "20240101", fields)
    assert day.count() == 1 and "log" not in day.columns
    assert all("/log=click/date=20240101" in file for file in day.inputFiles())


def test_daily_table_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    days = ["20240101", "20240102", "20240103", "20240104"]
    writers.write_partitioned(spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day string, n int"), path, ["day"])
    found = readers.read_daily_table(spark, path, "20240101")
    assert values(found, "n") == [(0,), (1,), (2,)]
    assert "day" in found.columns and not any("day=20240104" in file for file in found.inputFiles())


def test_catalog_table(spark):
    spark.createDataFrame([("20240101", 1), ("20231231", 2)], "day string, n int").createOrReplaceTempView("ads")
    assert values(readers.read_daily_table(spark, "ads", "20240101"), "n") == [(1,)]


def test_extract_round_trip(spark, tmp_path):
    row = (1, "u\"1", 2, 3, "", 4, 5, "p,1", 6, 7, 8, 0.1, 0.25, 9, 10, 11, 12, 13)
    rows = spark.createDataFrame([row], layout(IMPRESSION_EXTRACT))
    path = str(tmp_path / "extract")
    writers.write_tsv(rows, path, files=2)
    assert spark.read.text(path).first()[0].split("\t")[:5] == ["1", "u\"1", "2", "3", ""]
    assert readers.read_extract(spark, path).collect() == rows.collect()
    writers.write_tsv(rows, path)
    assert readers.read_extract(spark, path).count() == 1
    assert len(EXTRACT_FIELDS) == len(set(EXTRACT_FIELDS))


def test_tsv_decoding(spark, tmp_path):
    (tmp_path / "ads.tsv").write_text("1\t2\t3\n4\t5\t6\n")
    assert values(readers.read_clicks_and_conversions(spark, str(tmp_path / "ads.tsv"))) == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "bad.tsv").write_text("1\tx\t3\n")
    with pytest.raises(Exception):
        readers.read_clicks_and_conversions(spark, str(tmp_path / "bad.tsv")).collect()
    schema = layout("a bigint, b string, c string")
    lines = spark.createDataFrame([("1\tx\t",)], "value string")
    assert values(readers.decode_tsv(lines, schema)) == [(1, "x", "")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.decode_tsv(spark.createDataFrame([("z\tx\t",)], "value string"), schema).collect()


def test_only_complete_folders_are_read(spark, log, tmp_path):
    path = tmp_path / "video"
    log.write.parquet(str(path))
    assert readers.read_if_complete(spark, str(path), ["id"]).count() == 1
    (path / "_SUCCESS").unlink()
    assert readers.read_if_complete(spark, str(path), ["id"]) is None
    assert readers.read_if_complete(spark, str(tmp_path / "none"), ["id"]) is None


def test_report_is_one_ordered_file_with_header(spark, tmp_path):
    path = tmp_path / "report"
    writers.write_report(spark.range(20).repartition(4).withColumnRenamed("id", "order"), str(path), ["order"])
    files = list(path.glob("*.csv"))
    assert len(files) == 1
    assert files[0].read_text().split() == ["order", *map(str, range(20))]
    writers.write_csv(spark.range(20), str(tmp_path / "csv"), files=2)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 20


def test_counted_write(spark, tmp_path):
    assert writers.write_counted(spark.range(7), str(tmp_path / "n"), "n") == 7


def test_dates(spark):
    assert dates.days_from("20240228") == ["20240228", "20240229", "20240301"]
    row = spark.createDataFrame([("20231231",)], "d string").select(
        dates.add_days(F.col("d"), 1), dates.day_span(F.col("d"), 3), dates.day_prefix(F.lit("2024010108"))).first()
    assert tuple(row) == ("20240101", ["20231231", "20240101", "20240102"], "20240101")


@pytest.mark.parametrize("locators, expected", [
    ({"media_specified_id": "m", "guid": b"\x01"}, "m"),
    ({"guid": b"\x0f", "openid": "o"}, "0f"),
    ({"guid": b"\x0f", "openid": "o", "id_from_mapping": 1}, "o"),
    ({"wuid": "w", "openid": "o"}, "w"),
    ({"md5_imei": b"\xff", "id_from_mapping": 4, "md5_idfa": b"\xee"}, "ee"),
    ({"qidfa": "abc"}, "ABC"),
    ({"qidfa": "abc", "id_from_mapping": 16}, ""),
    ({}, ""),
])
def test_fallback_user_id(spark, locators, expected):
    bits = {"guid": 0, "wuid": 1, "md5_imei": 2, "md5_idfa": 3, "qidfa": 4}
    rows = records(spark, layout(PAGE_VIEW), [{"id_locators": locators}])
    assert rows.select(ids.fallback_user_id(F.col("id_locators"), bits)).first()[0] == expected


def test_text_and_zero_divisors(spark):
    row = spark.createDataFrame([(b"h\xc3\xa9",)], "raw binary").select(
        scalars.utf8_text(F.col("raw")), scalars.hex_text(F.col("raw")),
        scalars.deviation(F.lit(0.5), F.lit(0), F.lit(10)), scalars.deviation(F.lit(0.5), F.lit(5), F.lit(0))).first()
    assert tuple(row) == ("hé", "68c3a9", None, None)


@pytest.mark.parametrize("write", ["tsv", "csv", "ordered", "counted"])
def test_a_failed_write_leaves_the_old_output(spark, tmp_path, write):
    write = {
        "tsv": lambda rows, path: writers.write_tsv(rows, path, 2, ["id"]),
        "csv": writers.write_csv,
        "ordered": lambda rows, path: writers.write_ordered(rows, path, ["id"], 2),
        "counted": lambda rows, path: writers.write_counted(rows, path, "rows"),
    }[write]
    path = str(tmp_path / "out")
    write(spark.range(5), path)
    before = {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path) if f.startswith("part-")}
    broken = spark.range(100).selectExpr("if(id = 77, raise_error('stopped'), id) as id")
    with pytest.raises(Exception, match="stopped"):
        write(broken, path)
    assert {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path) if f.startswith("part-")} == before
    assert os.listdir(tmp_path) == ["out"]
    write(spark.range(7), path)
    after = {f for f in os.listdir(path) if f.startswith("part-")}
    assert after and not after & set(before) and os.listdir(tmp_path) == ["out"]


def test_an_exchange_that_fails_brings_the_old_output_back(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_csv(spark.range(5), path)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception), writers.replaced(spark, path):
        pass  # nothing was written, so there is nothing to move
    assert sorted(os.listdir(path)) == before and os.listdir(tmp_path) == ["out"]


def test_order_of_files(spark, tmp_path):
    """Names of files keep the order, ties and nulls included, and each row knows its place."""
    rows = spark.range(500).selectExpr("if(id % 10 = 0, null, id * 37 % 90) as v", "id")
    path = str(tmp_path / "out")
    writers.write_ordered(rows, path, ["v", "id"], 4)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert len(files) == 4
    lines = [line for f in files for line in open(f"{path}/{f}").read().splitlines()[1:]]
    expected = [(r["v"], r["id"]) for r in rows.orderBy("v", "id").collect()]
    assert [tuple(int(c) if c.strip('"') else None for c in line.split(",")) for line in lines] == expected
    placed = readers.read_in_order(spark, path, rows.schema)
    assert [(r["v"], r["id"]) for r in sorted(placed.collect(), key=lambda r: r["place"])] == expected
    assert sorted(r["place"] for r in placed.collect()) == list(range(1, 501))

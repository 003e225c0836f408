import os

import pytest

from adloom.sources import manifest
from tests.helpers import values

DDL = "id bigint, page struct<site_id: bigint, site_set: int>"


def read(spark, root, date, **more):
    return manifest.read_whole_hours(spark, root, "click", date, ["page.site_id"], DDL, **more)


def hour(spark, n):
    return spark.range(n).selectExpr("id", "struct(id as site_id, 25 as site_set) as page")


def test_only_whole_hours_are_read(spark, tmp_path):
    root = str(tmp_path / "logs")
    assert read(spark, root, "20240101") is None and manifest.whole_hours(spark, root, "click", "20240101") == []
    for n, name in enumerate(["2024010100", "2024010107", "2024010200"]):
        manifest.write_hour(hour(spark, n + 1), root, "click", name, 2)
    # an hour whose writer hasn't finished, and another log
    hour(spark, 50).write.parquet(f"{root}/log=click/date=2024010108")
    manifest.write_hour(hour(spark, 60), root, "trace", "2024010101")
    day = read(spark, root, "20240101")
    assert day.columns == ["page", "date"] and day.schema["page"].dataType.names == ["site_id"]
    assert values(day.select("page.site_id", "date")) == [(0, "2024010100"), (0, "2024010107"), (1, "2024010107")]
    assert read(spark, root, "2024010107").count() == 2
    assert read(spark, root, "2024010108") is None and read(spark, root, "20240103") is None
    assert not any("date=2024010108" in f for f in day.inputFiles())
    with pytest.raises(ValueError, match="2024010108"):
        read(spark, root, "20240101", expected=["2024010107", "2024010108"])


def test_an_hour_written_anew_is_whole_again_at_the_end(spark, tmp_path):
    root = str(tmp_path / "logs")
    manifest.write_hour(hour(spark, 3), root, "click", "2024010100")
    broken = hour(spark, 9).selectExpr("if(id = 7, raise_error('stopped'), id) as id", "page")
    with pytest.raises(Exception, match="stopped"):
        manifest.write_hour(broken, root, "click", "2024010100")
    assert read(spark, root, "2024010100") is None
    assert os.listdir(f"{root}/log=click") == ["date=2024010100"]
    manifest.write_hour(hour(spark, 4), root, "click", "2024010100")
    assert read(spark, root, "2024010100").count() == 4

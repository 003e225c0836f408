"""Each job from its input files to its output files."""

import pytest
from pyspark.sql import functions as F

from adloom import jobs
from adloom.bindings import logs as bound
from adloom.bindings import queries as Q
from adloom.plans import calibration, exposure, histogram
from adloom.sources import writers
from adloom.sources.readers import read_tsv
from adloom.sources.schemas import layout
from tests.helpers import values


@pytest.fixture(scope="module")
def folders(spark, tables, tmp_path_factory):
    """Logs derived from the given tables, laid out as the jobs expect."""
    root = tmp_path_factory.mktemp("logs")
    pages = bound.derive_page_views(spark, tables)
    pages.write.parquet(str(root / "records"))
    pages = spark.read.parquet(str(root / "records"))
    for name in ["exposure", "click", "trace", "cost"]:
        stamped = pages.withColumns({"log": F.lit(name), "date": F.lit("2024010108")})
        stamped.write.mode("append").partitionBy("log", "date").parquet(str(root / "named"))
    bound.derive_score_records(spark, tables).write.parquet(str(root / "scores"))
    writers.write_partitioned(bound.derive_daily_table(spark, tables), str(root / "daily"), ["day"])
    positions = bound.position_table(spark, tables).withColumn("day", F.lit("20240102"))
    writers.write_partitioned(positions, str(root / "positions"), ["day"])
    return {p.name: str(p) for p in root.iterdir()}


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_metrics(spark, tables, folders, tmp_path):
    out = str(tmp_path / "metrics")
    counts = jobs.run_metrics(spark, folders["named"], "20240101", Q.EXPERIMENTS, out)
    merged = spark.read.parquet(f"{out}/merge_data")
    expected = Q.merged_metrics(spark, tables)
    assert counts["merge_data"] == merged.count() == expected.count()
    for side, other in [(merged, expected), (expected, merged)]:
        assert side.select(*Q.metrics.KEYS, "conv", "imps", "clicks").exceptAll(
            other.select(*Q.metrics.KEYS, "conv", "imps", "clicks")).count() == 0


def test_extract_then_bias(spark, folders, tmp_path):
    extract = str(tmp_path / "extract")
    jobs.run_extract(spark, folders["records"], [1, 2], extract, files=3)
    pageviews = spark.read.parquet(folders["records"])
    assert spark.read.text(extract).count() == calibration.impression_extract(pageviews, [1, 2]).count()
    for pooled in [False, True]:
        out, rates = str(tmp_path / f"bias{pooled}"), str(tmp_path / f"rates{pooled}")
        jobs.run_bias(spark, extract, folders["daily"], "20240101", out, rates, min_repeats=2, pooled=pooled)
        report = spark.read.option("header", True).csv(out)
        assert report.columns[:3] == ["order", "ctr_bias", "cvr_bias"]
        assert spark.read.option("header", True).csv(rates).count() == 7


def test_histogram(spark, folders, tmp_path):
    out = str(tmp_path / "histogram")
    jobs.run_histogram(spark, folders["records"], [1, 2], out)
    pageviews = spark.read.parquet(folders["records"])
    expected = histogram.repeat_histogram(histogram.product_impressions(pageviews, [1, 2]))
    assert lines(spark, out) == sorted("\t".join(map(str, row)) for row in values(expected))


def test_position_profile(spark, folders, tmp_path):
    out = str(tmp_path / "profile")
    jobs.run_position_profile(spark, folders["positions"], "20240101", out, [6], [8])
    found = read_tsv(spark, out, layout("day int, position_id bigint, req_cnt bigint, cpr double, quantile int, zero int"))
    rows = sorted((r.cpr, r.position_id, r.quantile) for r in found.collect())
    assert rows and rows[-1][2] == 100 and [r[2] for r in rows] == sorted(r[2] for r in rows)


@pytest.mark.parametrize("complete", [True, False])
def test_exposure(spark, folders, tmp_path, complete):
    out, video = str(tmp_path / "wide"), tmp_path / "video"
    spark.read.parquet(folders["records"]).write.parquet(str(video))
    if not complete:
        (video / "_SUCCESS").unlink()
    jobs.run_exposure(spark, folders["named"], "20240101", [1, 2], Q.TARGETS, out, str(video))
    wide = spark.read.parquet(out)
    pageviews = spark.read.parquet(folders["records"])
    assert wide.count() == exposure.exposure_detail(pageviews, [1, 2], Q.TARGETS).count()
    assert (wide.filter("play_time > 0").count() > 0) == complete
    assert wide.filter("expose_cost > 0").count() > 0
    assert {(r.site_id, str(r.dayno)) for r in wide.select("site_id", "dayno").distinct().collect()} == {
        (1, "20240101"), (2, "20240101")}


def test_consistency(spark, folders, tables, tmp_path):
    out = str(tmp_path / "scores")
    jobs.run_consistency(spark, folders["scores"], out)
    assert len(lines(spark, out)) == Q.score_consistency(spark, tables).count()

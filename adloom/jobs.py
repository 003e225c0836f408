"""The jobs end to end: read, compute, write. Paths and codes are arguments."""

from collections.abc import Iterable

from pyspark.sql import SparkSession

from adloom import constants as C
from adloom.plans import calibration, consistency, exposure, histogram, metrics, positions
from adloom.sources import readers, writers
from adloom.sources.schemas import SCORE_TRACKING


def run_metrics(
    spark: SparkSession,
    logs: str,
    date: str,
    exp_ids: Iterable[int],
    out: str,
    text: bool = False,
    files: int | None = None,
) -> dict[str, int]:
    """Metrics of a day or hour from the exposure, click and trace logs, and their
    merge, as Parquet or tab-separated text; returns the row counts."""
    exposures = readers.read_log(spark, logs, "exposure", date, metrics.EXPOSURE_FIELDS)
    clicks = readers.read_log(spark, logs, "click", date, metrics.CLICK_FIELDS)
    traces = readers.read_log(spark, logs, "trace", date, metrics.TRACE_FIELDS)
    return metrics.write_metrics(exposures, clicks, traces, exp_ids, out, text, files)


def run_extract(spark: SparkSession, records: str, sites: Iterable[int], out: str, files: int | None = None) -> None:
    """Impression extract of a path or glob, as tab-separated text, with a sketch of its largest users."""
    pageviews = readers.read_records(spark, records, calibration.EXTRACT_FIELDS)
    writers.write_tsv(calibration.impression_extract(pageviews, sites), out, files, calibration.USER)


def run_bias(
    spark: SparkSession,
    extract: str,
    table: str,
    date: str,
    out: str,
    rates_out: str,
    key: str = "quality_product_id",
    chunk_rows: int = C.CHUNK_ROWS,
    min_repeats: int = C.MIN_REPEATS,
    pooled: bool = False,
) -> None:
    """Actual rates, and the bias by repeat order (one row per place in a chunk), as
    CSV. The written rates feed the join, so the table is read once, as is the extract if a sketch of
    its largest users is with it."""
    daily = readers.read_daily_table(spark, table, date)
    rates_table = f"{rates_out}-table"
    calibration.actual_rates(daily, date, key).write.mode("overwrite").parquet(rates_table)
    rates = spark.read.parquet(rates_table)
    occurrences = calibration.repeated_predictions(
        readers.read_extract(spark, extract), key, chunk_rows=chunk_rows, min_repeats=min_repeats,
        sketches=readers.read_sketches(spark, extract),
    )
    bias = calibration.bias_pooled if pooled else calibration.bias_macro
    writers.write_csv(rates, rates_out)
    writers.write_report(bias(occurrences, rates, key), out, ["order"])


def run_histogram(
    spark: SparkSession,
    records: str,
    sites: Iterable[int],
    out: str,
    lookback: int = C.LOOKBACK_ROWS,
    files: int | None = None,
) -> None:
    """Repeat histogram, as tab-separated text."""
    pageviews = readers.read_records(spark, records, histogram.FIELDS)
    impressions = histogram.product_impressions(pageviews, sites)
    writers.write_tsv(histogram.repeat_histogram(impressions, lookback=lookback), out, files)


def run_position_profile(
    spark: SparkSession,
    table: str,
    day: str,
    out: str,
    excluded_sites: Iterable[int] = (),
    excluded_scenes: Iterable[int] = (),
    files: int | None = None,
) -> None:
    """Value percentile of each position over the day and the two after it."""
    daily = readers.read_daily_table(spark, table, day)
    values = positions.position_value(daily, excluded_sites=excluded_sites, excluded_scenes=excluded_scenes)
    writers.write_tsv(positions.position_quantile(values, day), out, files)


def run_exposure(
    spark: SparkSession,
    logs: str,
    day: str,
    sites: Iterable[int],
    target_exp_ids: Iterable[int],
    out: str,
    video: str | None = None,
    files: int | None = None,
) -> None:
    """Wide exposure dataset of a day, one folder per site. `video` is the day's video
    log folder; it counts only once its writer has finished."""
    sites = list(sites)
    shown = readers.read_log(spark, logs, "exposure", day, exposure.DETAIL_FIELDS)
    billed = readers.read_log(spark, logs, "cost", day, exposure.COST_FIELDS)
    played = video and readers.read_if_complete(spark, video, exposure.VIDEO_FIELDS)
    dataset = exposure.exposure_dataset(
        exposure.exposure_detail(shown, sites, target_exp_ids),
        exposure.impression_cost(billed, sites),
        exposure.play_times(exposure.video_plays(played, sites)) if played else None,
    )
    exposure.write_exposure_dataset(dataset, out, day, files)


def run_consistency(spark: SparkSession, records: str, out: str, files: int | None = None) -> None:
    """Score ratios between the early and the final stage, as tab-separated text."""
    pageviews = readers.read_records(spark, records, consistency.FIELDS, SCORE_TRACKING)
    writers.write_tsv(consistency.score_consistency(pageviews), out, files)

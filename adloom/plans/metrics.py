"""Cost, conversion and value metrics per experiment."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.functions.dates import date_text, day_prefix, epoch_to_date
from adloom.functions.scalars import cents_to_units, is_platform_trade_left_out, micros_to_units, or_zero
from adloom.operators.flatten import to_clicks, to_experiments, to_impressions, to_positions, to_traces
from adloom.sources.readers import read_tsv
from adloom.sources.schemas import METRICS, layout
from adloom.sources.writers import write_counted, write_tsv

KEYS = [
    "site_id", "position_id", "exp_id", "adgroup_id", "goal", "second_goal", "target_cpa",
    "partition_time", "process_time",
]
MEASURES = ["conv", "cost", "gmv", "imps", "clicks", "gmv_bias"]

BIAS_SUMMED_AS = "decimal(28,9)"

# Summed by date, shown as text: far fewer dates are formatted.
SUM_KEYS = [*KEYS[:-1], "process_date"]

KEY_FIELDS = [
    "process_time", "partition_datetime", "page.site_id", "positions.id", "positions.exp_ids",
    "positions.imps.ad.adgroup_id", "positions.imps.ad.goal", "positions.imps.ad.second_goal",
    "positions.imps.ad.target_cpa",
]
EXPOSURE_FIELDS = [*KEY_FIELDS, "positions.imps.ad.gmv_bias", "positions.imps.bill_cpm_micros"]
CLICK_FIELDS = [*KEY_FIELDS, "positions.imps.clicks.bill_cpc_micros"]
TRACE_FIELDS = [*KEY_FIELDS, "positions.imps.ad.product_type", "positions.imps.clicks.traces"]


def exposure_metrics(exposures: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    """Cost, impressions and summed bias per key, from the exposure log."""
    return _summed(_exposure_rows(exposures, exp_ids))


def click_metrics(clicks: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    """Cost and clicks per key, from the click log."""
    return _summed(_click_rows(clicks, exp_ids))


def conversion_metrics(traces: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    """Conversions and their value per key, from the trace log."""
    return _summed(_trace_rows(traces, exp_ids))


def merged_metrics(exposures: DataFrame, clicks: DataFrame, traces: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    """All six measures per key: the rows of the three logs summed in one shuffle."""
    exp_ids = list(exp_ids)
    rows = (
        _exposure_rows(exposures, exp_ids)
        .unionByName(_click_rows(clicks, exp_ids))
        .unionByName(_trace_rows(traces, exp_ids))
    )
    return _summed(rows)


def merge_summed(*metrics: DataFrame) -> DataFrame:
    """Metrics that are already summed per key (e.g. read back), summed again."""
    rows = metrics[0]
    for more in metrics[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))


def write_metrics(
    exposures: DataFrame,
    clicks: DataFrame,
    traces: DataFrame,
    exp_ids: Iterable[int],
    folder: str,
    text: bool = False,
    files: int | None = None,
) -> dict[str, int]:
    """Writes the three metrics and their merge under `folder`; returns row counts.

    The merge reads the written tables, so each log is scanned once. As `text` the tables are
    tab-separated, in the columns of `METRICS`, and are read back strictly: a cell that
    isn't what its column holds raises. `files` is the number of files of each table.
    """
    exp_ids = list(exp_ids)
    parts = {
        "expo_data": exposure_metrics(exposures, exp_ids),
        "click_data": click_metrics(clicks, exp_ids),
        "trace_data": conversion_metrics(traces, exp_ids),
    }
    spark = exposures.sparkSession

    def write(rows: DataFrame, name: str) -> int:
        if text:
            return write_tsv(rows.select(*layout(METRICS).names), f"{folder}/{name}", files)
        return write_counted(rows, f"{folder}/{name}", name, files)

    counts = {name: write(rows, name) for name, rows in parts.items()}
    merged = merge_summed(*(read_metrics(spark, f"{folder}/{name}", text) for name in parts))
    counts["merge_data"] = write(merged, "merge_data")
    return counts


def read_metrics(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """A table that `write_metrics` has written."""
    return read_tsv(spark, path, layout(METRICS)) if text else spark.read.parquet(path)


def _impressions(log: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    """One row per impression and wanted experiment id, with the page's keys."""
    page = {
        "site_id": or_zero(F.col("page.site_id")),
        "partition_time": day_prefix(F.col("partition_datetime")),
        "process_date": epoch_to_date(or_zero(F.col("process_time"))),
    }
    positions = to_positions(log, *(value.alias(name) for name, value in page.items()))
    in_experiments = to_experiments(positions, exp_ids, *page)
    return to_impressions(
        in_experiments, *page, or_zero(F.col("position.id")).alias("position_id"), "exp_id"
    )


def _ad_keys() -> list[Column]:
    names = {"adgroup_id": "adgroup_id", "goal": "goal", "second_goal": "second_goal", "target_cpa": "target_cpa"}
    return [or_zero(F.col(f"imp.ad.{field}")).alias(name) for name, field in names.items()]


PAGE_AND_POSITION = ["site_id", "position_id", "exp_id", "partition_time", "process_date"]


def _exposure_rows(log: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    return _impressions(log, exp_ids).select(
        *PAGE_AND_POSITION, *_ad_keys(),
        *_measures(
            cost_micros=or_zero(F.col("imp.bill_cpm_micros")),
            imps=F.lit(1),
            gmv_bias=F.coalesce(F.col("imp.ad.gmv_bias"), F.lit(C.DEFAULT_GMV_BIAS)),
        ),
    )


def _click_rows(log: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    clicks = to_clicks(_impressions(log, exp_ids), *PAGE_AND_POSITION, *_ad_keys())
    return clicks.select(
        *PAGE_AND_POSITION, "adgroup_id", "goal", "second_goal", "target_cpa",
        *_measures(cost_micros=or_zero(F.col("click.bill_cpc_micros")), clicks=F.lit(1)),
    )


def _trace_rows(log: DataFrame, exp_ids: Iterable[int]) -> DataFrame:
    ad = ["adgroup_id", "goal", "second_goal", "target_cpa"]
    clicks = to_clicks(
        _impressions(log, exp_ids), *PAGE_AND_POSITION, *_ad_keys(),
        F.col("imp.ad.product_type").alias("product_type"),
    )
    traces = to_traces(clicks, *PAGE_AND_POSITION, *ad, "product_type")
    action = or_zero(F.col("trace.action_type"))
    left_out = is_platform_trade_left_out(F.col("product_type"), action, F.col("trace.trade_type"))
    counts = (F.col("goal") > 0) & (action == F.col("goal")) & ~left_out
    return traces.select(
        *PAGE_AND_POSITION, *ad,
        *_measures(
            conv=counts.cast("int"),
            gmv_cents=F.when(counts, F.col("target_cpa").cast("bigint")).otherwise(0),
        ),
    )


def _measures(**given: Column) -> list[Column]:
    """The six measures of a row in whole units; those not given are 0."""
    whole = ["conv", "cost_micros", "gmv_cents", "imps", "clicks"]
    return [given.get(name, F.lit(0)).cast("bigint").alias(name) for name in whole] + [
        given.get("gmv_bias", F.lit(0.0)).alias("gmv_bias")
    ]


def _summed(rows: DataFrame) -> DataFrame:
    """Sums per key. Money is summed in whole micros and cents, so that the order of
    summing does not matter, and divided once; the bias is summed as a decimal."""
    sums = rows.groupBy(*SUM_KEYS).agg(
        *(F.sum(m).alias(m) for m in ["conv", "cost_micros", "gmv_cents", "imps", "clicks"]),
        F.sum(F.col("gmv_bias").cast(BIAS_SUMMED_AS)).cast("double").alias("gmv_bias"),
    )
    return sums.select(
        *KEYS[:-1], date_text(F.col("process_date")).alias("process_time"),
        "conv",
        micros_to_units(F.col("cost_micros")).alias("cost"),
        cents_to_units(F.col("gmv_cents")).alias("gmv"),
        "imps", "clicks", "gmv_bias",
    )

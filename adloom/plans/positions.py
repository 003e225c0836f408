"""Value of ad positions and its percentile."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom import constants as C
from adloom.functions.scalars import or_zero, percent_of, text_to_number
from adloom.operators.running import running_total


def position_value(
    table: DataFrame,
    site_set: int = C.SITE_SET,
    excluded_sites: Iterable[int] = (),
    excluded_scenes: Iterable[int] = (),
    min_returns: int = C.MIN_RETURNS,
) -> DataFrame:
    """(position_id, req_cnt, cpr): cost per thousand requests of each position.

    Cells may be text, where blank is 0, or numbers, where null is 0. Conditions on
    numeric columns name the bare column, so they reach the scan. Costs are summed
    as decimals: the order of rows doesn't matter.
    """

    def cell(name: str, as_type: str = "bigint") -> Column:
        if isinstance(table.schema[name].dataType, T.StringType):
            return text_to_number(F.col(name), as_type)
        return or_zero(F.col(name)).cast(as_type)

    def is_text(name: str) -> bool:
        return isinstance(table.schema[name].dataType, T.StringType)

    def equal(name: str, value: int) -> Column:
        if is_text(name):
            return cell(name) == value
        same = F.col(name) == value
        return same | F.col(name).isNull() if value == 0 else same

    def outside(name: str, excluded: Iterable[int]) -> Column:
        excluded = list(excluded)
        if not excluded:
            return F.lit(True)
        if is_text(name):
            return ~cell(name).isin(excluded)
        other = ~F.col(name).isin(excluded)
        return other if 0 in excluded else other | F.col(name).isNull()

    chosen = table.filter(
        equal("site_set", site_set)
        & outside("site_id", excluded_sites)
        & ((cell("position_id") if is_text("position_id") else F.col("position_id")) > 0)
        & outside("scene", excluded_scenes)
    )
    sums = (
        chosen.groupBy(cell("position_id").alias("position_id"))
        .agg(
            F.sum(cell("req_cnt")).alias("req_cnt"),
            F.sum(cell("ret_cnt")).alias("ret_cnt"),
            F.sum(cell("real_cost_micros", "double").cast("decimal(28,6)")).cast("double").alias("cost_micros"),
        )
        .filter((F.col("req_cnt") > 0) & (F.col("ret_cnt") > min_returns))
    )
    cost = F.col("cost_micros") / C.MICROS_PER_UNIT
    return sums.select("position_id", "req_cnt", (cost * C.REQUESTS_PER_RATE / F.col("req_cnt")).alias("cpr"))


def position_quantile(values: DataFrame, day: str, segments: int | None = None) -> DataFrame:
    """Each position's percentile: the share of requests at positions of its value or
    less, in ascending value (then position) order, rounded up."""
    running = running_total(values, "req_cnt", ["cpr", "position_id"], segments=segments)
    return running.select(
        F.lit(int(day)).alias("day"),
        "position_id", "req_cnt", "cpr",
        percent_of(F.col("running"), F.col("total")).alias("cpr_quantile"),
        F.lit(0).alias("reserved"),
    )

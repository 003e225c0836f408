"""Predicted against actual rates, by how often a product was repeated."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.functions.arrays import first_class, second_class
from adloom.functions.scalars import deviation, or_blank, or_zero
from adloom.operators.flatten import to_impressions, to_positions
from adloom.operators.repeats import repeated_occurrences
from adloom.operators.skew import SPLIT_ABOVE

EXTRACT_FIELDS = [
    "page.site_id", "id_locators.openid", "positions.id", "positions.scene",
    "positions.imps.ping_time",
    *(
        f"positions.imps.ad.{name}"
        for name in [
            "quality_product_id", "adgroup_id", "advertiser_id", "product_id", "goal", "vertical_ids",
            "rerank_pctr", "adjusted_pcvr", "total_ecpm", "next_total_ecpm", "scoring_ctr", "scoring_cvr",
        ]
    ),
]
USER = ["site_id", "open_id"]
BIAS_PARTS = 1e9  # biases are averaged exactly in these parts, in any order
SUMMED_AS = "decimal(32,12)"  # predictions are summed exactly, in any order
COUNTS = ["exposure_cnt", "click_cnt", "active_cnt"]


def impression_extract(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    """Impressions with a tracked goal, of the sites' known users, in 18 columns."""
    open_id = F.col("id_locators.openid")
    known = pageviews.filter(F.col("page.site_id").isin(list(sites)) & (F.length(open_id) > 0))
    page = ["site_id", "open_id"]
    positions = to_positions(known, F.col("page.site_id").alias("site_id"), open_id.alias("open_id"))
    impressions = to_impressions(
        positions, *page,
        or_zero(F.col("position.id")).alias("position_id"),
        or_zero(F.col("position.scene")).alias("scene"),
    )
    goal = F.col("imp.ad.goal")
    tracked = impressions.filter((goal > 0) & (goal != C.EXCLUDED_GOAL)).withColumn(
        "second_class_id", second_class(F.col("imp.ad.vertical_ids"))
    )
    micros = F.lit(C.MICROS_PER_UNIT).cast("float")

    def number(field: str) -> Column:
        return or_zero(F.col(field))

    return tracked.select(
        *page, "position_id", "scene",
        or_blank(F.col("imp.ad.quality_product_id")).alias("quality_product_id"),
        number("imp.ad.adgroup_id").alias("adgroup_id"),
        number("imp.ad.advertiser_id").alias("advertiser_id"),
        or_blank(F.col("imp.ad.product_id")).alias("product_id"),
        goal.alias("goal"),
        first_class(F.col("second_class_id")).alias("class_id"),
        "second_class_id",
        (number("imp.ad.rerank_pctr").cast("float") / micros).cast("float").alias("pctr"),
        number("imp.ad.adjusted_pcvr").cast("float").alias("pcvr"),
        number("imp.ad.total_ecpm").alias("total_ecpm"),
        number("imp.ad.next_total_ecpm").alias("next_total_ecpm"),
        number("imp.ad.scoring_ctr").alias("ctr"),
        number("imp.ad.scoring_cvr").alias("cvr"),
        number("imp.ping_time").alias("ping_time"),
    )


def actual_rates(
    table: DataFrame, date: str, key: str = "quality_product_id", site_set: int = C.SITE_SET
) -> DataFrame:
    """Exposures, clicks and conversions of a day per `key`.

    `table` holds the partitions of the day and the two after it (see
    `read_daily_table`): rows of the day may arrive late.
    """
    chosen = table.filter(
        (F.col("process_date") == date)
        & (F.col("site_set") == site_set)
        & (F.col("smart_optimization_goal") > 0)
        & (F.col("smart_optimization_goal") != C.EXCLUDED_GOAL)
    )
    measures = dict(zip(COUNTS, ["valid_exposure_cnt", "valid_click_cnt", "active_num"]))
    return chosen.groupBy(key).agg(
        *(F.sum(F.col(source).cast("bigint")).alias(name) for name, source in measures.items())
    )


def repeated_predictions(
    extract: DataFrame,
    key: str = "quality_product_id",
    order_by: Sequence[str] = ("ping_time",),
    chunk_rows: int = C.CHUNK_ROWS,
    min_repeats: int = C.MIN_REPEATS,
    split_above: int = SPLIT_ABOVE,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """(key, pctr, pcvr, order, copies) of repeated products in each user's chunks."""
    return repeated_occurrences(
        extract, USER, key, order_by, ["pctr", "pcvr"], chunk_rows, min_repeats, split_above, sketches
    )


def bias_macro(occurrences: DataFrame, rates: DataFrame, key: str = "quality_product_id") -> DataFrame:
    """Absolute bias of each product's mean prediction, averaged over products, by order.

    Each bias is rounded to whole parts of BIAS_PARTS, which are summed as whole numbers, so the
    mean does not depend on the order of products.
    """
    means = _prediction_sums(occurrences, key).select(
        key, "order",
        (F.col("pctr_sum").cast("double") / F.col("occurrences")).alias("pctr"),
        (F.col("pcvr_sum").cast("double") / F.col("occurrences")).alias("pcvr"),
    )
    return (
        means.join(rates, key)
        .withColumn("ctr_bias", F.abs(_ctr_bias()))
        .withColumn("cvr_bias", F.abs(_cvr_bias()))
        .groupBy("order")
        .agg(
            _mean_in_any_order("ctr_bias").alias("ctr_bias"),
            _mean_in_any_order("cvr_bias").alias("cvr_bias"),
            *(F.sum(c).alias(c) for c in COUNTS),
        )
    )


def bias_pooled(occurrences: DataFrame, rates: DataFrame, key: str = "quality_product_id") -> DataFrame:
    """Signed bias of the mean over all occurrences, by order. A product's counts enter
    once per occurrence; occurrences are summed per product before the join, so that
    none of them is multiplied out."""
    per_product = _prediction_sums(occurrences, key).join(rates, key)
    times = F.col("occurrences")
    return (
        per_product.groupBy("order")
        .agg(
            (F.sum("pctr_sum").cast("double") / F.sum(times)).alias("pctr"),
            (F.sum("pcvr_sum").cast("double") / F.sum(times)).alias("pcvr"),
            *(F.sum(F.col(c) * times).alias(c) for c in COUNTS),
        )
        .select("order", _ctr_bias().alias("ctr_bias"), _cvr_bias().alias("cvr_bias"), "pctr", "pcvr", *COUNTS)
    )


def _exact(rate: str) -> Column:
    return F.col(rate).cast("double").cast("decimal(18,12)")


def _mean_in_any_order(ratio: str) -> Column:
    """The mean of a column of doubles, nulls left out; unset, infinite or not-a-number results are null."""
    parts = F.round(F.col(ratio) * F.lit(BIAS_PARTS)).cast("decimal(38,0)")
    return F.sum(parts).cast("double") / F.lit(BIAS_PARTS) / F.nullif(F.count(parts), F.lit(0))


def _prediction_sums(occurrences: DataFrame, key: str) -> DataFrame:
    copies = F.col("copies")
    return occurrences.groupBy(key, "order").agg(
        *(F.sum(_exact(c) * copies).cast(SUMMED_AS).alias(f"{c}_sum") for c in ["pctr", "pcvr"]),
        F.sum(copies).alias("occurrences"),
    )


def _ctr_bias():
    return deviation(F.col("pctr"), F.col("click_cnt"), F.col("exposure_cnt"))


def _cvr_bias():
    return deviation(F.col("pcvr"), F.col("active_cnt"), F.col("click_cnt"))

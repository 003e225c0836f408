"""The wide dataset: one row per impression, with its cost and video play."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.functions.arrays import joined_ids, placement_type, target_experiment
from adloom.functions.ids import preferred_user_id
from adloom.functions.scalars import micros_to_units, or_blank, or_zero, play_seconds
from adloom.operators.flatten import to_impressions, to_positions
from adloom.operators.keyed import look_up, pair_join
from adloom.operators.skew import SPLIT_ABOVE
from adloom.sources.writers import write_partitioned

DETAIL_FIELDS = [
    "id", "page.site_id", "page.app_version", "login_openid", "id_locators.openid",
    "id_locators.encrypted_id", "id_locators.media_specified_id", "device", "user",
    "positions.id", "positions.exp_ids", "positions.triggers", "positions.reward_time", "positions.article_id",
    "positions.imps.id", "positions.imps.ping_time",
    *(
        f"positions.imps.ad.{name}"
        for name in [
            "adgroup_id", "ad_type", "video_style_id", "video_duration", "rerank_pctr", "smart_pcvr",
            "total_ecpm", "creative_id", "creative_size", "vertical_ids", "product_type",
        ]
    ),
]
COST_FIELDS = ["id", "page.site_id", "positions.imps.id", "positions.imps.bill_cpm_micros", "positions.imps.ad.goal"]
VIDEO_FIELDS = ["id", "page.site_id", "positions.imps.id", "positions.imps.video"]
IMPRESSION = ["id", "trace_id"]
DEFAULTS = {"expose_cost": 0.0, "expose_gmv": 0.0, "play_time": 0, "click_play_time": 0}


def exposure_detail(pageviews: DataFrame, sites: Iterable[int], target_exp_ids: Iterable[int]) -> DataFrame:
    """One row per impression of the sites, in 31 columns."""

    def number(field: str, name: str) -> Column:
        return or_zero(F.col(field)).alias(name)

    def text(field: str, name: str) -> Column:
        return or_blank(F.col(field)).alias(name)

    head = [
        text("id", "id"),
        preferred_user_id(F.col("id_locators")).alias("user_id"),
        text("id_locators.openid", "open_id"),
        text("login_openid", "login_open_id"),
        text("id_locators.media_specified_id", "media_specified_id"),
    ]
    user = [
        number("device.brand_id", "brand_id"),
        text("device.os_version", "os_version"),
        *(number(f"user.{name}", name) for name in ["age", "gender", "education"]),
        text("device.sdk_version", "sdk_version"),
        text("page.app_version", "app_version"),
    ]
    page_names = [
        "id", "user_id", "open_id", "login_open_id", "media_specified_id", "brand_id", "os_version",
        "age", "gender", "education", "sdk_version", "app_version", "site_id",
    ]
    position_columns = [
        number("position.id", "position_id"),
        number("position.article_id", "article_id"),
        number("position.reward_time", "reward_time"),
        target_experiment(F.col("position.exp_ids"), target_exp_ids).alias("exp_id"),
        placement_type(F.col("position.triggers")).alias("placement_type"),
    ]
    positions = to_positions(_of_sites(pageviews, sites), *head, *user, number("page.site_id", "site_id"))
    impressions = to_impressions(positions, *page_names, *position_columns)
    return impressions.select(
        "id", text("imp.id", "trace_id"), "position_id", number("imp.ping_time", "ping_time"),
        "user_id", "open_id", "login_open_id", "media_specified_id", "article_id", "reward_time",
        "exp_id", "placement_type",
        number("imp.ad.adgroup_id", "adgroup_id"),
        number("imp.ad.ad_type", "ad_type"),
        number("imp.ad.video_style_id", "video_style_id"),
        number("imp.ad.video_duration", "video_duration"),
        number("imp.ad.rerank_pctr", "pctr"),
        number("imp.ad.smart_pcvr", "pcvr"),
        number("imp.ad.total_ecpm", "ecpm"),
        number("imp.ad.creative_id", "creative_id"),
        number("imp.ad.creative_size", "creative_size"),
        joined_ids(F.col("imp.ad.vertical_ids")).alias("vertical_ids"),
        number("imp.ad.product_type", "product_type"),
        "brand_id", "os_version", "age", "gender", "education", "sdk_version", "app_version",
        "site_id",
    )


def impression_cost(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    """(id, trace_id, expose_cost, expose_gmv); the cost is value where no goal is set."""
    cost = micros_to_units(or_zero(F.col("imp.bill_cpm_micros")))
    no_goal = or_zero(F.col("imp.ad.goal")) == 0
    return _page_impressions(pageviews, sites).select(
        *IMPRESSION,
        cost.alias("expose_cost"),
        F.when(no_goal, cost).otherwise(0.0).alias("expose_gmv"),
    )


def video_plays(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    """(id, trace_id, play_end_time, finish_type) per impression, as logged."""
    return _page_impressions(pageviews, sites).select(
        *IMPRESSION,
        or_zero(F.col("imp.video.play_end_time")).alias("play_end_time"),
        or_zero(F.col("imp.video.finish_type")).alias("finish_type"),
    )


def play_times(plays: DataFrame) -> DataFrame:
    """Longest play per impression, and longest among plays ended by a click.

    Plays ended by a click are a subset of all plays, so one grouping gives both.
    """
    seconds = play_seconds(F.col("play_end_time"))
    clicked = F.col("finish_type") == C.CLICKED_FINISH_TYPE
    return (
        plays.groupBy(*IMPRESSION)
        .agg(F.max(seconds).alias("play_time"), F.max(F.when(clicked, seconds)).alias("click_play_time"))
        .na.drop(subset=[*IMPRESSION, "play_time"])
    )


def exposure_dataset(
    detail: DataFrame,
    cost: DataFrame,
    play: DataFrame | None = None,
    defaults: Mapping[str, object] = DEFAULTS,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Detail with cost and, where the video log is complete, play times (one row per
    impression, see `play_times`).

    A blank or null id or trace id identifies no impression: such rows get the defaults,
    once each. They carry a hash of the row in the join key, so that they do not meet in
    one task.
    """
    key = [*IMPRESSION, "spread"]
    joined = pair_join(_spread(detail), _spread(cost).filter(_is_set()), key, "left", split_above)
    if play is None:
        zero = F.lit(0)
        joined = joined.withColumns({"play_time": zero, "click_play_time": zero})
    else:
        joined = look_up(joined, _spread(play).filter(_is_set()), key)
    return joined.drop("spread").na.fill(dict(defaults))


def _is_set() -> Column:
    return (F.col("id") != "") & (F.col("trace_id") != "")


def _spread(rows: DataFrame) -> DataFrame:
    """`rows` with a join column: 0, or a hash of the whole row where an id is unset. Not a
    literal on either side, as the join would then be hashed on the ids alone."""
    return rows.withColumn("spread", F.when(_is_set(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*rows.columns)))


def write_exposure_dataset(dataset: DataFrame, path: str, day: str, files: int | None = None) -> None:
    """One Parquet folder per site and day, replacing that day's."""
    write_partitioned(dataset.withColumn("dayno", F.lit(day)), path, ["site_id", "dayno"], files)


def _of_sites(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    return pageviews.filter(F.col("page.site_id").isin(list(sites)))


def _page_impressions(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    positions = to_positions(_of_sites(pageviews, sites), or_blank(F.col("id")).alias("id"))
    return to_impressions(positions, "id").select("id", or_blank(F.col("imp.id")).alias("trace_id"), "imp")

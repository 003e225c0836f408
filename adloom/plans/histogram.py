"""How often users see the same product again."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.functions.scalars import or_blank, or_zero
from adloom.operators.flatten import to_impressions, to_positions
from adloom.operators.repeats import count_recent_repeats
from adloom.operators.skew import SPLIT_ABOVE

FIELDS = [
    "page.site_id", "id_locators.openid",
    "positions.imps.ad.quality_product_id", "positions.imps.ping_time",
]
USER = ["site_id", "user_id"]


def product_impressions(pageviews: DataFrame, sites: Iterable[int]) -> DataFrame:
    """(site_id, user_id, product, ping_time) of the sites' known users."""
    user_id = F.col("id_locators.openid")
    known = pageviews.filter(F.col("page.site_id").isin(list(sites)) & (F.length(user_id) > 0))
    positions = to_positions(known, F.col("page.site_id").alias("site_id"), user_id.alias("user_id"))
    return to_impressions(positions, *USER).select(
        *USER,
        or_blank(F.col("imp.ad.quality_product_id")).alias("product"),
        or_zero(F.col("imp.ping_time")).alias("ping_time"),
    )


def repeat_histogram(
    impressions: DataFrame,
    order_by: Iterable[str] = ("ping_time",),
    lookback: int = C.LOOKBACK_ROWS,
    split_above: int = SPLIT_ABOVE,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Users per (site, impressions n, repeats p). A repeat is an impression whose
    product is among the user's `lookback` impressions before it."""
    per_user = count_recent_repeats(impressions, USER, "product", list(order_by), lookback, split_above, sketches)
    return per_user.groupBy("site_id", "n", "p").agg(F.count(F.lit(1)).alias("users"))

"""Agreement of early and final scores within a position."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.functions.scalars import micros_to_units, or_blank, or_zero, truncate_to_int
from adloom.operators.flatten import each, to_positions

FIELDS = [
    "page.site_set", "positions.retrieval_tracks", "positions.mixer_track",
]


def score_consistency(pageviews: DataFrame, site_set: int = C.SITE_SET) -> DataFrame:
    """(adgroup_id, ratio, product_id, advertiser_id) of ads scored in both stages.

    Early and final scores of a position sit in one record, so they are matched
    inside the row, without a shuffle. Of several early scores for an ad, the last
    one written counts.
    """
    positions = to_positions(pageviews.filter(F.col("page.site_set") == site_set))
    mixer = "position.mixer_track"
    ranked = positions.filter(
        (or_zero(F.col(f"{mixer}.om_ad_type")) != C.SKIPPED_AD_TYPE)
        & F.exists(f"{mixer}.ads", lambda ad: F.coalesce(ad["is_in_reranking"], F.lit(False)))
        & (F.size(f"{mixer}.exp_ids") > 0)
    )

    early = F.reverse(F.flatten(F.array_compact("position.retrieval_tracks.ads")))
    latest_first = ranked.withColumn("early", early)
    early_keys = F.transform(
        "early", lambda ad: F.when(ad["ctr"].isNotNull() & ad["cvr"].isNotNull(), ad["aindex"])
    ).alias("early_keys")
    ads = each(latest_first, f"{mixer}.ads", "ad", "early", early_keys).filter(
        F.col("ad.pctr").isNotNull() & F.col("ad.adjusted_pcvr").isNotNull()
    )

    last = F.array_position("early_keys", or_zero(F.col("ad.aindex"))).cast("int")
    # a generated column: the optimizer cannot paste the search into each of its uses
    matched = ads.select("ad", F.explode(F.array(F.get("early", last - 1))).alias("match"))
    scored = matched.select(
        "ad",
        micros_to_units(F.col("ad.pctr")).alias("pctr"),
        F.col("ad.adjusted_pcvr").alias("pcvr"),
        micros_to_units(or_zero(F.col("match.ctr"))).alias("lite_ctr"),
        micros_to_units(or_zero(F.col("match.cvr"))).alias("lite_cvr"),
    )
    usable = scored.filter("pctr > 0 and pcvr > 0 and lite_ctr > 0 and lite_cvr > 0")
    ratio = F.try_divide(F.col("lite_ctr") * F.col("lite_cvr") * 100, F.col("pctr") * F.col("pcvr"))
    return usable.select(
        or_zero(F.col("ad.adgroup_id")).alias("adgroup_id"),
        truncate_to_int(ratio).alias("ratio"),
        or_blank(F.col("ad.product_id")).alias("product_id"),
        or_zero(F.col("ad.advertiser_id")).alias("advertiser_id"),
    ).filter("ratio > 0")

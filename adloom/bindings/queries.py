"""Every job bound to the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom import constants as C
from adloom.bindings import logs
from adloom.bindings.logs import DAY, EXPERIMENTS, SITES, TARGETS, table
from adloom.functions import dates, ids, scalars
from adloom.operators import skew
from adloom.operators.keyed import look_up_last, pair_join
from adloom.operators.skew import SPLIT_ABOVE
from adloom.plans import basics, calibration, consistency, exposure, histogram, metrics, positions
from adloom.sources import manifest, readers, writers
from adloom.sources.readers import TAB, decode_tsv
from adloom.sources.schemas import CLICKS_AND_CONVERSIONS, layout

EXCLUDED_SITES = [6]
EXCLUDED_SCENES = [8]
RETURNS_NEEDED = 50
DIGITS = 6
CHAIN_KEY = "product_id"
CHAIN_CHUNK = 50
CHAIN_REPEATS = 2


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Means of doubles depend on summing order in the last digits."""
    return rows.withColumns({c: F.round(c, DIGITS) for c in columns})


def _item_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(spark, sf_dir).select(
        (F.col("user_id") % 2).alias("site_id"),
        "user_id",
        F.concat_ws("|", "event_type", F.col("k").cast("string")).alias("product"),
        "time_us", "event_id",
    )


def repeat_histogram(spark, sf_dir):
    return histogram.repeat_histogram(_item_impressions(spark, sf_dir), ["time_us", "event_id"])


def repeat_histogram_log(spark, sf_dir):
    impressions = histogram.product_impressions(logs.page_views(spark, sf_dir, histogram.FIELDS), SITES)
    return histogram.repeat_histogram(impressions)


def repeat_histogram_split(spark, sf_dir):
    """The same with every user taking the route of very large ones."""
    impressions = histogram.product_impressions(logs.page_views(spark, sf_dir, histogram.FIELDS), SITES)
    return histogram.repeat_histogram(impressions, split_above=0)


def exposure_metrics(spark, sf_dir):
    return metrics.exposure_metrics(logs.page_views(spark, sf_dir, metrics.EXPOSURE_FIELDS), EXPERIMENTS)


def click_metrics(spark, sf_dir):
    return metrics.click_metrics(logs.page_views(spark, sf_dir, metrics.CLICK_FIELDS), EXPERIMENTS)


def conversion_metrics(spark, sf_dir):
    return metrics.conversion_metrics(logs.page_views(spark, sf_dir, metrics.TRACE_FIELDS), EXPERIMENTS)


def merged_metrics(spark, sf_dir):
    per_log = [metrics.EXPOSURE_FIELDS, metrics.CLICK_FIELDS, metrics.TRACE_FIELDS]
    return metrics.merged_metrics(*(logs.page_views(spark, sf_dir, fields) for fields in per_log), EXPERIMENTS)


def exposure_detail(spark, sf_dir):
    detail = exposure.exposure_detail(logs.page_views(spark, sf_dir, exposure.DETAIL_FIELDS), SITES, TARGETS)
    return detail.withColumn("pcvr", F.col("pcvr").cast("double"))


def impression_cost(spark, sf_dir):
    """The cost log misses the pages with a click and holds those with a purchase twice."""
    log = logs.page_views(spark, sf_dir, exposure.COST_FIELDS).filter(F.col("event_type") != "click")
    times = F.array_repeat(F.lit(True), F.when(F.col("event_type") == "purchase", 2).otherwise(1))
    return exposure.impression_cost(log.select("*", F.explode(times).alias("billed")), SITES)


def video_play(spark, sf_dir):
    """The video log holds the pages that did not end in an error."""
    log = logs.page_views(spark, sf_dir, exposure.VIDEO_FIELDS).filter(F.col("event_type") != "error")
    return exposure.play_times(exposure.video_plays(log, SITES))


def exposure_enriched(spark, sf_dir):
    return exposure.exposure_dataset(
        exposure_detail(spark, sf_dir), impression_cost(spark, sf_dir), video_play(spark, sf_dir)
    )


def exposure_without_video(spark, sf_dir):
    return exposure.exposure_dataset(exposure_detail(spark, sf_dir), impression_cost(spark, sf_dir))


def impression_extract(spark, sf_dir):
    extract = calibration.impression_extract(logs.page_views(spark, sf_dir, calibration.EXTRACT_FIELDS), SITES)
    return extract.withColumns({c: F.col(c).cast("double") for c in ["pctr", "pcvr"]})


def actual_rates(spark, sf_dir):
    return calibration.actual_rates(logs.daily_table(spark, sf_dir), DAY)


def _repeated(spark, sf_dir):
    return calibration.repeated_predictions(logs.predictions(spark, sf_dir), order_by=["time_us"])


def repeated_predictions(spark, sf_dir):
    return _repeated(spark, sf_dir).groupBy("quality_product_id", "order").agg(
        F.sum("copies").alias("occurrences"),
        F.sum(F.col("pctr").cast("double") * F.col("copies")).alias("pctr_sum"),
    )


def repeated_predictions_split(spark, sf_dir):
    """The same with every user taking the route of very large ones."""
    found = calibration.repeated_predictions(
        logs.predictions(spark, sf_dir), order_by=["time_us"], split_above=0
    )
    return found.groupBy("quality_product_id", "order").agg(
        F.sum("copies").alias("occurrences"),
        F.sum(F.col("pctr").cast("double") * F.col("copies")).alias("pctr_sum"),
    )


def bias_macro(spark, sf_dir):
    biases = calibration.bias_macro(_repeated(spark, sf_dir), actual_rates(spark, sf_dir))
    return _rounded(biases, "ctr_bias", "cvr_bias")


def bias_pooled(spark, sf_dir):
    biases = calibration.bias_pooled(_repeated(spark, sf_dir), actual_rates(spark, sf_dir))
    return _rounded(biases, "ctr_bias", "cvr_bias", "pctr", "pcvr")


def _written_extract(spark, sf_dir) -> str:
    """The impression extract as text in a few files, with its sketch."""
    out = logs.output_folder(spark, sf_dir, "extract")
    extract = calibration.impression_extract(logs.page_views(spark, sf_dir, calibration.EXTRACT_FIELDS), SITES)
    writers.write_tsv(extract, out, 4, calibration.USER)
    return out


def _chain(bias, split_above: int):
    """From the log through the extract's text to the bias by repeat order, by a named column."""

    def query(spark, sf_dir):
        out = _written_extract(spark, sf_dir)
        occurrences = calibration.repeated_predictions(
            readers.read_extract(spark, out), CHAIN_KEY, chunk_rows=CHAIN_CHUNK, min_repeats=CHAIN_REPEATS,
            split_above=split_above, sketches=readers.read_sketches(spark, out),
        )
        rates = calibration.actual_rates(logs.daily_table(spark, sf_dir), DAY, CHAIN_KEY)
        return bias(occurrences, rates, CHAIN_KEY)

    return query


extract_bias = _chain(calibration.bias_macro, calibration.SPLIT_ABOVE)
extract_bias_split = _chain(calibration.bias_macro, 0)
extract_bias_pooled = _chain(calibration.bias_pooled, calibration.SPLIT_ABOVE)


def large_users(spark, sf_dir):
    """How many users of the written extract its sketch lists above 50 rows; few enough here to be counted exactly."""
    sketches = readers.read_sketches(spark, _written_extract(spark, sf_dir))
    listed = skew.sketched_keys(sketches, 50)
    rows = sketches.agg(F.sum("rows").alias("rows"))
    if listed is None:
        return rows.select("rows", F.lit(0).cast("bigint").alias("users"))
    return rows.withColumn("users", listed.agg(F.count(F.lit(1))).scalar())


def metrics_text(spark, sf_dir):
    """The merge of the three metrics as text, read back."""
    out = logs.output_folder(spark, sf_dir, "metrics")
    per_log = [metrics.EXPOSURE_FIELDS, metrics.CLICK_FIELDS, metrics.TRACE_FIELDS]
    pages = [logs.page_views(spark, sf_dir, fields) for fields in per_log]
    metrics.write_metrics(*pages, EXPERIMENTS, out, text=True, files=3)
    return metrics.read_metrics(spark, f"{out}/merge_data", text=True)


def ordered_report(spark, sf_dir):
    """Positions in order of their value, in files whose names keep the order, and where each was read."""
    out = logs.output_folder(spark, sf_dir, "report")
    ranked = position_quantile(spark, sf_dir).select("position_id", "cpr", "cpr_quantile")
    writers.write_ordered(ranked, out, ["cpr", "position_id"], 5)
    return readers.read_in_order(spark, out, ranked.schema)


PLAY = "id bigint, play_time int"


def log_day(spark, sf_dir):
    """What the whole hours of a day hold."""
    read = manifest.read_whole_hours(spark, logs.hourly_log(spark, sf_dir), "play", DAY, ["play_time"], PLAY)
    return read.groupBy("date").agg(F.count(F.lit(1)).alias("plays"), F.sum("play_time").alias("play_time"))


def log_hour(spark, sf_dir):
    return manifest.read_whole_hours(spark, logs.hourly_log(spark, sf_dir), "play", f"{DAY}02", ["id", "play_time"], PLAY)


def log_optional(spark, sf_dir):
    """Each event with its play of the event's hour: 0 where the hour is not whole."""
    root = logs.hourly_log(spark, sf_dir)
    shown = logs.events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("k") % logs.HOURS).alias("hour"))
    found = None
    for hour in range(logs.HOURS):
        of_hour = shown.filter(F.col("hour") == hour)
        played = manifest.read_whole_hours(spark, root, "play", f"{DAY}0{hour}", ["id", "play_time"], PLAY)
        if played is None:
            with_play = of_hour.withColumn("play_time", F.lit(0))
        else:
            with_play = of_hour.join(played.drop("date"), "id", "left").fillna(0, ["play_time"])
        found = with_play if found is None else found.unionByName(with_play)
    return found


def score_consistency(spark, sf_dir):
    return consistency.score_consistency(logs.score_records(spark, sf_dir, consistency.FIELDS))


def last_write_lookup(spark, sf_dir):
    writes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("aindex"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.col("l_quantity").cast("int").alias("ctr"), F.floor("l_extendedprice").cast("bigint").alias("cvr"),
    )
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 7).cast("int").alias("aindex"))
    return look_up_last(
        asked, writes, ["o_orderkey", "aindex"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], {"ctr": 0, "cvr": 0},
    )


def clicks_and_conversions(spark, sf_dir):
    lines = logs.events(spark, sf_dir).select(
        F.concat_ws(
            TAB, F.col("event_id").cast("string"), F.col("k").cast("string"), (F.col("user_id") % 5).cast("string")
        ).alias("value")
    )
    return decode_tsv(lines, layout(CLICKS_AND_CONVERSIONS))


def position_value(spark, sf_dir):
    return positions.position_value(
        logs.position_table(spark, sf_dir), excluded_sites=EXCLUDED_SITES, excluded_scenes=EXCLUDED_SCENES,
        min_returns=RETURNS_NEEDED,
    )


def position_quantile(spark, sf_dir):
    return positions.position_quantile(position_value(spark, sf_dir), DAY)


def word_count(spark, sf_dir):
    return basics.word_count(table(spark, sf_dir, "documents"), "text")


def _pairs(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("key"), F.col("l_partkey").alias("a")
    )
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("b"))
    return left, right


def _join_query(how: str, split_above: int = SPLIT_ABOVE, salted: bool = False):
    def query(spark, sf_dir):
        return pair_join(*_pairs(spark, sf_dir), ["key"], how, split_above, salted)

    return query


def drop_incomplete(spark, sf_dir):
    k = F.col("k")
    rows = logs.events(spark, sf_dir).select(
        F.col("event_id").alias("label"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(F.col("event_type")).alias("sentence"),
        F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, F.lit(None)).otherwise(F.col("value")).alias("double_value"),
    )
    return basics.drop_incomplete(rows)


def group_expr(spark, sf_dir):
    grouped = basics.group_members(
        table(spark, sf_dir, "lineitem"), basics.parity(F.col("l_partkey")), "l_partkey"
    )
    entries = F.transform("members", lambda m: F.concat_ws("x", m["member"].cast("string"), m["copies"].cast("string")))
    return grouped.select("label", "piece", F.array_join(entries, ",").alias("members"))


def square(spark, sf_dir):
    return basics.square(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


def user_id_chain(spark, sf_dir):
    located = logs.events(spark, sf_dir).select("event_id", logs.id_locators().alias("locators"))
    return located.select(
        "event_id",
        ids.fallback_user_id(F.col("locators"), logs.ID_BITS).alias("fallback_id"),
        ids.preferred_user_id(F.col("locators")).alias("preferred_id"),
    )


def date_strings(spark, sf_dir):
    day = F.date_format("o_orderdate", C.DAY_FORMAT)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.add_days(day, 3).alias("three_days_on"),
        F.array_join(dates.day_span(day, C.DAYS_READ), ",").alias("days_read"),
        dates.day_prefix(F.concat(day, F.lit("08"))).alias("day"),
        dates.epoch_to_day(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86_400 + 61_200).alias("log_day"),
    )


def text_cells(spark, sf_dir):
    rows = logs.position_table(spark, sf_dir)
    return rows.groupBy(scalars.text_to_number(F.col("position_id"), "bigint").alias("position_id")).agg(
        F.sum(scalars.text_to_number(F.col("req_cnt"), "bigint")).alias("req_cnt")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        repeat_histogram, repeat_histogram_log, repeat_histogram_split,
        exposure_metrics, click_metrics, conversion_metrics, merged_metrics,
        exposure_detail, impression_cost, video_play, exposure_enriched, exposure_without_video,
        impression_extract, actual_rates, repeated_predictions, repeated_predictions_split, bias_macro, bias_pooled,
        metrics_text, large_users, ordered_report, log_day, log_hour, log_optional,
        score_consistency, last_write_lookup, clicks_and_conversions,
        position_value, position_quantile,
        word_count, drop_incomplete, group_expr, square,
        user_id_chain, date_strings, text_cells,
    ]
    joins = {f"joins_{how}": _join_query(how) for how in ["inner", "left", "right", "full"]}
    # every key with more than four rows takes the route of large ones
    salted = {f"joins_{how}_salted": _join_query(how, 4, True) for how in ["inner", "left", "full"]}
    chains = {"extract_bias": extract_bias, "extract_bias_split": extract_bias_split, "extract_bias_pooled": extract_bias_pooled}
    return {query.__name__: query for query in named} | joins | salted | chains

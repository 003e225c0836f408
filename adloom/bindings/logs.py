"""Page-view logs and daily tables derived from the given tables.

Every row of the source becomes one record, with its arrays built inside the row,
so deriving a log needs no shuffle and grows with the table. Nested logs are written
once per session to the shared checkpoint folder and read back like any other log,
with only the fields a job needs.
"""

import hashlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.constants import CATEGORY_BASE
from adloom.session import use_checkpoint_dir
from adloom.sources.manifest import announce
from adloom.sources.readers import read_daily_table, read_records
from adloom.sources.schemas import PAGE_VIEW, SCORE_TRACKING
from adloom.sources.writers import write_partitioned

SITES = [1, 2]
EXPERIMENTS = [2, 7, 11, 12]
TARGETS = [3, 7, 12]
ID_BITS = {"guid": 0, "wuid": 1, "md5_imei": 2, "md5_idfa": 3, "qidfa": 1}
DAY = "20240101"
HOURS = 6
UNFINISHED = 3


def output_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a job bound to the given tables writes."""
    use_checkpoint_dir(spark)
    source = hashlib.md5(sf_dir.encode()).hexdigest()
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{source}"


_written: dict[tuple[str, str, str], str] = {}


def _written_log(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    derive: Callable[[SparkSession, str], DataFrame],
    partitions: Sequence[str] = (),
) -> str:
    """Folder of a derived log, written on first use in the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = output_folder(spark, sf_dir, name)
        if partitions:
            write_partitioned(derive(spark, sf_dir), path, partitions)
        else:
            derive(spark, sf_dir).write.mode("overwrite").parquet(path)
        _written[key] = path
    return _written[key]


def page_views(spark: SparkSession, sf_dir: str, fields: Iterable[str]) -> DataFrame:
    """The page-view log, with the given fields and the event type."""
    path = _written_log(spark, sf_dir, "page-views", derive_page_views)
    return read_records(spark, path, [*fields, "event_type"], f"{PAGE_VIEW}, event_type string")


def hourly_log(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a play log in six hours of a day, of which the fourth is still being written."""

    def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
        hour = F.concat(F.lit(f"{DAY}0"), (F.col("k") % HOURS).cast("string"))
        return events(spark, sf_dir).select(
            F.col("event_id").alias("id"), F.col("k").alias("play_time"), F.lit("play").alias("log"), hour.alias("date")
        )

    path = _written_log(spark, sf_dir, "plays", derive, ["log", "date"])
    for hour in range(HOURS):
        if hour != UNFINISHED:
            announce(spark, path, "play", f"{DAY}0{hour}")
    return path


def score_records(spark: SparkSession, sf_dir: str, fields: Iterable[str]) -> DataFrame:
    """The score-tracking log."""
    path = _written_log(spark, sf_dir, "score-records", derive_score_records)
    return read_records(spark, path, fields, SCORE_TRACKING)


def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily ad table's partitions of the day and the two after it."""
    path = _written_log(spark, sf_dir, "daily-table", derive_daily_table, ["day"])
    return read_daily_table(spark, path, DAY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in `props` as `k` and the time as whole numbers."""
    ts = F.col("ts")
    day_seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400
    seconds = day_seconds + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        micros.alias("time_us"),
        F.floor(micros / 1_000_000).cast("int").alias("time_s"),
        F.date_format(ts, "yyyyMMddHH").alias("hour"),
    )


def _cents(value: Column) -> Column:
    return F.floor(value * 100).cast("bigint")


def _prefixed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _struct(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items()))


def id_locators() -> Column:
    user = F.col("user_id")

    def of(prefix: str, every: int) -> Column:
        return F.when(user % every == 0, _prefixed(prefix, user))

    return _struct(
        openid=F.when(user % 13 != 0, _prefixed("u", user)),
        encrypted_id=F.encode(of("e", 3), "UTF-8"),
        media_specified_id=of("m", 5),
        guid=F.encode(of("g", 7), "UTF-8"),
        wuid=of("w", 4),
        md5_imei=F.unhex(F.md5(of("i", 2))),
        md5_idfa=F.unhex(F.md5(of("f", 3))),
        qidfa=of("q", 1),
        id_from_mapping=(user % 16).cast("int"),
    )


def _ad(place: Column) -> Column:
    k = F.col("k")
    goal = F.when(k % 4 == 1, 5).when(k % 4 == 2, 204).when(k % 4 == 3, 7)
    return _struct(
        adgroup_id=k.cast("bigint"),
        advertiser_id=k % 20,
        product_id=_prefixed("p", k),
        product_type=F.when(k % 3 == 0, 25).otherwise(1),
        quality_product_id=F.concat_ws("|", "event_type", (k % 10).cast("string")),
        vertical_ids=F.when(k % 5 == 0, F.array(F.lit(5).cast("bigint"))).otherwise(
            F.array(k.cast("bigint"), F.lit(CATEGORY_BASE) + k * 37, F.lit(CATEGORY_BASE) + 1)
        ),
        ad_type=k % 5,
        creative_id=k.cast("bigint") * 11,
        creative_size=k % 6,
        video_style_id=k % 4,
        video_duration=F.when(k % 2 == 0, k),
        goal=goal,
        second_goal=F.when(k % 2 == 1, 1),
        target_cpa=k * 10,
        gmv_bias=F.when(k % 3 != 0, 1 + (k % 8) / 8.0),
        rerank_pctr=k * 1000 + place,
        total_ecpm=k.cast("bigint") * 100,
        next_total_ecpm=F.when(k % 6 != 0, k.cast("bigint") * 50),
        adjusted_pcvr=(k / 128.0).cast("float"),
        smart_pcvr=(k / 256.0).cast("float"),
        scoring_ctr=k * 7,
        scoring_cvr=F.when(k % 9 != 0, k * 3),
    )


def _clicks() -> Column:
    cost = _cents(F.col("value")) * 1000
    goal = F.coalesce((F.when(F.col("k") % 4 == 1, 5).when(F.col("k") % 4 == 2, 204)), F.lit(7))

    def trace(action: Column, trade: int | None) -> Column:
        return _struct(action_type=action, trade_type=F.lit(trade).cast("int"))

    def click(bill: Column, *traces: Column) -> Column:
        none = F.array().cast("array<struct<action_type: int, trade_type: int>>")
        return _struct(bill_cpc_micros=bill, traces=F.array(*traces) if traces else none)

    unbilled = F.lit(None).cast("bigint")
    bought = F.array(
        click(cost, trace(goal, None), trace(F.lit(204), 3), trace(F.lit(204), 1)),
        click(unbilled, trace(F.lit(5), 0)),
    )
    return F.when(F.col("event_type") == "purchase", bought).when(
        F.col("event_type") == "click", F.array(click(cost))
    )


def _impression(position: int, place: int) -> Column:
    k = F.col("k")
    bill = _cents(F.col("value")) * 10_000 if place == 1 else F.lit(None).cast("bigint")
    return _struct(
        id=F.lit(f"t_{position}_{place}"),
        ping_time=F.col("time_s"),
        bill_cpm_micros=bill,
        ad=_ad(F.lit(place)),
        clicks=_clicks(),
        video=_struct(
            finish_type=((F.col("event_id") + place) % 3).cast("int"),
            play_end_time=F.when(k % 7 != 0, k * 50),
        ),
    )


def _impressions(position: int) -> Column:
    """One impression, or two at the first position for odd k; only the first is billed."""
    one = F.array(_impression(position, 1))
    if position != 1:
        return one
    return F.when(F.col("k") % 2 == 1, F.array(_impression(1, 1), _impression(1, 2))).otherwise(one)


def derive_page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page view per event, with two positions, on five sites; some have a blank id."""
    k = F.col("k")
    repeated = F.array(F.lit(7), F.lit(7))
    nothing = F.array().cast("array<int>")

    def trigger(key: int, value: Column) -> Column:
        return _struct(key=F.lit(key), value=value)

    first = _struct(
        id=(100 + k % 10).cast("bigint"),
        scene=(k % 4).cast("bigint"),
        exp_ids=F.array((F.col("user_id") % 4).cast("int"), 10 + k % 3),
        reward_time=F.when(k % 3 != 0, k % 3),
        article_id=F.col("event_id") % 100,
        triggers=F.array(trigger(8, k), trigger(9, k % 4), trigger(9, F.lit(99))),
        imps=_impressions(1),
    )
    second = _struct(
        id=(200 + k % 10).cast("bigint"),
        scene=F.lit(None).cast("bigint"),
        exp_ids=F.when(k % 2 == 0, repeated).otherwise(nothing),
        reward_time=F.lit(None).cast("int"),
        article_id=F.lit(None).cast("bigint"),
        triggers=F.array(trigger(8, k)),
        imps=_impressions(2),
    )
    return events(spark, sf_dir).select(
        F.when(F.col("event_id") % 17 == 0, "").otherwise(_prefixed("pv", F.col("event_id"))).alias("id"),
        F.col("time_s").cast("bigint").alias("process_time"),
        F.col("hour").alias("partition_datetime"),
        _struct(
            site_id=1 + F.col("user_id") % 5,
            site_set=F.when(k % 5 == 0, 24).otherwise(25),
            app_version=_prefixed("a", k % 3),
        ).alias("page"),
        _prefixed("l", F.col("user_id")).alias("login_openid"),
        id_locators().alias("id_locators"),
        _struct(
            os_version=_prefixed("os", k % 4), sdk_version=_prefixed("sdk", k % 3), brand_id=(k % 9).cast("bigint")
        ).alias("device"),
        _struct(age=F.when(k % 10 != 0, 18 + k % 50), gender=k % 3, education=k % 6).alias("user"),
        F.array(first, second).alias("positions"),
        F.col("event_type"),
    )


def derive_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the daily ad table per event. A fifth each arrives on the day before, the
    day, and one to three days later; some rows belong to the day before or after."""
    k, kind, event = F.col("k"), F.col("event_type"), F.col("event_id")
    arrived = F.date_add(F.lit("2023-12-31").cast("date"), (event % 5).cast("int"))
    return events(spark, sf_dir).select(
        F.date_format(arrived, "yyyyMMdd").alias("day"),
        F.when(event % 11 == 0, "20231231").when(event % 11 == 1, "20240102").otherwise(DAY).alias("process_date"),
        F.when(k % 5 == 0, 24).otherwise(25).alias("site_set"),
        F.when(k % 4 == 1, 5).when(k % 4 == 2, 204).when(k % 4 == 3, 7).alias("smart_optimization_goal"),
        F.lit("1").alias("valid_exposure_cnt"),
        kind.isin("click", "purchase").cast("int").cast("string").alias("valid_click_cnt"),
        (kind == "purchase").cast("int").cast("string").alias("active_num"),
        F.concat_ws("|", F.lit("product"), (k % 7).cast("string")).alias("quality_product_id"),
        _prefixed("p", k).alias("product_id"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicted impression per event, of seven products."""
    k = F.col("k")
    return events(spark, sf_dir).select(
        (1 + F.col("user_id") % 2).alias("site_id"),
        _prefixed("u", F.col("user_id")).alias("open_id"),
        F.concat_ws("|", F.lit("product"), (k % 7).cast("string")).alias("quality_product_id"),
        ((k + 1) / 128.0).cast("float").alias("pctr"),
        ((k + 1) / 1024.0).cast("float").alias("pcvr"),
        "time_us",
    )


def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the daily ad table per line item, cells as text, blank for 0."""

    def cell(value: Column) -> Column:
        return F.when(value == 0, "").otherwise(value.cast("string"))

    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "24").otherwise("25").alias("site_set"),
        cell(F.col("l_suppkey") % 7).alias("site_id"),
        cell(F.col("l_partkey")).alias("position_id"),
        cell(F.col("l_quantity").cast("bigint")).alias("req_cnt"),
        cell(F.col("l_linenumber")).alias("ret_cnt"),
        cell(_cents(F.col("l_extendedprice")) * 10_000).alias("real_cost_micros"),
        cell(F.col("l_suppkey") % 10).alias("scene"),
    )


def derive_score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position record per line item: two tracks score its ad, the second track
    another one as well; three ads are ranked, one of them unscored."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    discount = F.floor(F.col("l_discount") * 100).cast("int")

    def scored(aindex: Column, ctr: Column, cvr: Column) -> Column:
        return _struct(aindex=aindex, ctr=ctr, cvr=cvr)

    def ranked(aindex: Column, pctr: Column, pcvr: Column) -> Column:
        return _struct(
            aindex=aindex,
            adgroup_id=F.col("l_partkey"),
            product_id=_prefixed("s", F.col("l_suppkey")),
            is_in_reranking=F.col("l_returnflag") != "N",
            advertiser_id=quantity,
            pctr=pctr,
            adjusted_pcvr=pcvr,
        )

    tracks = F.array(
        _struct(ads=F.array(scored(line, quantity * 1000, F.lit(100_000)))),
        _struct(ads=F.array(
            scored(line, quantity * 2000, discount * 10_000),
            scored(line + 1, F.lit(1), F.lit(None).cast("int")),
            scored(line + 2, quantity * 5000, F.lit(300_000)),
        )),
    )
    ads = F.array(
        ranked(line, 10_000 + quantity * 100, F.lit(0.25)),
        ranked(line + 1, F.lit(20_000), F.lit(0.5)),
        ranked(line + 2, F.lit(30_000), F.when(discount != 3, discount / 16.0)),
    )
    experiments = F.array(line)
    position = _struct(
        exp_ids=experiments,
        retrieval_tracks=tracks,
        mixer_track=_struct(
            om_ad_type=F.when(F.col("l_linestatus") == "O", line % 3).otherwise(0),
            exp_ids=F.when(line != 7, experiments).otherwise(F.array().cast("array<int>")),
            ads=ads,
        ),
    )
    return table(spark, sf_dir, "lineitem").select(
        _struct(site_set=F.when(F.col("l_suppkey") % 5 == 0, 24).otherwise(25)).alias("page"),
        F.array(position).alias("positions"),
    )

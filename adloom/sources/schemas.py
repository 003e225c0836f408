"""Record layouts, and narrowing them to the fields a job reads.

Spark prunes nested columns through one `explode`, not through several, so jobs
that flatten deeper read with a narrowed schema.
"""

from collections.abc import Iterable

from pyspark.sql import types as T

PAGE_VIEW = """
id string, process_time bigint, partition_datetime string,
page struct<site_id: bigint, site_set: int, app_version: string>,
login_openid string,
id_locators struct<openid: string, encrypted_id: binary, media_specified_id: string,
  guid: binary, wuid: string, md5_imei: binary, md5_idfa: binary, qidfa: string,
  id_from_mapping: int>,
device struct<os_version: string, sdk_version: string, brand_id: bigint>,
user struct<age: int, gender: int, education: int>,
positions array<struct<
  id: bigint, scene: bigint, exp_ids: array<int>, reward_time: int, article_id: bigint,
  triggers: array<struct<key: int, value: int>>,
  imps: array<struct<
    id: string, ping_time: int, bill_cpm_micros: bigint,
    ad: struct<adgroup_id: bigint, advertiser_id: int, product_id: string, product_type: int,
      quality_product_id: string, vertical_ids: array<bigint>, ad_type: int,
      creative_id: bigint, creative_size: int, video_style_id: int, video_duration: int,
      goal: int, second_goal: int, target_cpa: int, gmv_bias: double,
      rerank_pctr: int, total_ecpm: bigint, next_total_ecpm: bigint,
      adjusted_pcvr: float, smart_pcvr: float, scoring_ctr: int, scoring_cvr: int>,
    clicks: array<struct<bill_cpc_micros: bigint,
      traces: array<struct<action_type: int, trade_type: int>>>>,
    video: struct<finish_type: int, play_end_time: int>>>>>
"""

SCORE_TRACKING = """
page struct<site_set: int>,
positions array<struct<exp_ids: array<int>,
  retrieval_tracks: array<struct<ads: array<struct<aindex: int, ctr: int, cvr: int>>>>,
  mixer_track: struct<om_ad_type: int, exp_ids: array<int>,
    ads: array<struct<aindex: int, adgroup_id: bigint, product_id: string,
      is_in_reranking: boolean, advertiser_id: int, pctr: int, adjusted_pcvr: double>>>>>
"""

IMPRESSION_EXTRACT = """
site_id bigint, open_id string, position_id bigint, scene bigint,
quality_product_id string, adgroup_id bigint, advertiser_id int, product_id string,
goal int, class_id int, second_class_id bigint, pctr float, pcvr float,
total_ecpm bigint, next_total_ecpm bigint, ctr int, cvr int, ping_time int
"""

METRICS = """
site_id bigint, position_id bigint, exp_id int, adgroup_id bigint, goal int, second_goal int, target_cpa int,
partition_time string, process_time string, conv bigint, cost double, gmv double, imps bigint, clicks bigint,
gmv_bias double
"""

CLICKS_AND_CONVERSIONS = "adgroup_id bigint, clk_cnt int, conv_cnt int"


def layout(ddl: str) -> T.StructType:
    """A record layout as a Spark type."""
    return T.StructType.fromDDL(ddl)


def narrow(schema: T.StructType, fields: Iterable[str]) -> T.StructType:
    """The part of a schema named by dotted field paths, through arrays as well."""
    paths: dict[str, list[str]] = {}
    for path in fields:
        name, _, rest = path.partition(".")
        paths.setdefault(name, []).append(rest)
    unknown = paths.keys() - set(schema.names)
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    kept = [f for f in schema.fields if f.name in paths]
    return T.StructType([T.StructField(f.name, _narrow_type(f.dataType, paths[f.name])) for f in kept])


def _narrow_type(data_type: T.DataType, rest: list[str]) -> T.DataType:
    if "" in rest:
        return data_type
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_narrow_type(data_type.elementType, rest))
    if isinstance(data_type, T.StructType):
        return narrow(data_type, rest)
    raise ValueError(f"{data_type.simpleString()} has no field {rest[0]}")

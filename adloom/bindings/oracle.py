"""The same answers in SQL over the flat tables, without nesting.

Impressions are listed straight from the events: a page has impression 1 at both
positions, and a second one at the first position for odd k.
"""

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    CAST(epoch_us(ts) // 1000000 AS INTEGER) AS time_s
  FROM events
)"""

IMPRESSIONS = EVENTS + """,
imp AS (
  SELECT ev.*, pos, place,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE 'pv' || event_id END AS id,
    't_' || pos || '_' || place AS trace_id,
    1 + user_id % 5 AS site_id,
    CAST(pos * 100 + k % 10 AS BIGINT) AS position_id,
    CAST(CASE k % 4 WHEN 1 THEN 5 WHEN 2 THEN 204 WHEN 3 THEN 7 ELSE 0 END AS INTEGER) AS goal,
    CASE WHEN place = 1 THEN CAST(floor(value * 100) AS BIGINT) * 10000 ELSE 0 END AS cpm_micros
  FROM ev JOIN (VALUES (1, 1), (1, 2), (2, 1)) AS p(pos, place) ON place = 1 OR k % 2 = 1
)"""

IN_EXPERIMENTS = IMPRESSIONS + """,
listed AS (
  SELECT imp.*, CAST(unnest(CASE WHEN pos = 1 THEN [user_id % 4, 10 + k % 3]
                                 WHEN k % 2 = 0 THEN [7, 7] ELSE [] END) AS INTEGER) AS exp_id
  FROM imp
),
keyed AS (
  SELECT site_id, position_id, exp_id, CAST(k AS BIGINT) AS adgroup_id, goal,
    CAST(k % 2 AS INTEGER) AS second_goal, k * 10 AS target_cpa,
    strftime(ts, '%Y%m%d') AS partition_time,
    strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS process_time,
    k, value, event_type, cpm_micros
  FROM listed WHERE exp_id IN (2, 7, 11, 12)
)"""

KEYS = "site_id, position_id, exp_id, adgroup_id, goal, second_goal, target_cpa, partition_time, process_time"

EXPOSED = f"""
SELECT {KEYS}, 0 AS conv, cpm_micros AS cost_micros, 0 AS gmv_cents, 1 AS imps, 0 AS clicks,
  CASE WHEN k % 3 <> 0 THEN 1 + (k % 8) / 8.0::DOUBLE ELSE 1.0::DOUBLE END AS gmv_bias
FROM keyed"""

CLICKED = f"""
SELECT {KEYS}, 0 AS conv,
  CASE WHEN nth = 1 THEN CAST(floor(value * 100) AS BIGINT) * 1000 ELSE 0 END AS cost_micros,
  0 AS gmv_cents, 0 AS imps, 1 AS clicks, 0.0::DOUBLE AS gmv_bias
FROM keyed JOIN (VALUES (1), (2)) AS c(nth)
  ON event_type = 'purchase' OR (event_type = 'click' AND nth = 1)"""

TRACED = f"""
SELECT {KEYS}, hit AS conv, 0 AS cost_micros, hit * target_cpa AS gmv_cents, 0 AS imps, 0 AS clicks,
  0.0::DOUBLE AS gmv_bias
FROM (
  SELECT *, CASE WHEN goal > 0 AND action = goal
                  AND NOT (k % 3 = 0 AND action = 204 AND trade NOT IN (1, 2)) THEN 1 ELSE 0 END AS hit
  FROM (
    SELECT keyed.*, trade,
      CASE WHEN own THEN CASE k % 4 WHEN 1 THEN 5 WHEN 2 THEN 204 ELSE 7 END ELSE listed_action END AS action
    FROM keyed CROSS JOIN (VALUES (true, 0, 0), (false, 204, 3), (false, 204, 1), (false, 5, 0))
      AS t(own, listed_action, trade)
    WHERE event_type = 'purchase'
  )
)"""


def summed(rows: str) -> str:
    return f"""WITH {IN_EXPERIMENTS}
SELECT {KEYS}, CAST(sum(conv) AS BIGINT) AS conv,
  CAST(sum(cost_micros) AS DOUBLE) / 1000000 AS cost, CAST(sum(gmv_cents) AS DOUBLE) / 100 AS gmv,
  CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks, sum(gmv_bias) AS gmv_bias
FROM ({rows}) GROUP BY {KEYS}"""


def histogram(rows: str, order_by: str) -> str:
    """Repeats found by looking at the ten rows before, as a list."""
    return f"""WITH {IMPRESSIONS},
seen AS ({rows}),
framed AS (
  SELECT site_id, user_id, product, list(product) OVER (
    PARTITION BY site_id, user_id ORDER BY {order_by} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before
  FROM seen
),
per_user AS (
  SELECT site_id, user_id, count(*) AS n,
    CAST(count(*) FILTER (WHERE list_contains(before, product)) AS BIGINT) AS p
  FROM framed GROUP BY site_id, user_id
)
SELECT site_id, n, p, count(*) AS users FROM per_user GROUP BY site_id, n, p"""


LOG_HISTOGRAM = histogram(
    "SELECT site_id, user_id, event_type || '|' || k % 10 AS product, time_s FROM imp"
    " WHERE user_id % 13 <> 0 AND site_id IN (1, 2)",
    "time_s, product",
)

DETAIL = """
SELECT id, trace_id, position_id, time_s AS ping_time,
  CASE WHEN user_id % 3 = 0 THEN lower(hex('e' || user_id))
       WHEN user_id % 13 <> 0 THEN 'u' || user_id ELSE '' END AS user_id,
  CASE WHEN user_id % 13 <> 0 THEN 'u' || user_id ELSE '' END AS open_id,
  'l' || user_id AS login_open_id,
  CASE WHEN user_id % 5 = 0 THEN 'm' || user_id ELSE '' END AS media_specified_id,
  CASE WHEN pos = 1 THEN event_id % 100 ELSE 0 END AS article_id,
  CASE WHEN pos = 1 THEN k % 3 ELSE 0 END AS reward_time,
  CAST(CASE WHEN pos = 1 AND user_id % 4 = 3 THEN 3 WHEN pos = 1 AND k % 3 = 2 THEN 12
            WHEN pos = 2 AND k % 2 = 0 THEN 7 ELSE 0 END AS INTEGER) AS exp_id,
  CASE WHEN pos = 1 THEN k % 4 ELSE -1 END AS placement_type,
  CAST(k AS BIGINT) AS adgroup_id, k % 5 AS ad_type, k % 4 AS video_style_id,
  CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS video_duration,
  CAST(k * 1000 + place AS INTEGER) AS pctr, k / 256.0::DOUBLE AS pcvr, CAST(k AS BIGINT) * 100 AS ecpm,
  CAST(k AS BIGINT) * 11 AS creative_id, k % 6 AS creative_size,
  CASE WHEN k % 5 = 0 THEN '5'
       ELSE k || ',' || (21474836480 + k * 37) || ',' || 21474836481 END AS vertical_ids,
  CASE WHEN k % 3 = 0 THEN 25 ELSE 1 END AS product_type,
  CAST(k % 9 AS BIGINT) AS brand_id, 'os' || k % 4 AS os_version,
  CASE WHEN k % 10 <> 0 THEN 18 + k % 50 ELSE 0 END AS age, k % 3 AS gender, k % 6 AS education,
  'sdk' || k % 3 AS sdk_version, 'a' || k % 3 AS app_version, site_id
FROM imp WHERE site_id IN (1, 2)"""

COST = """
SELECT id, trace_id, cpm_micros / 1000000::DOUBLE AS expose_cost,
  CASE WHEN goal = 0 THEN cpm_micros / 1000000::DOUBLE ELSE 0.0::DOUBLE END AS expose_gmv
FROM imp JOIN (VALUES (1), (2)) AS c(nth) ON nth = 1 OR event_type = 'purchase'
WHERE site_id IN (1, 2) AND event_type <> 'click'"""

COSTS = "coalesce(expose_cost, 0) AS expose_cost, coalesce(expose_gmv, 0) AS expose_gmv"

PLAY = """
SELECT id, trace_id, max(seconds) AS play_time,
  max(CASE WHEN (event_id + place) % 3 = 2 THEN seconds END) AS click_play_time
FROM (
  SELECT *, CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k * 50 > 1000 THEN k * 50 // 1000 ELSE k * 50 END AS INTEGER) AS seconds
  FROM imp WHERE event_type <> 'error' AND site_id IN (1, 2)
) GROUP BY id, trace_id"""

RATES = """
rates AS (
  SELECT 'product|' || k % 7 AS quality_product_id, count(*) AS exposure_cnt,
    CAST(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS BIGINT) AS click_cnt,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS active_cnt
  FROM ev WHERE k % 5 <> 0 AND k % 4 IN (1, 2) AND event_id % 5 IN (1, 2, 3) AND event_id % 11 NOT IN (0, 1) GROUP BY 1
)"""

OCCURRENCES = """
numbered AS (
  SELECT user_id, 'product|' || k % 7 AS quality_product_id, (k + 1) / 128.0::DOUBLE AS pctr,
    (k + 1) / 1024.0::DOUBLE AS pcvr,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place
  FROM ev
),
chunked AS (
  SELECT *, count(*) OVER (PARTITION BY user_id, (place - 1) // 10, quality_product_id) AS repeats,
    CAST(row_number() OVER (PARTITION BY user_id, (place - 1) // 10, quality_product_id ORDER BY place) - 1
      AS INTEGER) AS "order"
  FROM numbered
),
occurrence AS (SELECT * FROM chunked WHERE repeats >= 3)"""

REPEATED = f"""WITH {EVENTS}, {OCCURRENCES}
SELECT quality_product_id, "order", count(*) AS occurrences, sum(pctr) AS pctr_sum
FROM occurrence GROUP BY quality_product_id, "order" """

COUNT_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["exposure_cnt", "click_cnt", "active_cnt"])

BIAS_MACRO = f"""WITH {EVENTS}, {OCCURRENCES}, {RATES},
means AS (
  SELECT quality_product_id, "order", avg(pctr) AS pctr, avg(pcvr) AS pcvr
  FROM occurrence GROUP BY quality_product_id, "order"
)
SELECT "order",
  round(avg(abs(pctr / nullif(click_cnt / nullif(exposure_cnt, 0)::DOUBLE, 0) - 1)), 6) AS ctr_bias,
  round(avg(abs(pcvr / nullif(active_cnt / nullif(click_cnt, 0)::DOUBLE, 0) - 1)), 6) AS cvr_bias,
  {COUNT_SUMS}
FROM means JOIN rates USING (quality_product_id) GROUP BY "order" """

BIAS_POOLED = f"""WITH {EVENTS}, {OCCURRENCES}, {RATES},
pooled AS (
  SELECT "order", avg(pctr) AS pctr, avg(pcvr) AS pcvr, {COUNT_SUMS}
  FROM occurrence JOIN rates USING (quality_product_id) GROUP BY "order"
)
SELECT "order",
  round(pctr / nullif(click_cnt / nullif(exposure_cnt, 0)::DOUBLE, 0) - 1, 6) AS ctr_bias,
  round(pcvr / nullif(active_cnt / nullif(click_cnt, 0)::DOUBLE, 0) - 1, 6) AS cvr_bias,
  round(pctr, 6) AS pctr, round(pcvr, 6) AS pcvr, exposure_cnt, click_cnt, active_cnt
FROM pooled"""

EXTRACT = f"""WITH {IMPRESSIONS}
SELECT site_id, 'u' || user_id AS open_id, position_id,
  CASE WHEN pos = 1 THEN CAST(k % 4 AS BIGINT) ELSE 0 END AS scene,
  event_type || '|' || k % 10 AS quality_product_id,
  CAST(k AS BIGINT) AS adgroup_id, k % 20 AS advertiser_id, 'p' || k AS product_id, goal,
  CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k * 37 // 100 END AS INTEGER) AS class_id,
  CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k * 37 END AS BIGINT) AS second_class_id,
  CAST(CAST(k * 1000 + place AS FLOAT) / CAST(1000000 AS FLOAT) AS DOUBLE) AS pctr,
  k / 128.0::DOUBLE AS pcvr, CAST(k AS BIGINT) * 100 AS total_ecpm,
  CASE WHEN k % 6 <> 0 THEN CAST(k AS BIGINT) * 50 ELSE 0 END AS next_total_ecpm,
  k * 7 AS ctr, CASE WHEN k % 9 <> 0 THEN k * 3 ELSE 0 END AS cvr, time_s AS ping_time
FROM imp WHERE goal > 0 AND goal <> 7 AND user_id % 13 <> 0 AND site_id IN (1, 2)"""

CONSISTENCY = """
WITH rows AS (
  SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST(floor(l_discount * 100) AS INTEGER) AS d FROM lineitem
  WHERE l_suppkey % 5 <> 0 AND l_returnflag <> 'N' AND l_linenumber <> 7
    AND NOT (l_linestatus = 'O' AND l_linenumber % 3 = 1)
),
ads AS (
  SELECT l_partkey, l_suppkey, q, (10000 + q * 100) / 1000000::DOUBLE AS pctr, 0.25::DOUBLE AS pcvr,
    q * 2000 / 1000000::DOUBLE AS lite_ctr, d * 10000 / 1000000::DOUBLE AS lite_cvr FROM rows
  UNION ALL
  SELECT l_partkey, l_suppkey, q, 30000 / 1000000::DOUBLE, d / 16.0::DOUBLE,
    q * 5000 / 1000000::DOUBLE, 300000 / 1000000::DOUBLE FROM rows WHERE d <> 3
)
SELECT l_partkey AS adgroup_id, CAST(trunc(lite_ctr * lite_cvr * 100 / (pctr * pcvr)) AS INTEGER) AS ratio,
  's' || l_suppkey AS product_id, q AS advertiser_id
FROM ads
WHERE pctr > 0 AND pcvr > 0 AND lite_ctr > 0 AND lite_cvr > 0
  AND trunc(lite_ctr * lite_cvr * 100 / (pctr * pcvr)) > 0"""

LAST_WRITE = """
WITH latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS nth
    FROM lineitem
  ) WHERE nth = 1
)
SELECT o_orderkey, CAST(1 + o_custkey % 7 AS INTEGER) AS aindex,
  coalesce(CAST(l_quantity AS INTEGER), 0) AS ctr, coalesce(CAST(floor(l_extendedprice) AS BIGINT), 0) AS cvr
FROM orders LEFT JOIN latest ON l_orderkey = o_orderkey AND l_linenumber = 1 + o_custkey % 7"""

POSITION_VALUE = """
SELECT position_id, req_cnt, cost / 1000000 * 1000 / req_cnt AS cpr FROM (
  SELECT l_partkey AS position_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS req_cnt,
    sum(l_linenumber) AS ret_cnt, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT) * 10000) AS DOUBLE) AS cost
  FROM lineitem
  WHERE l_returnflag <> 'R' AND l_suppkey % 7 <> 6 AND l_suppkey % 10 <> 8 AND l_partkey > 0
  GROUP BY l_partkey
) WHERE req_cnt > 0 AND ret_cnt > 50"""

POSITION_QUANTILE = f"""
WITH valued AS ({POSITION_VALUE})
SELECT 20240101 AS day, position_id, req_cnt, cpr,
  CAST(ceil(sum(req_cnt) OVER (ORDER BY cpr, position_id ROWS UNBOUNDED PRECEDING)
    * 100.0::DOUBLE / sum(req_cnt) OVER ()) AS INTEGER) AS cpr_quantile,
  0 AS reserved
FROM valued"""

WORD_COUNT = """
SELECT word, count(*) AS count FROM (
  SELECT unnest(string_split(rtrim(text, ' '), ' ')) AS word FROM documents
  WHERE NOT (rtrim(text, ' ') = '' AND text <> '')
) GROUP BY word"""

GROUP_EXPR = """
SELECT label, piece, string_agg(member || 'x' || copies, ',' ORDER BY member) AS members FROM (
  SELECT CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label, l_partkey // 1000 AS piece,
    l_partkey AS member, count(*) AS copies
  FROM lineitem GROUP BY ALL
) GROUP BY label, piece"""

USER_ID_CHAIN = f"""WITH {EVENTS}
SELECT event_id,
  CASE WHEN user_id % 5 = 0 THEN 'm' || user_id
       WHEN user_id % 7 = 0 AND (user_id % 16) & 1 = 0 THEN lower(hex('g' || user_id))
       WHEN user_id % 4 = 0 AND (user_id % 16) & 2 = 0 THEN 'w' || user_id
       WHEN user_id % 13 <> 0 THEN 'u' || user_id
       WHEN user_id % 2 = 0 AND (user_id % 16) & 4 = 0 THEN md5('i' || user_id)
       WHEN user_id % 3 = 0 AND (user_id % 16) & 8 = 0 THEN md5('f' || user_id)
       WHEN (user_id % 16) & 2 = 0 THEN 'Q' || user_id
       ELSE '' END AS fallback_id,
  CASE WHEN user_id % 3 = 0 THEN lower(hex('e' || user_id))
       WHEN user_id % 13 <> 0 THEN 'u' || user_id ELSE '' END AS preferred_id
FROM ev"""

DATE_STRINGS = """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY, '%Y%m%d') AS three_days_on,
  strftime(o_orderdate, '%Y%m%d') || ',' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') || ','
    || strftime(o_orderdate + INTERVAL 2 DAY, '%Y%m%d') AS days_read,
  strftime(o_orderdate, '%Y%m%d') AS day,
  strftime(date_trunc('day', o_orderdate) + INTERVAL 25 HOUR, '%Y%m%d') AS log_day
FROM orders"""

DROP_INCOMPLETE = f"""WITH {EVENTS}
SELECT event_id AS label, CASE WHEN k % 5 = 1 THEN '' ELSE event_type END AS sentence, value AS double_value
FROM ev WHERE k % 5 <> 0 AND k % 7 NOT IN (0, 1)"""


CHAIN = f"""WITH {IMPRESSIONS},
extract AS (
  SELECT user_id, site_id, 'p' || k AS product_id, time_s,
    CAST(CAST(CAST(CAST(k * 1000 + place AS FLOAT) / CAST(1000000 AS FLOAT) AS FLOAT) AS DOUBLE) AS DECIMAL(18, 12)) AS pctr,
    CAST(k / 128.0::DOUBLE AS DECIMAL(18, 12)) AS pcvr
  FROM imp WHERE goal > 0 AND goal <> 7 AND user_id % 13 <> 0 AND site_id IN (1, 2)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, user_id ORDER BY time_s, product_id, pctr, pcvr) AS place FROM extract
),
chunked AS (
  SELECT *, count(*) OVER (PARTITION BY site_id, user_id, (place - 1) // 50, product_id) AS repeats,
    CAST(row_number() OVER (PARTITION BY site_id, user_id, (place - 1) // 50, product_id ORDER BY place) - 1
      AS INTEGER) AS "order"
  FROM numbered
),
sums AS (
  SELECT product_id, "order", sum(pctr) AS pctr_sum, sum(pcvr) AS pcvr_sum, count(*) AS occurrences
  FROM chunked WHERE repeats >= 2 GROUP BY product_id, "order"
),
rates AS (
  SELECT 'p' || k AS product_id, count(*) AS exposure_cnt,
    CAST(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS BIGINT) AS click_cnt,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS active_cnt
  FROM ev WHERE k % 5 <> 0 AND k % 4 IN (1, 2) AND event_id % 5 IN (1, 2, 3) AND event_id % 11 NOT IN (0, 1) GROUP BY 1
)"""


def deviation(predicted: str, hits: str, tries: str) -> str:
    return f"({predicted} / nullif({hits} / nullif({tries}, 0)::DOUBLE, 0) - 1)"


def billionths(bias: str) -> str:
    """A mean of whole billionths, as a sum of whole numbers."""
    return f"CAST(sum(CAST(round(abs({bias}) * 1e9) AS HUGEINT)) AS DOUBLE) / 1e9 / nullif(count({bias}), 0)"


CHAIN_MACRO = f"""{CHAIN},
means AS (
  SELECT *, CAST(pctr_sum AS DOUBLE) / occurrences AS pctr, CAST(pcvr_sum AS DOUBLE) / occurrences AS pcvr
  FROM sums JOIN rates USING (product_id)
)
SELECT "order", {billionths(deviation("pctr", "click_cnt", "exposure_cnt"))} AS ctr_bias,
  {billionths(deviation("pcvr", "active_cnt", "click_cnt"))} AS cvr_bias, {COUNT_SUMS}
FROM means GROUP BY "order" """

TIMED_SUMS = ", ".join(
    f"CAST(sum({c} * occurrences) AS BIGINT) AS {c}" for c in ["exposure_cnt", "click_cnt", "active_cnt"]
)

CHAIN_POOLED = f"""{CHAIN},
pooled AS (
  SELECT "order", CAST(sum(pctr_sum) AS DOUBLE) / CAST(sum(occurrences) AS BIGINT) AS pctr,
    CAST(sum(pcvr_sum) AS DOUBLE) / CAST(sum(occurrences) AS BIGINT) AS pcvr, {TIMED_SUMS}
  FROM sums JOIN rates USING (product_id) GROUP BY "order"
)
SELECT "order", {deviation("pctr", "click_cnt", "exposure_cnt")} AS ctr_bias,
  {deviation("pcvr", "active_cnt", "click_cnt")} AS cvr_bias, pctr, pcvr, exposure_cnt, click_cnt, active_cnt
FROM pooled"""

LARGE_USERS = f"""{CHAIN}
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE n > 50) AS BIGINT) AS users
FROM (SELECT count(*) AS n FROM extract GROUP BY site_id, user_id)"""


def join(how: str) -> str:
    return f"""
SELECT coalesce(l.key, r.key) AS key, a, b
FROM (SELECT l_orderkey + l_linenumber AS key, l_partkey AS a FROM lineitem) l
{how} JOIN (SELECT o_orderkey AS key, o_orderpriority AS b FROM orders) r ON l.key = r.key"""


def oracle_sql() -> dict[str, str]:
    return {
        "repeat_histogram": histogram(
            "SELECT user_id % 2 AS site_id, user_id, event_type || '|' || k AS product, ts, event_id FROM ev",
            "ts, event_id",
        ),
        "repeat_histogram_log": LOG_HISTOGRAM,
        "repeat_histogram_split": LOG_HISTOGRAM,
        "exposure_metrics": summed(EXPOSED),
        "click_metrics": summed(CLICKED),
        "conversion_metrics": summed(TRACED),
        "merged_metrics": summed(f"{EXPOSED} UNION ALL {CLICKED} UNION ALL {TRACED}"),
        "exposure_detail": f"WITH {IMPRESSIONS} {DETAIL}",
        "impression_cost": f"WITH {IMPRESSIONS} {COST}",
        "video_play": f"WITH {IMPRESSIONS} {PLAY}",
        "exposure_enriched": f"""WITH {IMPRESSIONS}, detail AS ({DETAIL}), cost AS ({COST}), play AS ({PLAY})
SELECT detail.*, {COSTS}, coalesce(play_time, 0) AS play_time,
  coalesce(click_play_time, 0) AS click_play_time
FROM detail LEFT JOIN (SELECT * FROM cost WHERE id <> '') AS cost USING (id, trace_id)
  LEFT JOIN (SELECT * FROM play WHERE id <> '') AS play USING (id, trace_id)""",
        "exposure_without_video": f"""WITH {IMPRESSIONS}, detail AS ({DETAIL}), cost AS ({COST})
SELECT detail.*, {COSTS}, 0 AS play_time, 0 AS click_play_time
FROM detail LEFT JOIN (SELECT * FROM cost WHERE id <> '') AS cost USING (id, trace_id)""",
        "impression_extract": EXTRACT,
        "actual_rates": f"WITH {EVENTS}, {RATES} SELECT * FROM rates",
        "repeated_predictions": REPEATED,
        "repeated_predictions_split": REPEATED,
        "bias_macro": BIAS_MACRO,
        "bias_pooled": BIAS_POOLED,
        "extract_bias": CHAIN_MACRO,
        "extract_bias_split": CHAIN_MACRO,
        "extract_bias_pooled": CHAIN_POOLED,
        "large_users": LARGE_USERS,
        "metrics_text": summed(f"{EXPOSED} UNION ALL {CLICKED} UNION ALL {TRACED}"),
        "ordered_report": f"""WITH ranked AS ({POSITION_QUANTILE})
SELECT position_id, cpr, cpr_quantile, row_number() OVER (ORDER BY cpr, position_id) AS place FROM ranked""",
        "log_day": f"""WITH {EVENTS}
SELECT '202401010' || k % 6 AS date, count(*) AS plays, CAST(sum(k) AS BIGINT) AS play_time
FROM ev WHERE k % 6 <> 3 GROUP BY 1""",
        "log_hour": f"WITH {EVENTS} SELECT event_id AS id, k AS play_time, '2024010102' AS date FROM ev WHERE k % 6 = 2",
        "log_optional": f"""WITH {EVENTS}
SELECT event_id AS id, k % 6 AS hour, CASE WHEN k % 6 = 3 THEN 0 ELSE k END AS play_time FROM ev""",
        "score_consistency": CONSISTENCY,
        "last_write_lookup": LAST_WRITE,
        "clicks_and_conversions": f"""WITH {EVENTS}
SELECT event_id AS adgroup_id, k AS clk_cnt, CAST(user_id % 5 AS INTEGER) AS conv_cnt FROM ev""",
        "position_value": POSITION_VALUE,
        "position_quantile": POSITION_QUANTILE,
        "word_count": WORD_COUNT,
        "joins_inner": join("INNER"),
        "joins_left": join("LEFT"),
        "joins_right": join("RIGHT"),
        "joins_full": join("FULL"),
        "joins_inner_salted": join("INNER"),
        "joins_left_salted": join("LEFT"),
        "joins_full_salted": join("FULL"),
        "drop_incomplete": DROP_INCOMPLETE,
        "group_expr": GROUP_EXPR,
        "square": "SELECT p_partkey, p_size, CAST(p_size AS BIGINT) * p_size AS square FROM part",
        "user_id_chain": USER_ID_CHAIN,
        "date_strings": DATE_STRINGS,
        "text_cells": """SELECT l_partkey AS position_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS req_cnt
FROM lineitem GROUP BY l_partkey""",
    }

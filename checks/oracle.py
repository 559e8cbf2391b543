"""DuckDB SQL for the registered queries, written over the raw tables.

The SQL takes the direct way (row-level windows, plain joins), so that it checks
the Spark plans instead of repeating them.
"""

from __future__ import annotations


def iso(ts: str) -> str:
    """ISO text of a timestamp, with a fraction only where there is one."""
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN epoch_us({ts}) % 1000000 <> 0 THEN strftime({ts}, '.%f') ELSE '' END)"
    )


def day(date: str) -> str:
    return f"strftime({date}, '%Y-%m-%d')"


def dbl(number: str) -> str:
    return f"CAST({number} AS DOUBLE)"


BLANKS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANKS}', ' ', 'g'))"


# --- advertising -------------------------------------------------------------------------------

AD = f"""
WITH advertisers AS (SELECT n_nationkey AS advertiser_id, n_name AS name FROM nation),
campaigns AS (
  SELECT CAST(s_suppkey AS INTEGER) AS campaign_id, s_nationkey AS advertiser_id, s_name AS name,
         CASE WHEN s_suppkey % 11 <> 0 THEN 'cat_' || (s_suppkey % 7) END AS targeting_criteria,
         CAST(CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 10000 END AS DECIMAL(15,2)) AS budget,
         CAST(s_acctbal AS DECIMAL(15,2)) AS remaining_budget
  FROM supplier),
users AS (
  SELECT CAST(c_custkey AS INTEGER) AS user_id, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         'NATION_' || c_nationkey AS location,
         CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment || ' , ,' || lower(c_mktsegment) END AS interests,
         DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup_date
  FROM customer),
facts AS (
  SELECT lower(lpad(to_hex(event_id), 32, '0')) AS impression_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS campaign_id,
         CAST(user_id AS INTEGER) AS user_id,
         CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
         'NATION_' || (user_id % 25) AS location, ts, CAST(value AS DECIMAL(10,4)) AS cost_paid,
         CAST(CAST(value AS DECIMAL(10,4)) + 0.25 AS DECIMAL(10,4)) AS bid_amount, event_id, event_type
  FROM events),
impressions AS (
  SELECT * FROM facts WHERE campaign_id IN (SELECT campaign_id FROM campaigns)
                        AND user_id IN (SELECT user_id FROM users)),
clicks AS (
  SELECT impression_id AS click_id, impression_id,
         CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 5 SECOND END AS click_timestamp,
         CAST(cost_paid * 2 AS DECIMAL(10,4)) AS revenue
  FROM impressions WHERE event_type = 'click'),
shown AS (
  SELECT i.*, c.click_id, c.revenue,
         CASE WHEN c.click_timestamp IS NOT NULL THEN c.revenue END AS timed_revenue, c.click_timestamp,
         p.name AS campaign_name, coalesce(a.name, 'Unknown') AS advertiser_name,
         CASE WHEN p.campaign_id IS NULL THEN 'General' ELSE p.targeting_criteria END AS category
  FROM impressions i LEFT JOIN clicks c USING (impression_id)
  LEFT JOIN campaigns p ON i.campaign_id = p.campaign_id
  LEFT JOIN advertisers a ON p.advertiser_id = a.advertiser_id)
"""


def sessions(timeout: int) -> str:
    """Row-level sessions: a gap longer than the timeout to the row before opens one."""
    return AD + f""", gaps AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER line > {timeout * 1_000_000} THEN 1 ELSE 0 END AS opens
  FROM shown WINDOW line AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, impression_id)),
numbered AS (
  SELECT *, CAST(1 + sum(opens) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, impression_id) AS BIGINT)
            AS session_seq FROM gaps),
visits AS (
  SELECT *, min(ts) OVER (PARTITION BY user_id, session_seq) AS session_start,
         max(session_seq) OVER (PARTITION BY user_id) AS n_sessions FROM numbered)
"""


VISIT = f"""user_id, session_seq, {iso('session_start')} AS session_start, impression_id, {iso('ts')} AS "timestamp",
device, {dbl('bid_amount')} AS bid_amount, campaign_id, campaign_name, advertiser_name, category,
{iso('click_timestamp')} AS click_timestamp, {dbl('timed_revenue')} AS revenue_generated"""

SUMMARY = f"""SELECT user_id, session_seq, {iso('session_start')} AS session_start,
count(*) AS n_impressions, count(click_timestamp) AS n_clicks FROM visits GROUP BY user_id, session_seq, session_start"""

MONTH = "ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59'"
SIX_HOURS = 21600

LOADED = """
WITH users_raw AS (
  SELECT CAST(c_custkey AS INTEGER) AS user_id, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         'NATION_' || c_nationkey AS location,
         CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment || ' , ,' || lower(c_mktsegment) END AS interests,
         strftime(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS signup_date
  FROM customer),
advertisers AS (
  SELECT CAST(row_number() OVER (ORDER BY md5(name), name) AS INTEGER) AS advertiser_id, name
  FROM (SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
campaigns AS (
  SELECT CAST(s_suppkey AS INTEGER) AS campaign_id, a.advertiser_id, s_name AS name, '2024-01-01' AS start_date,
         '2024-12-31' AS end_date, 'cat_' || (s_suppkey % 7) AS targeting_criteria,
         'slot_' || (s_suppkey % 3) AS ad_slot_size, CAST(10000 AS DOUBLE) AS budget,
         s_acctbal AS remaining_budget
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN advertisers a ON a.name = n_name),
events_raw AS (
  SELECT lower(lpad(to_hex(l_orderkey * 8 + l_linenumber), 32, '0')) AS impression_id,
         'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS campaign_name,
         CAST(o_custkey AS INTEGER) AS user_id,
         CASE l_linenumber % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
         o_orderpriority AS location, l_shipdate AS ts,
         CAST(CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS DECIMAL(10,4)) AS bid_amount,
         CAST(CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS DECIMAL(10,4)) AS cost_paid,
         l_returnflag = 'R' AS was_clicked, CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS click_timestamp,
         CAST(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS DECIMAL(10,4)) AS revenue_generated
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (
  SELECT e.*, c.campaign_id FROM events_raw e JOIN campaigns c ON e.campaign_name = c.name
  WHERE e.user_id IN (SELECT user_id FROM users_raw)),
impressions AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY campaign_id, user_id, device,
    location, ts, bid_amount, cost_paid) = 1),
clicks AS (
  SELECT * FROM events_raw WHERE was_clicked AND impression_id IN (SELECT impression_id FROM impressions)
  QUALIFY row_number() OVER (PARTITION BY impression_id
    ORDER BY click_timestamp NULLS FIRST, revenue_generated NULLS FIRST) = 1)
"""

# --- reviews -----------------------------------------------------------------------------------

REVIEWS = """
WITH raw AS (
  SELECT o_orderpriority AS marketplace,
         CASE WHEN l_orderkey % 109 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
         l_orderkey || '-' || l_linenumber AS review_id,
         CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
         CAST(l_suppkey AS VARCHAR) AS product_parent, 'Product ' || l_partkey AS product_title,
         'Category ' || (l_partkey % 9) AS product_category,
         CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN 'x'
              ELSE CAST(CAST(l_quantity AS INTEGER) % 7 AS VARCHAR) END AS star_rating,
         CAST(l_linenumber AS VARCHAR) AS helpful_votes, CAST(l_linenumber + 1 AS VARCHAR) AS total_votes,
         CASE WHEN l_linenumber = 1 THEN '' ELSE 'N' END AS vine,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Y'
              WHEN l_returnflag = 'R' THEN '1' ELSE 'N' END AS verified_purchase,
         l_returnflag || ' ' || l_linestatus AS review_headline,
         'Ordered ' || CAST(l_quantity AS INTEGER) || ' pieces' AS review_body,
         CASE WHEN l_orderkey % 107 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS review_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
basic AS (
  SELECT * REPLACE (TRY_CAST(star_rating AS INTEGER) AS star_rating, TRY_CAST(review_date AS DATE) AS review_date)
  FROM raw WHERE trim(review_id) <> '' AND trim(product_id) <> '' AND trim(star_rating) <> ''
    AND trim(review_date) <> '' AND verified_purchase IN ('1', 'Y', 'y', 'true', 'True')),
typed AS (
  SELECT * REPLACE (TRY_CAST(star_rating AS INTEGER) AS star_rating, TRY_CAST(review_date AS DATE) AS review_date,
                    verified_purchase IN ('1', 'Y', 'y', 'true', 'True') AS verified_purchase)
  FROM raw WHERE trim(review_id) <> '' AND trim(product_id) <> '' AND trim(customer_id) <> ''
    AND trim(star_rating) <> '' AND trim(review_date) <> ''),
strict AS (
  SELECT *, strftime(review_date, '%Y-%m') AS year_month FROM typed
  WHERE star_rating BETWEEN 1 AND 5 AND review_date IS NOT NULL),
product_months AS (SELECT year_month, product_id AS id, CAST(count(*) AS INTEGER) AS n FROM strict GROUP BY ALL),
verified_months AS (
  SELECT year_month, customer_id AS id, CAST(count(*) AS INTEGER) AS n FROM strict WHERE verified_purchase GROUP BY ALL),
hater_months AS (
  SELECT year_month, customer_id AS id, CAST(count(*) AS INTEGER) AS n FROM strict WHERE star_rating IN (1, 2) GROUP BY ALL),
backer_months AS (
  SELECT year_month, customer_id AS id, CAST(count(*) AS INTEGER) AS n FROM strict WHERE star_rating IN (4, 5) GROUP BY ALL)
"""

REVIEW_COLUMNS = [
    "review_date", "review_id", "product_id", "customer_id", "star_rating", "verified_purchase",
    "review_headline", "review_body", "marketplace", "product_title",
]
SHOWN_REVIEW = ", ".join(f"{day(c)} AS review_date" if c == "review_date" else c for c in REVIEW_COLUMNS)
# the average rounded half up to two digits, in whole numbers
SUMMARY_COLUMNS = """product_id, count(review_id) AS total_reviews,
CAST((200 * sum(star_rating) + count(star_rating)) // (2 * count(star_rating)) AS DOUBLE) / 100 AS avg_star_rating"""


def collapsed(key: list[str]) -> str:
    """The last row of each key by the remaining columns."""
    rest = [c for c in REVIEW_COLUMNS if c not in key]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in rest)
    return (
        REVIEWS + f", kept AS (SELECT * FROM strict QUALIFY row_number() OVER "
        f"(PARTITION BY {', '.join(key)} ORDER BY {order}) = 1)\n"
    )


PRODUCT_KEY = ["product_id", "review_date", "review_id"]
RATING_KEY = ["product_id", "star_rating", "review_date", "review_id"]
CUSTOMER_KEY = ["customer_id", "review_date", "review_id"]


def month_table(name: str, id_name: str) -> str:
    return REVIEWS + f"SELECT year_month, id AS {id_name}, n AS review_count FROM {name}"


def top(name: str) -> str:
    return REVIEWS + (
        f"SELECT id, CAST(sum(n) AS BIGINT) AS review_count FROM {name} "
        f"WHERE year_month BETWEEN '1996-03' AND '1999-10' "
        f"GROUP BY id ORDER BY review_count DESC, min(year_month), id LIMIT 10"
    )


RAW_COLUMNS = [
    "marketplace", "customer_id", "review_id", "product_id", "product_parent", "product_title",
    "product_category", "star_rating", "helpful_votes", "total_votes", "vine", "verified_purchase",
    "review_headline", "review_body", "review_date",
]
MONTHLY = """SELECT product_id, CAST(year(review_date) AS INTEGER) AS year, CAST(month(review_date) AS INTEGER) AS month,
count(review_id) AS review_count FROM basic GROUP BY ALL"""

# --- events ------------------------------------------------------------------------------------

BODY = squeeze("coalesce(nullif(body, ''), nullif(headline, ''), '')")
TWEETS = f"""
WITH source_rows AS (
  SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE source END AS customer,
         text AS body,
         CASE WHEN doc_id % 58 = 0 THEN NULL ELSE lang || chr(9) || ' headline' END AS headline
  FROM documents),
squeezed AS (SELECT *, {BODY} AS body_text FROM source_rows),
tweets AS (
  SELECT CAST(doc_id AS VARCHAR) AS tweet_id, coalesce(nullif(customer, ''), 'unknown') AS user_id,
         CASE WHEN length(body_text) > 280 THEN left(body_text, 277) || '...' ELSE body_text END AS text,
         '2024-06-01T12:00:00+00:00' AS created_at, '2024-06-01T12:00:00+00:00' AS review_date,
         strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER), '%Y-%m-%d') AS original_review_date,
         'P' || (doc_id % 50) AS product_id, CAST(doc_id % 5 + 1 AS VARCHAR) AS star_rating,
         'amazon_reviews' AS source
  FROM squeezed)
"""

MESSAGES = f"""
WITH turns AS (
  SELECT *, conv_id % 7 AS kind,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id + turn AS INTEGER)) + to_seconds(turn) AS moment
  FROM conversations),
said AS (
  SELECT CASE kind WHEN 1 THEN CAST(conv_id AS VARCHAR) WHEN 3 THEN '' ELSE role END AS author_id,
         CASE kind WHEN 3 THEN date_trunc('day', moment) WHEN 4 THEN TIMESTAMP '2024-06-01 12:00:00' ELSE moment END
           AS created, {squeeze('text')} AS text
  FROM turns)
"""

PAGES = """
WITH timed AS (
  SELECT page_id, url, coalesce(e.user_id, page_id) AS user_id,
         coalesce(e.ts, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 86400)) AS ts
  FROM pages LEFT JOIN events e ON page_id = event_id),
kept AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         CASE page_id % 5 WHEN 0 THEN 'en.wikipedia.org' WHEN 1 THEN 'www.wikidata.org'
           ELSE 'commons.wikimedia.org' END AS domain,
         CASE WHEN page_id % 6 <> 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS moment,
         CASE WHEN page_id % 6 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS created_at,
         url AS page_title
  FROM timed
  WHERE page_id % 5 < 3 AND page_id % 4 < 2 AND page_id % 19 <> 0)
"""

PAGE_TABLE = PAGES + f"SELECT DISTINCT domain, {iso('moment')} AS created_at, page_title, user_id FROM kept"


def hourly(where: str, keys: str, hours: int) -> str:
    return AD + f"""SELECT {keys} campaign_name AS campaign, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS hour,
count(click_timestamp) AS total_clicks, {dbl('coalesce(sum(timed_revenue), 0)')} AS total_revenue
FROM shown WHERE {where} ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR
AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY ALL"""


def hourly_clicks(where: str, keys: str) -> str:
    return AD + f"""SELECT {keys} campaign_id, campaign_name, CAST(hour(click_timestamp) AS INTEGER) AS hour,
strftime(click_timestamp, '%Y-%m-%d') AS date, count(*) AS total_clicks,
{dbl('coalesce(sum(timed_revenue), 0)')} AS total_revenue
FROM shown WHERE {where} click_timestamp IS NOT NULL GROUP BY ALL"""


def fatigue(tail: str) -> str:
    return AD + f"""SELECT user_id, campaign_id, any_value(campaign_name) AS campaign_name,
count(*) AS impressions_count, count(click_timestamp) AS clicks_count FROM shown GROUP BY user_id, campaign_id
HAVING count(*) >= 2 AND count(click_timestamp) = 0 {tail}"""


ENGAGEMENT = f"""SELECT user_id, session_seq, impression_id, campaign_id, campaign_name, advertiser_name,
{iso('ts')} AS "timestamp", category,
CASE WHEN click_timestamp IS NOT NULL THEN 'click' ELSE 'impression' END AS engagement_type FROM visits"""

PERFORMANCE = f"""count(impression_id) AS impressions, count(click_id) AS clicks,
coalesce(count(click_id) / nullif(count(impression_id), 0), 0) AS ctr,
{dbl('coalesce(sum(cost_paid), 0)')} AS ad_spend FROM shown"""

USER = "user_id = 8"

ORACLE: dict[str, str] = {
    "campaign_ctr_top": AD + f"""SELECT campaign_name, ctr_percentage FROM (
        SELECT campaign_id, campaign_name, count(click_id) / count(impression_id) * 100 AS ctr_percentage
        FROM shown WHERE {MONTH} GROUP BY campaign_id, campaign_name)
        ORDER BY ctr_percentage DESC, campaign_id LIMIT 5""",
    "advertiser_spending": AD + f"""SELECT advertiser_name, {dbl('sum(cost_paid)')} AS total_spent
        FROM shown WHERE {MONTH} GROUP BY advertiser_name""",
    "cost_efficiency": AD + f"""SELECT campaign_name, {dbl('sum(cost_paid)')} / nullif(count(click_id), 0) AS avg_cpc,
        {dbl('sum(cost_paid)')} / count(impression_id) * 1000 AS avg_cpm
        FROM shown GROUP BY campaign_id, campaign_name""",
    "regional_revenue": AD + f"""SELECT location, {dbl('sum(revenue)')} AS total_revenue FROM shown
        WHERE click_id IS NOT NULL GROUP BY location ORDER BY sum(revenue) DESC, location LIMIT 10""",
    "top_users_by_clicks": AD + """SELECT user_id, count(click_id) AS total_clicks FROM shown
        WHERE click_id IS NOT NULL GROUP BY user_id ORDER BY total_clicks DESC, user_id LIMIT 10""",
    "budget_warnings": AD + f"""SELECT name AS campaign_name, {dbl('budget')} AS budget,
        {dbl('remaining_budget')} AS remaining_budget,
        {dbl('budget - remaining_budget')} / {dbl('budget')} * 100 AS budget_spent_percentage
        FROM campaigns WHERE budget <> 0 AND {dbl('budget - remaining_budget')} / {dbl('budget')} > 0.8""",
    "device_ctr": AD + """SELECT device, count(click_id) / count(impression_id) * 100 AS ctr_percentage
        FROM shown GROUP BY device""",
    "campaign_performance": AD + f"SELECT 3 AS campaign_id, {PERFORMANCE} WHERE campaign_id = 3",
    "campaign_performance_unknown": AD + f"SELECT -1 AS campaign_id, {PERFORMANCE} WHERE campaign_id = -1",
    "campaign_performance_each": AD + f"SELECT campaign_id, {PERFORMANCE} GROUP BY campaign_id",
    "advertiser_total_spend": AD + f"""SELECT 3 AS advertiser_id, {dbl('coalesce(sum(cost_paid), 0)')}
        AS total_ad_spend FROM impressions WHERE campaign_id IN
        (SELECT campaign_id FROM campaigns WHERE advertiser_id = 3)""",
    "advertiser_total_spend_each": AD + f"""SELECT advertiser_id, {dbl('sum(cost_paid)')} AS total_ad_spend
        FROM impressions JOIN campaigns USING (campaign_id) GROUP BY advertiser_id""",
    "load_star_schema_users": LOADED + "SELECT * FROM users_raw",
    "load_star_schema_advertisers": LOADED + "SELECT * FROM advertisers",
    "load_star_schema_campaigns": LOADED + "SELECT * FROM campaigns",
    "load_star_schema_impressions": LOADED + f"""SELECT impression_id, campaign_id, user_id, device, location,
        {iso('ts')} AS "timestamp", {dbl('bid_amount')} AS bid_amount, {dbl('cost_paid')} AS cost_paid
        FROM impressions""",
    "load_star_schema_clicks": LOADED + f"""SELECT impression_id AS click_id, impression_id,
        {iso('click_timestamp')} AS click_timestamp, {dbl('revenue_generated')} AS revenue_generated FROM clicks""",
    "load_star_second": LOADED + f"""SELECT impression_id, campaign_id, user_id,
        CASE WHEN ('0x' || right(impression_id, 4))::INTEGER % 2 = 0 THEN device ELSE upper(device) END AS device, location,
        {iso('ts')} AS "timestamp", {dbl('bid_amount')} AS bid_amount, {dbl('cost_paid')} AS cost_paid
        FROM impressions""",
    "load_star_second_clicks": LOADED + f"""SELECT impression_id AS click_id, impression_id,
        {iso('click_timestamp')} AS click_timestamp, {dbl('revenue_generated')} AS revenue_generated FROM clicks""",
    **dict.fromkeys(["load_star_after_crash", "load_star_late_clicks", "load_star_late_clicks_compacted"], LOADED + f"""
        SELECT source, campaign_id, impressions, clicks, clicks / impressions AS ctr, ad_spend FROM (
            SELECT i.campaign_id, count(*) AS impressions, count(c.impression_id) AS clicks, {dbl('sum(i.cost_paid)')} AS ad_spend
            FROM impressions i LEFT JOIN clicks c ON i.impression_id = c.impression_id GROUP BY i.campaign_id),
        (VALUES ('tables'), ('shown'), ('by_user'), ('totals')) t(source)"""),
    "late_clicks_by_device": LOADED + """SELECT i.device, count(c.impression_id) / count(*) * 100 AS ctr_percentage
        FROM impressions i LEFT JOIN clicks c ON i.impression_id = c.impression_id GROUP BY i.device""",
    "user_sessions": sessions(1800) + SUMMARY,
    "user_sessions_6h": sessions(SIX_HOURS) + SUMMARY,
    "user_documents_flat": sessions(SIX_HOURS) + f"SELECT CAST(0 AS BIGINT) AS part, {VISIT} FROM visits",
    "user_documents_heads": sessions(SIX_HOURS) + f"""SELECT u.user_id, u.age, u.gender, u.location,
        CASE WHEN u.interests IS NULL THEN '' ELSE replace(u.interests, ' , ,', '|') END AS interests,
        {iso('CAST(u.signup_date AS TIMESTAMP)')} AS signup_date, coalesce(max(v.session_seq), 0) AS n_sessions
        FROM users u LEFT JOIN visits v ON u.user_id = v.user_id
        GROUP BY u.user_id, u.age, u.gender, u.location, u.interests, u.signup_date""",
    "user_history_flat": sessions(1800) + f"SELECT CAST(0 AS BIGINT) AS part, {VISIT} FROM visits WHERE {USER}",
    "last_sessions": sessions(1800) + f"SELECT {VISIT} FROM visits WHERE {USER} AND session_seq > n_sessions - 5",
    "last_sessions_each": sessions(SIX_HOURS) + f"SELECT {VISIT} FROM visits WHERE session_seq > n_sessions - 5",
    "last_sessions_of_documents":
        sessions(SIX_HOURS) + f"SELECT CAST(0 AS BIGINT) AS part, {VISIT} FROM visits WHERE session_seq > n_sessions - 5",
    "user_documents_split": sessions(SIX_HOURS) + f"SELECT {VISIT} FROM visits",
    "last_sessions_of_split_documents":
        sessions(SIX_HOURS) + f"SELECT {VISIT} FROM visits WHERE session_seq > n_sessions - 5",
    "engaged_split_documents": AD + "SELECT DISTINCT user_id FROM shown WHERE click_timestamp IS NOT NULL",
    "documents_second_load": f"""SELECT * FROM ({sessions(SIX_HOURS)} SELECT {VISIT} FROM visits WHERE user_id % 3 <> 0)
        UNION ALL SELECT * FROM ({sessions(1800)} SELECT {VISIT} FROM visits WHERE user_id % 3 = 0)""",
    "hourly_performance": hourly("advertiser_name = 'NATION_3' AND", "", 24),
    "hourly_performance_each": hourly("", "advertiser_name,", 24 * 31),
    "hourly_click_performance": hourly_clicks("advertiser_name = 'NATION_3' AND", ""),
    "hourly_click_performance_each": hourly_clicks("", "advertiser_name,"),
    "ad_fatigue": fatigue("ORDER BY user_id, campaign_id LIMIT 50"),
    "ad_fatigue_100": fatigue("ORDER BY user_id, campaign_id LIMIT 100"),
    "ad_fatigue_each": fatigue(""),
    "targeting_categories": AD + f"""SELECT category, count(*) AS click_count FROM shown
        WHERE {USER} AND click_timestamp IS NOT NULL GROUP BY category
        ORDER BY click_count DESC, category NULLS FIRST LIMIT 3""",
    "targeting_categories_each": AD + """SELECT user_id, category, count(*) AS click_count,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category NULLS FIRST) AS INTEGER) AS place
        FROM shown WHERE click_timestamp IS NOT NULL GROUP BY user_id, category QUALIFY place <= 3""",
    "active_subject": AD + """SELECT user_id, advertiser_name FROM shown
        WHERE user_id = (SELECT min(user_id) FROM shown WHERE click_timestamp IS NOT NULL)
        ORDER BY ts NULLS FIRST, impression_id LIMIT 1""",
    "user_engagements": sessions(1800) + f"{ENGAGEMENT} WHERE {USER}",
    "user_engagements_each": sessions(1800) + ENGAGEMENT,
    "engaged_documents": AD + "SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS part FROM shown WHERE click_timestamp IS NOT NULL",
    "validation_summary": AD + """SELECT 'impressions' AS metric, count(*) AS value FROM impressions
        UNION ALL SELECT 'clicks', count(*) FROM clicks UNION ALL SELECT 'user_documents', count(*) FROM users
        UNION ALL SELECT 'engaged_users', count(DISTINCT user_id) FROM shown WHERE click_timestamp IS NOT NULL""",
    "null_blank_profile": REVIEWS + "SELECT " + ", ".join(
        f"count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS {c}" for c in RAW_COLUMNS) + " FROM raw",
    "dropped_reviews_basic": REVIEWS + """SELECT count(*) AS raw_rows, count(*) FILTER (ok) AS kept_rows,
        count(*) - count(*) FILTER (ok) AS dropped_rows FROM (SELECT coalesce(trim(review_id) <> ''
        AND trim(product_id) <> '' AND trim(star_rating) <> '' AND trim(review_date) <> '', false) AS ok FROM raw)""",
    "clean_reviews_basic": REVIEWS + f"SELECT * REPLACE ({day('review_date')} AS review_date) FROM basic",
    "clean_reviews_strict": REVIEWS + f"SELECT * REPLACE ({day('review_date')} AS review_date) FROM strict",
    "product_review_summary": REVIEWS + f"SELECT {SUMMARY_COLUMNS} FROM basic GROUP BY product_id",
    "customer_review_counts":
        REVIEWS + "SELECT customer_id, count(review_id) AS total_verified_reviews FROM basic GROUP BY customer_id",
    "monthly_product_reviews": REVIEWS + MONTHLY,
    "monthly_product_reviews_duplicates": REVIEWS + f"""SELECT product_id, year, month, count(*) AS rows
        FROM ({MONTHLY} UNION ALL {MONTHLY}) GROUP BY product_id, year, month HAVING count(*) > 1""",
    "top_reviewed_products_all": REVIEWS + f"""SELECT {SUMMARY_COLUMNS} FROM basic GROUP BY product_id
        ORDER BY total_reviews DESC, product_id LIMIT 10""",
    "top_verified_customers_all": REVIEWS + """SELECT customer_id, count(review_id) AS total_verified_reviews
        FROM basic GROUP BY customer_id ORDER BY total_verified_reviews DESC, customer_id NULLS FIRST LIMIT 10""",
    "product_summary_lookup":
        REVIEWS + f"SELECT {SUMMARY_COLUMNS} FROM basic WHERE product_id = '17' GROUP BY product_id",
    "product_monthly_trend": REVIEWS + f"SELECT * FROM ({MONTHLY}) WHERE product_id = '17'",
    "reviews_by_product_table": collapsed(PRODUCT_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept",
    "reviews_by_product_rating_table": collapsed(RATING_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept",
    "reviews_by_customer_table": collapsed(CUSTOMER_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept",
    "reviews_by_product": collapsed(PRODUCT_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept WHERE product_id = '17'",
    "reviews_by_product_rating":
        collapsed(RATING_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept WHERE product_id = '17' AND star_rating = 5",
    "reviews_by_customer": collapsed(CUSTOMER_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept WHERE customer_id = '41'",
    "review_upsert": collapsed(PRODUCT_KEY) + """SELECT CASE WHEN verified_purchase THEN product_title || ' II'
        ELSE product_title END AS product_title, count(*) AS rows FROM kept GROUP BY ALL""",
    "review_tables_second_load": collapsed(PRODUCT_KEY) + """SELECT CASE WHEN verified_purchase THEN product_title || ' II'
        ELSE product_title END AS product_title, count(*) AS rows FROM kept GROUP BY ALL""",
    "month_tables_second_load": month_table("hater_months", "customer_id"),
    "product_reviews_by_month": month_table("product_months", "product_id"),
    "customer_verified_by_month": month_table("verified_months", "customer_id"),
    "customer_haters_by_month": month_table("hater_months", "customer_id"),
    "customer_backers_by_month": month_table("backer_months", "customer_id"),
    "customer_classes_by_month": REVIEWS + """SELECT year_month, customer_id,
        CAST(count(*) FILTER (verified_purchase) AS INTEGER) AS verified,
        CAST(count(*) FILTER (star_rating IN (1, 2)) AS INTEGER) AS haters,
        CAST(count(*) FILTER (star_rating IN (4, 5)) AS INTEGER) AS backers FROM strict GROUP BY year_month, customer_id""",
    "top_products": top("product_months"),
    "top_products_of_month_table": top("product_months"),
    "top_customers": top("verified_months"),
    "top_haters": top("hater_months"),
    "top_backers": top("backer_months"),
    "build_tweets": TWEETS + "SELECT * FROM tweets",
    "tweet_rows": MESSAGES + f"SELECT author_id, {iso('created')} || '+00:00' AS created_at, text FROM said",
    "tweets_by_minute": MESSAGES + """SELECT strftime(created, 'tweets_%d_%m_%Y_%H_%M.csv') AS file,
        count(*) AS rows FROM said GROUP BY ALL""",
    "sse_events": """SELECT '{"page":' || page_id || '}' AS value FROM pages UNION ALL
        SELECT '{"page": ' || page_id || ',' || chr(10) || '"url": "' || url || '"}' FROM pages
        WHERE page_id % 7 <> 0""",
    "page_create_filter": PAGES + "SELECT user_id, domain, created_at, page_title FROM kept",
    "page_creations": PAGE_TABLE,
    "stream_tweets": TWEETS + "SELECT CAST(to_json(tweets) AS VARCHAR) AS value FROM tweets",
    "stream_minute_files": MESSAGES + f"""SELECT author_id, {iso('created')} || '+00:00' AS created_at, text,
        strftime(created, '%d_%m_%Y_%H_%M') AS minute FROM said""",
    "stream_page_creations": PAGE_TABLE,
    "page_table_new_checkpoint": PAGE_TABLE,
    "stream_raw_events": """SELECT '{"page":' || page_id || '}' AS value FROM pages UNION ALL
        SELECT '{"page":' || page_id || ',"url":"' || url || '"}' FROM pages WHERE page_id % 7 <> 0""",
}

# further ways to the same rows
for _name in ("campaign_ctr_top", "cost_efficiency", "regional_revenue", "top_users_by_clicks", "device_ctr",
              "campaign_performance_each", "user_sessions", "hourly_click_performance", "targeting_categories_each",
              "validation_summary"):
    ORACLE[f"{_name}_stored"] = ORACLE[_name]
for _name in ("campaign_performance", "campaign_performance_unknown", "advertiser_total_spend"):
    ORACLE[f"{_name}_totals"] = ORACLE[_name]
for _name in ("user_engagements", "last_sessions"):
    ORACLE[f"{_name}_by_user"] = ORACLE[_name]
ORACLE["user_documents_stored"] = ORACLE["user_documents_split"]
ORACLE["device_ctr_json"] = ORACLE["device_ctr"]
ORACLE["load_star_from_files"] = ORACLE["load_star_schema_impressions"]
ORACLE["product_review_summary_from_files"] = ORACLE["product_review_summary"]
ORACLE["documents_dropped_load"] = sessions(1800) + f"SELECT {VISIT} FROM visits WHERE user_id % 3 = 0"
for _name in ("top_products", "top_customers", "top_haters", "top_backers"):
    ORACLE[f"{_name}_rollup"] = ORACLE[_name]
ORACLE["documents_by_load"] = ORACLE["user_documents_split"]
ORACLE["stream_tweets_once"] = ORACLE["stream_tweets"]
ORACLE["product_review_summary_checked"] = f"""
    SELECT s.*, d.*, (SELECT count(*) FROM ({REVIEWS} SELECT * FROM raw) WHERE product_id IS NULL OR trim(product_id) = '') AS empty_product_id,
           (SELECT count(*) FROM ({REVIEWS} SELECT * FROM raw) WHERE star_rating IS NULL OR trim(star_rating) = '') AS empty_star_rating
    FROM ({ORACLE["product_review_summary"]}) s, ({ORACLE["dropped_reviews_basic"]}) d"""
ORACLE["stream_raw_events_by_range"] = ORACLE["stream_raw_events"]
for _name in ("campaign_performance", "advertiser_total_spend", "user_engagements", "reviews_by_product", "reviews_by_customer"):
    ORACLE[f"{_name}_lookup"] = ORACLE[_name]
ORACLE["review_by_id_lookup"] = collapsed(PRODUCT_KEY) + f"SELECT {SHOWN_REVIEW} FROM kept WHERE review_id = '100-1'"
ORACLE["stream_tweets_from_csv"] = ORACLE["stream_tweets"]
ORACLE["stream_minute_files_restarted"] = ORACLE["stream_minute_files"]
ORACLE["page_table_replayed"] = ORACLE["page_table_new_checkpoint"]
ORACLE["user_engagements_with_defaults"] = ORACLE["user_engagements_each"].replace(
    "LEFT JOIN campaigns p ON", "LEFT JOIN (SELECT * FROM campaigns WHERE campaign_id % 2 = 0) p ON").replace(
    "LEFT JOIN advertisers a ON", "LEFT JOIN (SELECT * FROM advertisers WHERE advertiser_id % 3 > 0) a ON")

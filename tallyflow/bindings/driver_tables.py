"""The provided test tables, shaped as advertising, review and event data.

Every frame covers its whole source table. Some rows are made awkward on
purpose (missing keys, bad dates, orphans, unclicked times) so that cleaning
and loading have something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.plans.star import Star

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order: two fact tables, which meet by their key on every scale."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)


# --- advertising -------------------------------------------------------------------------------


def star(spark: SparkSession, sf_dir: str) -> Star:
    """Star tables: nations advertise, suppliers are campaigns, events are impressions."""
    advertisers = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS advertiser_id", "n_name AS name")
    campaigns = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS campaign_id",
        "s_nationkey AS advertiser_id",
        "s_name AS name",
        "DATE'2024-01-01' AS start_date",
        "DATE'2024-01-31' AS end_date",
        "CASE WHEN s_suppkey % 11 <> 0 THEN concat('cat_', s_suppkey % 7) END AS targeting_criteria",
        "concat('slot_', s_suppkey % 3) AS ad_slot_size",
        "CAST(CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 10000 END AS DECIMAL(15,2)) AS budget",
        "CAST(s_acctbal AS DECIMAL(15,2)) AS remaining_budget",
    )
    users = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS user_id",
        "CAST(18 + c_custkey % 60 AS INT) AS age",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
        "concat('NATION_', c_nationkey) AS location",
        "CASE WHEN c_custkey % 13 <> 0 THEN concat(c_mktsegment, ' , ,', lower(c_mktsegment)) END AS interests",
        "date_add(DATE'2023-01-01', CAST(c_custkey % 365 AS INT)) AS signup_date",
    )
    facts = table(spark, sf_dir, "events").selectExpr(
        "lpad(lower(hex(event_id)), 32, '0') AS impression_id",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS campaign_id",
        "CAST(user_id AS INT) AS user_id",
        "CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device",
        "concat('NATION_', user_id % 25) AS location",
        "ts AS timestamp",
        "CAST(value AS DECIMAL(10,4)) AS amount",
        "event_id",
        "event_type",
    )
    impressions = (
        facts.join(campaigns.select("campaign_id"), "campaign_id", "left_semi")
        .join(users.select("user_id"), "user_id", "left_semi")
    )
    clicks = impressions.filter("event_type = 'click'").selectExpr(
        "impression_id AS click_id",
        "impression_id",
        "CASE WHEN event_id % 17 <> 0 THEN timestamp + INTERVAL 5 SECONDS END AS click_timestamp",
        "CAST(amount * 2 AS DECIMAL(10,4)) AS revenue_generated",
    )
    shown = impressions.selectExpr(
        "impression_id", "campaign_id", "user_id", "device", "location", "timestamp",
        "CAST(amount + 0.25 AS DECIMAL(10,4)) AS bid_amount", "amount AS cost_paid",
    )
    return Star(advertisers, users, campaigns, shown, clicks)


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).users


def raw_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign file rows: suppliers with the name of their nation as advertiser."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").selectExpr(
        "CAST(s_suppkey AS INT) AS id",
        "n_name AS AdvertiserName",
        "s_name AS name",
        "DATE'2024-01-01' AS start_date",
        "DATE'2024-12-31' AS end_date",
        "concat('cat_', s_suppkey % 7) AS targeting_criteria",
        "concat('slot_', s_suppkey % 3) AS ad_slot_size",
        "CAST(10000 AS DECIMAL(15,2)) AS budget",
        "CAST(s_acctbal AS DECIMAL(15,2)) AS remaining_budget",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event file rows: order lines, whose (order, line) numbers repeat, as events with a UUID."""
    return order_lines(spark, sf_dir).selectExpr(
        "concat('{00000000-0000-0000-0000-', lpad(hex(l_orderkey * 8 + l_linenumber), 12, '0'), '}') AS EventID",
        "concat('Supplier#', lpad(l_suppkey, 9, '0')) AS CampaignName",
        "CAST(o_custkey AS INT) AS UserID",
        "CASE l_linenumber % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS Device",
        "o_orderpriority AS Location",
        "l_shipdate AS Timestamp",
        "CAST(l_discount AS FLOAT) AS BidAmount",
        "CAST(l_tax AS FLOAT) AS AdCost",
        "l_returnflag = 'R' AS WasClicked",
        "CASE WHEN l_linenumber = 7 THEN 'never' ELSE date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') END "
        "AS ClickTimestamp",
        "CAST(l_quantity AS FLOAT) AS AdRevenue",
    )


def star_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign file rows of the campaigns of ``star``."""
    found = star(spark, sf_dir)
    names = found.advertisers.withColumnRenamed("name", "AdvertiserName")
    return found.campaigns.withColumnRenamed("campaign_id", "id").join(names, "advertiser_id").drop("advertiser_id")


def star_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event file rows of the impressions and clicks of ``star``."""
    found = star(spark, sf_dir)
    clicks = found.clicks.select("impression_id", "click_id", "click_timestamp", "revenue_generated")
    names = found.campaigns.select("campaign_id", F.col("name").alias("CampaignName"))
    return found.impressions.join(clicks, "impression_id", "left").join(names, "campaign_id").select(
        F.col("impression_id").alias("EventID"), "CampaignName", F.col("user_id").alias("UserID"), F.col("device").alias("Device"),
        F.col("location").alias("Location"), F.col("timestamp").alias("Timestamp"), F.col("bid_amount").cast("float").alias("BidAmount"),
        F.col("cost_paid").cast("float").alias("AdCost"), F.col("click_id").isNotNull().alias("WasClicked"),
        F.col("click_timestamp").cast("string").alias("ClickTimestamp"), F.col("revenue_generated").cast("float").alias("AdRevenue"))


# --- reviews -----------------------------------------------------------------------------------


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review file rows, all text: order lines as reviews of parts by customers."""
    return order_lines(spark, sf_dir).selectExpr(
        "o_orderpriority AS marketplace",
        "CASE WHEN l_orderkey % 109 <> 0 THEN CAST(o_custkey AS STRING) END AS customer_id",
        "concat(l_orderkey, '-', l_linenumber) AS review_id",
        "CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS product_id",
        "CAST(l_suppkey AS STRING) AS product_parent",
        "concat('Product ', l_partkey) AS product_title",
        "concat('Category ', l_partkey % 9) AS product_category",
        "CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN 'x' "
        "ELSE CAST(CAST(l_quantity AS INT) % 7 AS STRING) END AS star_rating",
        "CAST(l_linenumber AS STRING) AS helpful_votes",
        "CAST(l_linenumber + 1 AS STRING) AS total_votes",
        "CASE WHEN l_linenumber = 1 THEN '' ELSE 'N' END AS vine",
        "CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Y' "
        "WHEN l_returnflag = 'R' THEN '1' ELSE 'N' END AS verified_purchase",
        "concat(l_returnflag, ' ', l_linestatus) AS review_headline",
        "concat('Ordered ', CAST(l_quantity AS INT), ' pieces') AS review_body",
        "CASE WHEN l_orderkey % 107 = 0 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS review_date",
    )


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as review rows with long bodies."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS review_id",
        "CASE WHEN doc_id % 31 = 0 THEN '' ELSE source END AS customer_id",
        "text AS review_body",
        "CASE WHEN doc_id % 58 = 0 THEN NULL ELSE concat(lang, '\\t headline') END AS review_headline",
        "date_format(date_add(DATE'2024-01-01', CAST(doc_id % 366 AS INT)), 'yyyy-MM-dd') AS review_date",
        "concat('P', doc_id % 50) AS product_id",
        "CAST(doc_id % 5 + 1 AS STRING) AS star_rating",
    )


# --- events ------------------------------------------------------------------------------------


def tweet_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON messages with five kinds of ``created_at``, and broken messages between them."""
    at = "TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(conv_id + turn AS INT), turn)"
    return (
        table(spark, sf_dir, "conversations")
        .selectExpr("*", f"{at} AS at", "conv_id % 7 AS kind")
        .selectExpr(
            "CASE "
            "WHEN kind = 1 THEN to_json(struct(conv_id AS user_id, date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
            "AS created_at, text)) "
            "WHEN kind = 2 THEN to_json(struct('' AS author_id, role AS customer_id, "
            "date_format(at, 'yyyy-MM-dd HH:mm:ss') AS created_at, text AS review_body)) "
            "WHEN kind = 3 THEN to_json(struct(date_format(at, 'yyyy-MM-dd') AS created_at, text AS review_body)) "
            "WHEN kind = 4 THEN to_json(struct(role AS user_id, 'yesterday' AS created_at, '' AS review_body, "
            "text AS review_headline)) "
            "ELSE to_json(struct(role AS author_id, unix_seconds(at) AS created_at, text)) END AS sent",
            "CASE WHEN kind = 5 THEN concat('[', turn, ']') WHEN kind = 6 AND turn % 2 = 0 THEN '{}' "
            "WHEN kind = 6 THEN '{\"text\": ' END AS broken",
        )
        .selectExpr("explode(filter(array(sent, broken), m -> m IS NOT NULL)) AS value")
    )


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON page-create events, timed by the event of the same number where there is one."""
    pages = table(spark, sf_dir, "pages")
    events = table(spark, sf_dir, "events").selectExpr("event_id", "ts AS seen", "user_id AS seen_user")
    timed = pages.join(events, pages.page_id == events.event_id, "left").selectExpr(
        "page_id", "url", "coalesce(seen_user, page_id) AS user_id",
        "coalesce(seen, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, page_id % 86400)) AS ts")
    return timed.selectExpr(
        "to_json(struct("
        "struct(CASE page_id % 5 WHEN 0 THEN 'en.wikipedia.org' WHEN 1 THEN 'www.wikidata.org' "
        "WHEN 2 THEN 'commons.wikimedia.org' ELSE parse_url(url, 'HOST') END AS domain) AS meta, "
        "struct(CASE WHEN page_id % 19 <> 0 THEN user_id END AS user_id, "
        "CASE page_id % 4 WHEN 2 THEN true WHEN 3 THEN NULL ELSE false END AS user_is_bot) AS performer, "
        "CASE WHEN page_id % 6 <> 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END AS created_at, "
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS dt, "
        "url AS page_title)) AS value"
    )


def sse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks of server-sent-event text, two events each: one plain, one over two data lines."""
    return table(spark, sf_dir, "pages").selectExpr(
        "concat(': comment\\n', 'event: message\\r\\n', 'data: {\"page\":', page_id, '}\\n  \\n', "
        "'id: ', page_id, '\\n', 'data:  {\"page\": ', page_id, ',\\n', "
        "CASE WHEN page_id % 7 = 0 THEN '' ELSE concat('data: \"url\": \"', url, '\"}\\n') END) AS value"
    )

"""Questions about user engagement, answered from flat impression rows.

The nested user documents hold the same facts; the flat rows keep predicate
pushdown and aggregation ordinary. A click counts here only when it has a
time, as in the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.times import hour_label, iso
from tallyflow.operators.sessions import (
    DEFAULT_TIMEOUT,
    assign_sessions,
    last_labels,
    session_labels,
    session_summary,
)
from tallyflow.plans.reports import with_clicks
from tallyflow.plans.star import Star

UNKNOWN_ADVERTISER = "Unknown"
DEFAULT_CATEGORY = "General"


def of_user(rows: DataFrame, user_id: int | None) -> DataFrame:
    """The rows of one user; all rows without an id."""
    return rows if user_id is None else rows.filter(F.col("user_id") == user_id)


def described(rows: DataFrame, campaigns: DataFrame, advertisers: DataFrame) -> DataFrame:
    """``rows`` with campaign_name, advertiser_name and category of their campaign.

    A missing advertiser is ``Unknown``; a missing campaign gives category
    ``General``, while a campaign without criteria keeps a NULL category.
    """
    names = advertisers.select("advertiser_id", F.col("name").alias("advertiser_name"))
    lookup = campaigns.select(
        "campaign_id", "advertiser_id", F.col("name").alias("campaign_name"), "targeting_criteria",
        F.lit(True).alias("_known"),
    ).join(names, "advertiser_id", "left").drop("advertiser_id")
    category = F.when(F.col("_known").isNull(), F.lit(DEFAULT_CATEGORY)).otherwise(F.col("targeting_criteria"))
    joined = rows.join(lookup, "campaign_id", "left")
    return joined.select(
        *rows.columns, "campaign_name",
        F.coalesce("advertiser_name", F.lit(UNKNOWN_ADVERTISER)).alias("advertiser_name"),
        category.alias("category"),
    )


def clicked_facts(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Impressions with click_timestamp and revenue_generated of a timed click."""
    if "click_timestamp" in impressions.columns:
        timed = F.when(F.col("click_timestamp").isNotNull(), F.col("revenue_generated"))
        return impressions.withColumn("revenue_generated", timed)
    return with_clicks(impressions, clicks.filter("click_timestamp IS NOT NULL"),
                       "click_timestamp", "revenue_generated")


def timed_clicks(impressions: DataFrame, clicks: DataFrame, *columns: str) -> DataFrame:
    """The impressions with a timed click, with the given columns of it."""
    if "click_timestamp" in impressions.columns:
        return impressions.filter("click_timestamp IS NOT NULL")
    timed = clicks.filter("click_timestamp IS NOT NULL").select("impression_id", *columns)
    return impressions.join(timed, "impression_id", "inner" if columns else "left_semi")


def user_sessions(impressions: DataFrame, clicks: DataFrame, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """One row per user session: number, start, impressions, clicks."""
    rows = clicked_facts(impressions, clicks).select("user_id", "timestamp", "click_timestamp")
    return session_summary(session_labels(rows, timeout, F.col("click_timestamp").isNotNull()))


def hourly_performance(
    star: Star, advertiser: str | None, asof: str, hours: int = 24
) -> DataFrame:
    """Clicks and revenue by campaign and hour of one advertiser in the ``hours`` before ``asof``.

    Hours without clicks stay. Without an advertiser: of each of them.
    """
    end = F.lit(asof).cast("timestamp")
    recent = star.impressions.filter(
        (F.col("timestamp") >= end - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("timestamp") < end)
    )
    rows = described(recent, star.campaigns, star.advertisers)
    if advertiser is not None:
        rows = rows.filter(F.col("advertiser_name") == advertiser)
    keys = ["campaign"] if advertiser is not None else ["advertiser_name", "campaign"]
    return (
        clicked_facts(rows, star.clicks)
        .withColumn("campaign", F.col("campaign_name"))
        .groupBy(*keys, hour_label(F.col("timestamp")).alias("hour"))
        .agg(
            F.count_if(F.col("click_timestamp").isNotNull()).alias("total_clicks"),
            F.coalesce(F.sum("revenue_generated"), F.lit(0)).alias("total_revenue"),
        )
        .orderBy("hour", *keys)
    )


def hourly_click_performance(star: Star, advertiser: str | None) -> DataFrame:
    """Clicks and revenue by campaign and hour of the click, newest first, over all dates.

    Only clicked impressions count. Without an advertiser: of each of them.
    """
    impressions = star.impressions
    if advertiser not in (None, UNKNOWN_ADVERTISER):
        # the advertiser's campaigns choose the impressions before these meet their clicks
        own = star.campaigns.join(star.advertisers.filter(F.col("name") == advertiser), "advertiser_id", "left_semi")
        impressions = impressions.join(own.select("campaign_id"), "campaign_id", "left_semi")
    clicked = timed_clicks(impressions, star.clicks, "click_timestamp", "revenue_generated")
    rows = described(clicked, star.campaigns, star.advertisers)
    if advertiser is not None:
        rows = rows.filter(F.col("advertiser_name") == advertiser)
    keys = [] if advertiser is not None else ["advertiser_name"]
    return (
        rows.groupBy(
            *keys, "campaign_id", "campaign_name",
            F.hour("click_timestamp").alias("hour"),
            F.date_format("click_timestamp", "yyyy-MM-dd").alias("date"),
        )
        .agg(
            F.count("*").alias("total_clicks"),
            F.coalesce(F.sum("revenue_generated"), F.lit(0)).alias("total_revenue"),
        )
        .orderBy(F.desc("date"), F.desc("hour"), "campaign_id")
    )


def ad_fatigue(star: Star, threshold: int = 2, limit: int | None = 50) -> DataFrame:
    """User and campaign pairs shown at least ``threshold`` times and never clicked."""
    pairs = (
        clicked_facts(star.impressions, star.clicks)
        .groupBy("user_id", "campaign_id")
        .agg(
            F.count("*").alias("impressions_count"),
            F.count_if(F.col("click_timestamp").isNotNull()).alias("clicks_count"),
        )
        .filter((F.col("impressions_count") >= threshold) & (F.col("clicks_count") == 0))
    )
    if limit is not None:
        pairs = pairs.orderBy("user_id", "campaign_id").limit(limit)
    names = star.campaigns.select("campaign_id", F.col("name").alias("campaign_name"))
    return pairs.join(names, "campaign_id", "left").select(
        "user_id", "campaign_id", "campaign_name", "impressions_count", "clicks_count"
    )


def targeting_categories(star: Star, user_id: int | None = None, n: int = 3) -> DataFrame:
    """The ``n`` categories a user clicked most; ties by category. Without an id: for every user."""
    clicked = timed_clicks(of_user(star.impressions, user_id), star.clicks)
    # counting by campaign first leaves few rows to describe
    by_campaign = clicked.groupBy("user_id", "campaign_id").agg(F.count("*").alias("clicked"))
    counts = (
        described(by_campaign, star.campaigns, star.advertisers)
        .groupBy("user_id", "category")
        .agg(F.sum("clicked").alias("click_count"))
    )
    if user_id is not None:
        return counts.select("category", "click_count").orderBy(F.desc("click_count"), "category").limit(n)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("click_count"), "category"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def last_sessions(
    star: Star, user_id: int | None = None, n: int = 5, timeout: int = DEFAULT_TIMEOUT
) -> DataFrame:
    """The impressions of a user's ``n`` last sessions, flat. Without an id: of every user's."""
    shown = of_user(star.impressions, user_id)
    labels = last_labels(session_labels(shown, timeout), n)
    rows = clicked_facts(assign_sessions(shown, labels, timeout), star.clicks)
    return described(rows, star.campaigns, star.advertisers).select(
        "user_id", "session_seq", "session_start", "impression_id", "timestamp", "device", "bid_amount",
        "campaign_id", "campaign_name", "advertiser_name", "category", "click_timestamp", "revenue_generated",
    )


def user_engagements(
    star: Star, user_id: int | None = None, timeout: int = DEFAULT_TIMEOUT
) -> DataFrame:
    """What a user saw or clicked, in session order. Without an id: for every user, in no order."""
    shown = of_user(star.impressions, user_id)
    labels = session_labels(shown, timeout)
    rows = clicked_facts(assign_sessions(shown, labels, timeout), star.clicks)
    kind = F.when(F.col("click_timestamp").isNotNull(), "click").otherwise("impression")
    listed = described(rows, star.campaigns, star.advertisers).select(
        "user_id", "session_seq", F.col("timestamp").alias("_ts"), "impression_id",
        "campaign_id", "campaign_name", "advertiser_name",
        iso(F.col("timestamp")).alias("timestamp"), "category", kind.alias("engagement_type"),
    )
    if user_id is None:
        return listed.drop("_ts")
    return listed.orderBy("session_seq", "_ts", "impression_id").drop("_ts")


def active_subject(star: Star, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """The lowest user id with a click, and the advertiser of that user's first impression."""
    clicked = timed_clicks(star.impressions, star.clicks)
    lowest = clicked.select(F.min("user_id")).scalar()
    shown = star.impressions.filter(F.col("user_id") == lowest)
    labels = session_labels(shown, timeout).filter("session_seq = 1")
    first = (
        assign_sessions(shown, labels, timeout)
        .groupBy("user_id")
        .agg(F.min(F.struct("timestamp", "impression_id", "campaign_id")).alias("first"))
        .select("user_id", "first.campaign_id")
    )
    return described(first, star.campaigns, star.advertisers).select("user_id", "advertiser_name")


def validation_summary(star: Star) -> DataFrame:
    """Row counts of impressions, clicks and user documents, and users with a click."""
    engaged = timed_clicks(star.impressions, star.clicks).join(star.users.select("user_id"), "user_id", "left_semi")

    def counted(metric: str, df: DataFrame, what) -> DataFrame:
        return df.agg(what.alias("value")).select(F.lit(metric).alias("metric"), "value")

    return (
        counted("impressions", star.impressions, F.count("*"))
        .unionByName(counted("clicks", star.clicks, F.count("*")))
        .unionByName(counted("user_documents", star.users, F.count("*")))
        .unionByName(counted("engaged_users", engaged, F.count_distinct("user_id")))
    )

"""Campaign, advertiser, device, region and budget reports over the star tables.

Facts are aggregated by id first and meet the dimensions afterwards, so a hot
campaign or user costs one partial row per map task, never a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.numbers import per_thousand, percent, ratio


CLICK_COLUMNS = ["click_id", "click_timestamp", "revenue_generated"]


def joined_facts(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Every impression with the columns of its click: joined once by a load, so that no report joins the facts."""
    return impressions.join(clicks.select("impression_id", *CLICK_COLUMNS), "impression_id", "left")


def with_clicks(impressions: DataFrame, clicks: DataFrame, *columns: str) -> DataFrame:
    """Every impression with the given columns of its click, NULL where there is none; joined facts have them."""
    if set(columns) <= set(impressions.columns):
        return impressions
    return impressions.join(clicks.select("impression_id", *columns), "impression_id", "left")


def clicked(impressions: DataFrame, clicks: DataFrame, *columns: str) -> DataFrame:
    """The clicked impressions with the given columns of their click."""
    if set(columns) <= set(impressions.columns):
        return impressions.filter("click_id IS NOT NULL")
    return impressions.join(clicks.select("impression_id", *columns), "impression_id")


def in_range(start: str, end: str) -> Column:
    """Inclusive range on the impression time."""
    return F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def campaign_ctr_top(
    campaigns: DataFrame, impressions: DataFrame, clicks: DataFrame, start: str, end: str, n: int = 5
) -> DataFrame:
    """Campaigns with the highest click rate in the range; ties by campaign id."""
    counts = (
        with_clicks(impressions.filter(in_range(start, end)), clicks, "click_id")
        .groupBy("campaign_id")
        .agg(F.count("impression_id").alias("shown"), F.count("click_id").alias("clicked"))
    )
    return (
        counts.join(campaigns.select("campaign_id", "name"), "campaign_id")
        .select(
            "campaign_id",
            F.col("name").alias("campaign_name"),
            percent(F.col("clicked"), F.col("shown")).alias("ctr_percentage"),
        )
        .orderBy(F.desc("ctr_percentage"), "campaign_id")
        .limit(n)
        .drop("campaign_id")
    )


def advertiser_spending(
    advertisers: DataFrame, campaigns: DataFrame, impressions: DataFrame, start: str, end: str
) -> DataFrame:
    """What each advertiser paid in the range, highest first."""
    by_campaign = (
        impressions.filter(in_range(start, end)).groupBy("campaign_id").agg(F.sum("cost_paid").alias("cost"))
    )
    return (
        by_campaign.join(campaigns.select("campaign_id", "advertiser_id"), "campaign_id")
        .groupBy("advertiser_id")
        .agg(F.sum("cost").alias("total_spent"))
        .join(advertisers.select("advertiser_id", F.col("name").alias("advertiser_name")), "advertiser_id")
        .select("advertiser_name", "total_spent")
        .orderBy(F.desc("total_spent"), "advertiser_name")
    )


def cost_efficiency(campaigns: DataFrame, impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Cost per click and per thousand impressions of each campaign; no clicks, no cost per click."""
    totals = (
        with_clicks(impressions, clicks, "click_id")
        .groupBy("campaign_id")
        .agg(
            F.sum("cost_paid").alias("cost"),
            F.count("impression_id").alias("shown"),
            F.count("click_id").alias("clicked"),
        )
    )
    return totals.join(campaigns.select("campaign_id", "name"), "campaign_id").select(
        F.col("name").alias("campaign_name"),
        ratio(F.col("cost"), F.col("clicked")).alias("avg_cpc"),
        per_thousand(F.col("cost"), F.col("shown")).alias("avg_cpm"),
    )


def regional_revenue(impressions: DataFrame, clicks: DataFrame, n: int = 10) -> DataFrame:
    """Locations with the highest click revenue."""
    return (
        clicked(impressions, clicks, "revenue_generated")
        .groupBy("location")
        .agg(F.sum("revenue_generated").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "location")
        .limit(n)
    )


def top_users_by_clicks(users: DataFrame, impressions: DataFrame, clicks: DataFrame, n: int = 10) -> DataFrame:
    """Users with the most clicks; ties by user id."""
    return (
        clicked(impressions, clicks, "click_id")
        .groupBy("user_id")
        .agg(F.count("click_id").alias("total_clicks"))
        .join(users.select("user_id"), "user_id", "left_semi")
        .orderBy(F.desc("total_clicks"), "user_id")
        .limit(n)
    )


def budget_warnings(campaigns: DataFrame, threshold: str = "0.8") -> DataFrame:
    """Campaigns that spent more than ``threshold`` of their budget; a zero budget never warns."""
    spent = F.col("budget") - F.col("remaining_budget")
    share = F.try_divide(spent, F.col("budget"))
    return campaigns.filter(share > F.lit(threshold).cast("decimal(10,6)")).select(
        F.col("name").alias("campaign_name"),
        "budget",
        "remaining_budget",
        percent(spent, F.col("budget")).alias("budget_spent_percentage"),
    )


def device_ctr(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Click rate per device, highest first."""
    return (
        with_clicks(impressions, clicks, "click_id")
        .groupBy("device")
        .agg(percent(F.count("click_id"), F.count("impression_id")).alias("ctr_percentage"))
        .orderBy(F.desc("ctr_percentage"), "device")
    )


def campaign_totals(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Impressions, clicks and cost of every campaign shown: what lookups by campaign read instead of the facts.

    Totals of several loads stand side by side and are added up when read.
    """
    return with_clicks(impressions, clicks, "click_id").groupBy("campaign_id").agg(
        F.count("impression_id").alias("impressions"), F.count("click_id").alias("clicks"),
        F.sum("cost_paid").alias("cost_paid"))


def campaign_performance(impressions: DataFrame, clicks: DataFrame, campaign_id: int | None = None) -> DataFrame:
    """Impressions, clicks, click ratio and spend of one campaign; zeros for an unknown id.

    Without an id: one row for every campaign that was shown.
    """
    shown = impressions if campaign_id is None else impressions.filter(F.col("campaign_id") == campaign_id)
    return performance_of_totals(campaign_totals(shown, clicks), campaign_id)


def performance_of_totals(totals: DataFrame, campaign_id: int | None = None) -> DataFrame:
    """``campaign_performance`` out of ``campaign_totals``."""
    rows = totals if campaign_id is None else totals.filter(F.col("campaign_id") == campaign_id)
    grouped = rows.groupBy("campaign_id") if campaign_id is None else rows.groupBy()
    sums = grouped.agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("cost_paid").cast("double"), F.lit(0.0)).alias("ad_spend"),
    )
    key = F.col("campaign_id") if campaign_id is None else F.lit(campaign_id).alias("campaign_id")
    ctr = F.when(F.col("impressions") > 0, ratio(F.col("clicks"), F.col("impressions"))).otherwise(0.0)
    return sums.select(key, "impressions", "clicks", ctr.alias("ctr"), "ad_spend")


def advertiser_total_spend(
    impressions: DataFrame, campaigns: DataFrame, advertiser_id: int | None = None
) -> DataFrame:
    """Total spend of one advertiser, 0 for an unknown id; without an id, of every advertiser shown.

    Takes impressions or ``campaign_totals``.
    """
    by_campaign = impressions.groupBy("campaign_id").agg(F.sum("cost_paid").alias("cost"))
    owned = campaigns.select("campaign_id", "advertiser_id")
    if advertiser_id is not None:
        owned = owned.filter(F.col("advertiser_id") == advertiser_id)
    rows = by_campaign.join(owned, "campaign_id")
    grouped = rows.groupBy("advertiser_id") if advertiser_id is None else rows.groupBy()
    totals = grouped.agg(F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_ad_spend"))
    key = F.col("advertiser_id") if advertiser_id is None else F.lit(advertiser_id).alias("advertiser_id")
    return totals.select(key, "total_ad_spend")

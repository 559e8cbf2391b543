from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.plans import engagement, reports
from tests.sample import T0, click, hand_sample, impression, make_star

RANGE = ("2024-10-01 00:00:00", "2024-10-31 23:59:59")


def test_hand_sample(spark, rows):
    s = hand_sample(spark)
    assert rows(reports.campaign_ctr_top(s.campaigns, s.impressions, s.clicks, *RANGE)) == [("Test Campaign", 50.0)]
    assert rows(reports.campaign_performance(s.impressions, s.clicks, 1)) == [(1, 2, 1, 0.5, 0.3)]
    assert rows(reports.campaign_performance(s.impressions, s.clicks)) == [(1, 2, 1, 0.5, 0.3)]
    cost = reports.cost_efficiency(s.campaigns, s.impressions, s.clicks).first()
    assert (cost.campaign_name, cost.avg_cpc, round(cost.avg_cpm, 6)) == ("Test Campaign", 0.3, 150.0)
    assert rows(reports.advertiser_spending(s.advertisers, s.campaigns, s.impressions, *RANGE)) == [
        ("TestAdvertiser", Decimal("0.3000"))]
    assert rows(reports.budget_warnings(s.campaigns)) == []
    assert rows(reports.device_ctr(s.impressions, s.clicks)) == [("mobile", 50.0)]
    assert rows(reports.regional_revenue(s.impressions, s.clicks)) == [("PL", Decimal("1.0000"))]
    assert rows(reports.top_users_by_clicks(s.users, s.impressions, s.clicks)) == [(1000, 1)]
    assert rows(reports.advertiser_total_spend(s.impressions, s.campaigns, 1)) == [(1, 0.3)]
    assert rows(engagement.validation_summary(s)) == [
        ("clicks", 1), ("engaged_users", 1), ("impressions", 2), ("user_documents", 1)]


def test_unknown_ids_give_zeros(spark, rows):
    s = hand_sample(spark)
    assert rows(reports.campaign_performance(s.impressions, s.clicks, 99)) == [(99, 0, 0, 0.0, 0.0)]
    assert rows(reports.advertiser_total_spend(s.impressions, s.campaigns, 99)) == [(99, 0.0)]


def test_click_without_time_counts_in_reports_only(spark, rows):
    s = make_star(spark, [impression(1)], [click(1, None)])
    assert rows(reports.device_ctr(s.impressions, s.clicks)) == [("mobile", 100.0)]
    assert rows(engagement.ad_fatigue(s, threshold=1)) == [(1000, 1, "Test Campaign", 1, 0)]


def test_campaign_without_clicks_has_no_cost_per_click(spark, rows):
    s = make_star(spark, [impression(1, cost="0.20")])
    assert rows(reports.cost_efficiency(s.campaigns, s.impressions, s.clicks)) == [("Test Campaign", None, 200.0)]


@pytest.mark.parametrize("budget,remaining,warned", [
    ("1000.00", "200.00", False), ("1000.00", "199.99", True), ("0.00", "0.00", False), (None, "1.00", False),
    ("3.00", "0.60", False),
])
def test_budget_threshold(spark, budget, remaining, warned):
    row = (1, 1, "c", None, None, None, None, budget and Decimal(budget), Decimal(remaining))
    campaigns = spark.createDataFrame([row], schemas.CAMPAIGNS)
    assert (reports.budget_warnings(campaigns).count() == 1) == warned


def test_range_is_inclusive_and_ties_go_to_the_lower_id(spark):
    campaigns = [(i, 1, f"c{i}", None, None, None, None, None, None) for i in (1, 2, 3)]
    s = make_star(spark, [impression(i, campaign=i) for i in (1, 2, 3)], campaigns=campaigns)
    moment = T0.strftime("%Y-%m-%d %H:%M:%S")
    top = reports.campaign_ctr_top(s.campaigns, s.impressions, s.clicks, moment, moment, 2)
    assert [r.campaign_name for r in top.collect()] == ["c1", "c2"]


def test_filters_reach_the_scan(spark, folder):
    s = hand_sample(spark)
    s.impressions.write.parquet(f"{folder}/impressions")
    stored = spark.read.parquet(f"{folder}/impressions")
    plan = reports.advertiser_spending(s.advertisers, s.campaigns, stored, *RANGE)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in text
    assert "ReadSchema: struct<campaign_id:int,timestamp:timestamp,cost_paid:decimal(10,4)>" in text
    assert stored.filter(F.col("campaign_id") == 1).count() == 2

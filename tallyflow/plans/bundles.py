"""The report bundles: every campaign report, and every engagement report of one subject."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyflow.operators.sessions import DEFAULT_TIMEOUT
from tallyflow.plans import documents, engagement, reports
from tallyflow.plans.star import Star

# fixed values: the default range of the campaign reports
DEFAULT_START, DEFAULT_END = "2024-10-01 00:00:00", "2024-10-31 23:59:59"


def campaign_reports(star: Star, start: str = DEFAULT_START, end: str = DEFAULT_END) -> dict[str, DataFrame]:
    """The seven reports by name."""
    s = star
    return {
        "top_campaigns_ctr": reports.campaign_ctr_top(s.campaigns, s.impressions, s.clicks, start, end),
        "advertiser_spending": reports.advertiser_spending(s.advertisers, s.campaigns, s.impressions, start, end),
        "cost_efficiency": reports.cost_efficiency(s.campaigns, s.impressions, s.clicks),
        "regional_revenue": reports.regional_revenue(s.impressions, s.clicks),
        "top_users": reports.top_users_by_clicks(s.users, s.impressions, s.clicks),
        "budget_warnings": reports.budget_warnings(s.campaigns),
        "device_performance": reports.device_ctr(s.impressions, s.clicks),
    }


def engagement_reports(
    star: Star, asof: str, timeout: int = DEFAULT_TIMEOUT, threshold: int = 2
) -> dict[str, DataFrame]:
    """The five engagement reports of the active subject; empty when nobody clicked."""
    subject = engagement.active_subject(star, timeout).first()
    if subject is None:
        return {}
    user = subject["user_id"]
    history = documents.user_documents(star, timeout, user_id=user)
    return {
        "user_interaction_history": documents.user_history(history, user),
        "multi_session_engagement": engagement.last_sessions(star, user, timeout=timeout),
        "hourly_performance": engagement.hourly_performance(star, subject["advertiser_name"], asof),
        "ad_fatigue_report": engagement.ad_fatigue(star, threshold),
        "real_time_targeting": engagement.targeting_categories(star, user),
    }

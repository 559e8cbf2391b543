from datetime import timedelta
from decimal import Decimal

from tallyflow.plans import engagement
from tests.sample import T0, click, impression, make_star

ADVERTISERS = [(1, "Acme"), (2, "Bolt")]


def campaign(number, advertiser, name, criteria):
    return (number, advertiser, name, None, None, criteria, None, Decimal("1.00"), Decimal("1.00"))


CAMPAIGNS = [campaign(1, 1, "One", "Tech"), campaign(2, 2, "Two", None), campaign(3, 9, "Three", "Art")]


def star(spark, impressions, clicks=()):
    return make_star(spark, impressions, clicks, users=(1000, 1001), campaigns=CAMPAIGNS, advertisers=ADVERTISERS)


def test_names_and_defaults(spark, rows):
    s = star(spark, [impression(i, campaign=c, at=T0 + timedelta(seconds=i)) for i, c in enumerate((1, 2, 3, 4))])
    listed = engagement.user_engagements(s, 1000).select(
        "campaign_name", "advertiser_name", "category", "timestamp").collect()
    assert [tuple(r)[:3] for r in listed] == [
        ("One", "Acme", "Tech"), ("Two", "Bolt", None), ("Three", "Unknown", "Art"), (None, "Unknown", "General")]
    assert listed[0].timestamp == "2024-10-05T12:00:00"


def test_hourly_performance_is_half_open_and_keeps_hours_without_clicks(spark, rows):
    asof = T0 + timedelta(hours=24)
    shown = [impression(1, at=T0), impression(2, at=T0 + timedelta(hours=1)), impression(3, at=asof),
             impression(4, at=T0 - timedelta(microseconds=1)), impression(5, campaign=2)]
    s = star(spark, shown, [click(1, T0, None), click(2, None)])
    got = rows(engagement.hourly_performance(s, "Acme", asof.strftime("%Y-%m-%d %H:%M:%S")))
    assert got == [("One", "2024-10-05T12:00:00Z", 1, Decimal("0.0000")),
                   ("One", "2024-10-05T13:00:00Z", 0, Decimal("0.0000"))]
    unknown = star(spark, [impression(1, campaign=3)])
    assert rows(engagement.hourly_performance(unknown, "Unknown", "2024-10-06 00:00:00"))[0][0] == "Three"


def test_hourly_click_performance_counts_clicks_only(spark, rows):
    s = star(spark, [impression(1), impression(2), impression(3)], [click(1, T0), click(2, T0 + timedelta(hours=1))])
    assert [tuple(r) for r in engagement.hourly_click_performance(s, "Acme").collect()] == [
        (1, "One", 13, "2024-10-05", 1, Decimal("1.0000")), (1, "One", 12, "2024-10-05", 1, Decimal("1.0000"))]


def test_ad_fatigue(spark, rows):
    shown = [impression(1), impression(2), impression(3, campaign=2), impression(4, campaign=2), impression(5, user=1001)]
    s = star(spark, shown, [click(3)])
    assert rows(engagement.ad_fatigue(s)) == [(1000, 1, "One", 2, 0)]
    assert engagement.ad_fatigue(s, threshold=1, limit=1).collect()[0].user_id == 1000
    assert engagement.ad_fatigue(s, threshold=1, limit=None).count() == 2


def test_targeting_categories(spark, rows):
    shown = [impression(i, campaign=1 + i % 3) for i in range(7)] + [impression(9, user=1001)]
    s = star(spark, shown, [click(i) for i in range(7)])
    one = engagement.targeting_categories(s, 1000)
    assert [tuple(r) for r in one.collect()] == [("Tech", 3), (None, 2), ("Art", 2)]
    assert rows(engagement.targeting_categories(s)) == [(1000, None, 2, 2), (1000, "Art", 2, 3), (1000, "Tech", 3, 1)]
    assert engagement.targeting_categories(s, 1001).count() == 0


def test_active_subject(spark, rows):
    shown = [impression(1, user=1001, campaign=2), impression(2, user=1000, campaign=1, at=T0 + timedelta(days=1)),
             impression(3, user=1000, campaign=3)]
    assert rows(engagement.active_subject(star(spark, shown, [click(1), click(2)]))) == [(1000, "Unknown")]
    assert rows(engagement.active_subject(star(spark, shown))) == []

"""Small star tables: one advertiser, one campaign, one user, two impressions, one click."""

from datetime import date, datetime, timedelta
from decimal import Decimal

from tallyflow import schemas
from tallyflow.plans.star import Star

T0 = datetime(2024, 10, 5, 12, 0, 0)


def impression(number, user=1000, at=T0, campaign=1, device="mobile", cost="0.10"):
    return (f"{number:032x}", campaign, user, device, "PL", at, Decimal("0.5000"), Decimal(cost))


def click(number, at=T0, revenue="1.00"):
    return (f"{number:032x}", f"{number:032x}", at, None if revenue is None else Decimal(revenue))


def make_star(spark, impressions, clicks=(), users=(1000,), campaigns=None, advertisers=None):
    if campaigns is None:
        campaigns = [(1, 1, "Test Campaign", None, None, "Tech", "728x90", Decimal("1000.00"), Decimal("800.00"))]
    if advertisers is None:
        advertisers = [(1, "TestAdvertiser")]
    return Star(
        spark.createDataFrame(advertisers, schemas.ADVERTISERS),
        spark.createDataFrame([(u, 30, "F", "PL", "tech,music", date(2024, 1, 2)) for u in users], schemas.USERS),
        spark.createDataFrame(campaigns, schemas.CAMPAIGNS),
        spark.createDataFrame(list(impressions), schemas.IMPRESSIONS),
        spark.createDataFrame(list(clicks), schemas.CLICKS),
    )


def hand_sample(spark):
    return make_star(
        spark,
        [impression(1, cost="0.20"), impression(2, at=T0 + timedelta(seconds=10))],
        [click(1, T0 + timedelta(seconds=5))],
    )

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.functions.text import hex_bytes, hex_id
from tallyflow.operators.keyed import (
    duplicate_keys, first_per_key, insert_ignore, last_per_key, newest_version, surrogate_ids, upsert)
from tallyflow.plans import reports
from tallyflow.plans.reports import with_clicks
from tallyflow.operators import keyed
from tallyflow.plans import reviews
from tallyflow.plans.star import (
    fact_clicks, fact_impressions, load_advertisers, load_campaigns, load_clicks, load_facts, load_impressions, load_star)
from tallyflow.sinks.star_tables import read_star_table, write_star
from tallyflow.sinks.tables import compact, read_newest, save_star, write_version
from tallyflow.sources.relational import star_from_catalog, star_from_folder

UUID = "8A32D1F9-0000-4000-8000-00000000000"


def test_first_and_last_per_key(spark, rows):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (2, "x", 0)], "k int, s string, n int")
    assert rows(first_per_key(df, ["k"])) == [(1, "a", 9), (2, None, 1)]
    assert rows(last_per_key(df, ["k"])) == [(1, "b", 2), (2, "x", 0)]
    assert rows(first_per_key(df, ["k"], ["n"])) == [(1, "b", 2), (2, "x", 0)]
    assert rows(last_per_key(df, ["k"], ["n"])) == [(1, "a", 9), (2, None, 1)]
    assert rows(first_per_key(df.select("k"), ["k"])) == [(1,), (2,)]


def test_copies_collapse_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    plan = first_per_key(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan[plan.rindex("Exchange"):]


def test_insert_ignore(spark, rows):
    parents = spark.createDataFrame([(7,), (8,)], "id int")
    existing = spark.createDataFrame([(3, 7)], "k int, p int")
    incoming = spark.createDataFrame([(1, 9), (1, 8), (1, 7), (2, 9), (3, 8), (None, 7), (4, None)], "k int, p int")
    assert rows(insert_ignore(incoming, ["k"], [(parents, "p", "id")], existing)) == [(1, 7)]


def test_upsert_replaces_by_key(spark, rows):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert duplicate_keys(upsert(old, new, ["k"]), ["k"]).count() == 0
    assert rows(duplicate_keys(old.unionByName(new), ["k"])) == [(2, 2)]


def test_surrogate_ids_are_dense_and_stable(spark, rows):
    names = spark.createDataFrame([(f"n{i % 500}",) for i in range(2000)] + [(None,)], "name string")
    ids = surrogate_ids(names, "name", "id")
    found = {r.name: r.id for r in ids.collect()}
    assert sorted(found.values()) == list(range(1, 501))
    assert {r.name: r.id for r in surrogate_ids(names.repartition(7), "name", "id").collect()} == found
    more = names.unionByName(spark.createDataFrame([("new",), ("newer",)], "name string"))
    assert sorted(r.id for r in surrogate_ids(more, "name", "id", ids).collect()) == [501, 502]


def test_versions_replace_and_compact(spark, rows, folder):
    def load(data, version):
        return write_version(spark.createDataFrame(data, "k int, part int, v string"), f"{folder}/t", version)

    assert load([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "first") == 0
    assert load([(1, 0, "d")], "second") == 1
    assert load([(1, 0, "e")], "second") == 1
    assert rows(read_newest(spark, f"{folder}/t", ["k"])) == [(1, 0, "e"), (2, 0, "c")]
    compact(spark, f"{folder}/t", ["k"], f"{folder}/u", descending=["k"])
    assert rows(spark.read.parquet(f"{folder}/u").drop("version", "load")) == [(1, 0, "e"), (2, 0, "c")]
    assert newest_version(spark.read.parquet(f"{folder}/t"), ["k"]).count() == 2
    # a load without a name is a new one, also on a compacted table
    assert write_version(spark.createDataFrame([(3, 0, "f")], "k int, part int, v string"), f"{folder}/u") == 1
    assert rows(read_newest(spark, f"{folder}/u", ["k"])) == [(1, 0, "e"), (2, 0, "c"), (3, 0, "f")]


@pytest.mark.parametrize("text,expected", [
    ("8A32D1F9-1111-4222-8333-444444444444", "8a32d1f9111142228333444444444444"),
    ("{8a32d1f9-1111-4222-8333-444444444444}", "8a32d1f9111142228333444444444444"),
    ("8a32d1f9111142228333444444444444", "8a32d1f9111142228333444444444444"),
    ("8a32d1f9", None), ("zz32d1f9111142228333444444444444", None), ("", None), (None, None)])
def test_hex_id(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(hex_id(F.col("t"))).first()[0] == expected
    if expected:
        raw = spark.createDataFrame([(bytes.fromhex(expected),)], "b binary")
        assert raw.select(hex_bytes(F.col("b"))).first()[0] == expected


def test_compacted_review_tables_keep_their_layout(spark, rows, folder):
    """Month folders, and the newest review of a product first."""
    months = spark.createDataFrame([("2015-01", "a", 1), ("2015-02", "b", 2)], "year_month string, customer_id string, review_count int")
    write_version(months, f"{folder}/m", "one", ["year_month"])
    compact(spark, f"{folder}/m", ["year_month", "customer_id"], f"{folder}/n")
    found = spark.read.parquet(f"{folder}/n").filter("year_month = '2015-02'")
    assert found.first().customer_id == "b" and "PartitionFilters: [isnotnull(year_month" in plan_of(found)
    reviews = spark.createDataFrame([("p", date(2015, 1, d), str(d)) for d in (1, 3, 2)], "product_id string, review_date date, review_id string")
    write_version(reviews.coalesce(1), f"{folder}/r", "one")
    compact(spark, f"{folder}/r", ["product_id", "review_date", "review_id"], f"{folder}/s")
    assert [r.review_id for r in spark.read.parquet(f"{folder}/s").coalesce(1).collect()] == ["3", "2", "1"]


def raw_frames(spark):
    users = spark.createDataFrame(
        [(1, 30, "F", "PL", "a, b", date(2024, 1, 1)), (1, 20, "M", "PL", None, None), (2, 5, "F", "UA", "", None)],
        schemas.USERS)
    campaigns = spark.createDataFrame(
        [(10, "Acme", "Spring", None, None, "Tech", "s", Decimal("5.00"), Decimal("1.00")),
         (11, "Acme", "Spring", None, None, "Art", "s", Decimal("5.00"), Decimal("1.00")),
         (12, "ACMÉ", "Autumn", None, None, None, "s", Decimal("5.00"), Decimal("1.00")),
         (12, "Acme", "Winter", None, None, None, "s", Decimal("5.00"), Decimal("1.00"))], schemas.CAMPAIGNS_RAW)

    def event(number, campaign="Spring", user=1, clicked=True, at="2024-10-05 10:00:05"):
        return (f"{UUID}{number}", campaign, user, "m", "PL", datetime(2024, 10, 5, 10), 0.5, 0.1, clicked, at, 2.0)

    events = spark.createDataFrame(
        [event(1), event(1), event(2, user=99), event(3, campaign="None"), event(4, clicked=False),
         event(5, at="not yet"), event(6, clicked=None), event(6, user=2, clicked=False)],
        "EventID string, CampaignName string, UserID int, Device string, Location string, Timestamp timestamp, "
        "BidAmount float, AdCost float, WasClicked boolean, ClickTimestamp string, AdRevenue float")
    return users, campaigns, events


def test_load_star(spark, rows, folder):
    star = load_star(*raw_frames(spark))
    assert [r.user_id for r in star.users.orderBy("user_id").collect()] == [1, 2]
    assert {r.name for r in star.advertisers.collect()} == {"Acme", "ACMÉ"}
    assert rows(star.campaigns.select("campaign_id", "name")) == [(10, "Spring"), (11, "Spring"), (12, "Autumn")] or \
        rows(star.campaigns.select("campaign_id", "name")) == [(10, "Spring"), (11, "Spring"), (12, "Winter")]
    shown = star.impressions.orderBy("impression_id").collect()
    assert [r.impression_id[-1] for r in shown] == ["1", "4", "5", "6"]
    assert {r.campaign_id for r in shown} == {10}
    assert (shown[0].bid_amount, shown[0].cost_paid) == (Decimal("0.5000"), Decimal("0.1000"))
    clicks = {r.impression_id[-1]: r.click_timestamp for r in star.clicks.collect()}
    assert clicks == {"1": datetime(2024, 10, 5, 10, 0, 5), "5": None}
    written = write_star(*raw_frames(spark), f"{folder}/star")
    for name in ("users", "advertisers", "campaigns", "impressions", "clicks"):
        assert rows(getattr(written, name)) == rows(getattr(star, name))
    assert star_from_folder(spark, f"{folder}/star").impressions.count() == 4
    joined = star_from_folder(spark, f"{folder}/star")
    sums = reports.campaign_performance(joined.impressions, joined.clicks)
    assert "impression_id" not in "".join(re.findall(r"hashpartitioning\(.*?\)", plan_of(sums)))
    assert rows(sums) == rows(reports.campaign_performance(star.impressions, star.clicks))
    assert rows(reports.regional_revenue(joined.impressions, joined.clicks)) == rows(
        reports.regional_revenue(star.impressions, star.clicks))
    totals = read_star_table(spark, f"{folder}/star", "campaign_totals")
    assert rows(reports.performance_of_totals(totals)) == rows(sums)
    one = star_from_folder(spark, f"{folder}/star", by_user=True).impressions.filter("user_id = 7")
    assert "EqualTo(user_id,7)" in plan_of(one)
    again = write_star(*raw_frames(spark), f"{folder}/star")
    assert rows(reports.performance_of_totals(read_star_table(spark, f"{folder}/star", "campaign_totals"))) == rows(sums)
    for name in ("users", "advertisers", "campaigns", "impressions", "clicks"):
        assert rows(getattr(again, name)) == rows(getattr(star, name))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_take_one_scan_and_one_exchange_by_id(spark, rows, folder):
    users, campaigns, events = raw_frames(spark)
    parents = load_star(users, campaigns, events)
    events.write.parquet(f"{folder}/events")
    stored = spark.read.parquet(f"{folder}/events")
    facts = load_facts(stored, parents.campaigns, parents.users)
    assert rows(fact_impressions(facts)) == rows(load_impressions(events, parents.campaigns, parents.users))
    assert rows(fact_clicks(facts)) == rows(load_clicks(events, parents.impressions))
    plan = plan_of(facts)
    assert plan.count(f"{folder}/events") == 1 and plan.count("hashpartitioning(impression_id") == 1


def test_bucketed_facts_join_without_shuffle(spark, rows, folder):
    star = load_star(*raw_frames(spark))
    save_star(star, "default", folder, 4)
    saved = star_from_catalog(spark, "default")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = with_clicks(saved.impressions, saved.clicks, "click_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert rows(joined) == rows(with_clicks(star.impressions, star.clicks, "click_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("advertisers", "users", "campaigns", "impressions", "clicks"):
            spark.sql(f"DROP TABLE {name}")


def test_second_load_ignores_known_keys(spark):
    users, campaigns, events = raw_frames(spark)
    star = load_star(users, campaigns, events)
    assert load_impressions(events, star.campaigns, star.users, existing=star.impressions).count() == 0
    assert load_campaigns(campaigns, star.advertisers, existing=star.campaigns).count() == 0


def test_names_without_case_and_accents(spark):
    users, campaigns, events = raw_frames(spark)
    advertisers = spark.createDataFrame([(5, "acme")], schemas.ADVERTISERS)
    loaded = load_campaigns(campaigns, advertisers, ci=True)
    assert {r.advertiser_id for r in loaded.collect()} == {5} and loaded.count() == 3
    assert load_campaigns(campaigns, advertisers).count() == 0
    assert load_advertisers(campaigns, ci=True).count() == 1
    assert load_advertisers(campaigns, advertisers, ci=True).count() == 0
    assert load_star(users, campaigns, events, ci=True).impressions.count() == 4


def test_hot_keys_are_split_at_run_time(spark, rows, folder):
    """A third of all facts on one key, no broadcast: same result, and the join splits the key."""
    facts = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").alias("impression_id"),
        F.md5(F.col("id").cast("string")).alias("device"))
    clicks = spark.range(60_000).select(F.col("id").cast("string").alias("impression_id"), F.col("id").alias("click_id"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        joined = with_clicks(facts, clicks, "click_id")
        assert len(joined.collect()) == 60_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan


def test_newest_row_moves_rows_once(spark, rows):
    frame = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 1, "d")], "k int, version int, v string")
    newest = keyed.newest_row(frame, ["k"])
    assert rows(newest) == rows(keyed.newest_version(frame, ["k"])) == [(1, 1, "b"), (2, 0, "c")]


def test_review_rows_without_repeats_are_not_grouped(spark, rows):
    columns = sorted({c for c in reviews.REVIEW_COLUMNS})
    frame = spark.createDataFrame([[f"{c}{i}" if c != "review_id" else r for c in columns]
                                   for i, r in enumerate(("x", "y", "y", "y"))], columns)
    frame = frame.unionByName(frame)
    whole = frame.unionByName(frame.filter("review_id = 'x'").withColumn("review_id", F.lit("z")).limit(1))
    repeated = reviews.repeated_reviews(whole)
    assert rows(repeated) == [("x",), ("y",)]
    assert rows(reviews.reviews_by_product_table(whole, repeated)) == rows(reviews.reviews_by_product_table(whole))

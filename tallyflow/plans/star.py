"""Raw advertising files to the five star tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.text import hex_id
from tallyflow.functions.times import lenient
from tallyflow.operators.keyed import first_per_key, insert_ignore, surrogate_ids


@dataclass(frozen=True)
class Star:
    """The relational model: two dimensions of campaigns, users, and two fact tables."""

    advertisers: DataFrame
    users: DataFrame
    campaigns: DataFrame
    impressions: DataFrame
    clicks: DataFrame


def load_users(users_raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return insert_ignore(users_raw, ["user_id"], existing=existing)


def load_advertisers(
    campaigns_raw: DataFrame, existing: DataFrame | None = None, ci: bool = False
) -> DataFrame:
    """Distinct advertiser names with a generated id; only new names when ``existing`` is given.

    With ``ci`` names that differ in case or accents only are one name.
    """
    names = campaigns_raw.select(F.col("AdvertiserName").alias("name"))
    if ci:
        names = first_per_key(names.withColumn("_name", _name_key("name", ci)), ["_name"])
        if existing is not None:
            names = names.join(existing.select(_name_key("name", ci).alias("_name")), "_name", "left_anti")
    return surrogate_ids(names, "name", "advertiser_id", existing)


def load_campaigns(
    campaigns_raw: DataFrame, advertisers: DataFrame, ci: bool = False, existing: DataFrame | None = None
) -> DataFrame:
    """Campaign rows with the advertiser's id looked up by name.

    ``ci`` compares names without regard to case and accents.
    """
    staged = campaigns_raw.withColumn("_name", _name_key("AdvertiserName", ci))
    ids = _first_by_name(advertisers, "advertiser_id", ci)
    rows = staged.join(ids, "_name").select(
        F.col("id").alias("campaign_id"), "advertiser_id", "name", "start_date", "end_date",
        "targeting_criteria", "ad_slot_size", "budget", "remaining_budget",
    )
    return insert_ignore(rows.dropna(subset=["name"]), ["campaign_id"], existing=existing)


def load_impressions(
    events_raw: DataFrame,
    campaigns: DataFrame,
    users: DataFrame,
    ci: bool = False,
    existing: DataFrame | None = None,
) -> DataFrame:
    """One impression per event id, with the campaign looked up by name.

    A name shared by several campaigns means the one with the lowest id, so the
    lookup never multiplies events. Events of unknown campaigns or users are
    skipped.
    """
    staged = _staged_events(events_raw).withColumn("_name", _name_key("CampaignName", ci))
    ids = _first_by_name(campaigns, "campaign_id", ci)
    rows = staged.join(ids, "_name").select(
        "impression_id", "campaign_id",
        F.col("UserID").alias("user_id"), F.col("Device").alias("device"),
        F.col("Location").alias("location"), F.col("Timestamp").alias("timestamp"),
        _money("BidAmount").alias("bid_amount"),
        _money("AdCost").alias("cost_paid"),
    )
    return insert_ignore(rows, ["impression_id"], parents=[(users, "user_id", "user_id")], existing=existing)


def load_clicks(events_raw: DataFrame, impressions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One click per clicked impression; its id is the impression's, which is unique here."""
    rows = _staged_events(events_raw).filter("WasClicked").select(
        "impression_id",
        lenient(F.col("ClickTimestamp")).alias("click_timestamp"),
        _money("AdRevenue").alias("revenue_generated"),
    )
    kept = insert_ignore(
        rows, ["impression_id"], parents=[(impressions, "impression_id", "impression_id")], existing=existing
    )
    return kept.select(F.col("impression_id").alias("click_id"), *rows.columns)


def load_facts(
    events_raw: DataFrame,
    campaigns: DataFrame,
    users: DataFrame,
    ci: bool = False,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Both fact tables in one pass over the events: a row per new impression_id, with ``impression`` and ``click``.

    The same rows as ``load_impressions`` and ``load_clicks`` give: of events
    with one id the first valid one is the impression and the first clicked one,
    valid or not, its click (NULL if none was). Copies of an event are combined
    before the one exchange by id.

    ``existing`` holds the stored impressions with their ``click_id``. Of those
    there is a row only if a click comes for one that has none; its ``impression``
    is NULL.
    """
    staged = _staged_events(events_raw).withColumn("_name", _name_key("CampaignName", ci))
    ids = _first_by_name(campaigns, "campaign_id", ci)
    known = users.select(F.col("user_id").alias("UserID"), F.lit(True).alias("_user"))
    rows = staged.join(ids, "_name", "left").join(known, "UserID", "left")
    # rows without an id make a group that has neither; a filter on the id would work it out once more for every event
    named = F.col("impression_id").isNotNull()
    valid = named & F.col("campaign_id").isNotNull() & F.col("_user").isNotNull()
    impression = F.struct(
        "campaign_id", F.col("UserID").alias("user_id"), F.col("Device").alias("device"),
        F.col("Location").alias("location"), F.col("Timestamp").alias("timestamp"),
        _money("BidAmount").alias("bid_amount"), _money("AdCost").alias("cost_paid"))
    click = F.struct(lenient(F.col("ClickTimestamp")).alias("click_timestamp"), _money("AdRevenue").alias("revenue_generated"))
    facts = rows.groupBy("impression_id").agg(
        F.min(F.when(valid, impression)).alias("impression"), F.min(F.when(named & F.col("WasClicked"), click)).alias("click"))
    if existing is None:
        return facts.filter(F.col("impression").isNotNull())
    known = existing.select("impression_id", F.col("click_id").isNotNull().alias("_clicked"))
    facts = facts.join(known, "impression_id", "left")
    new = F.col("_clicked").isNull() & F.col("impression").isNotNull()
    late = ~F.coalesce(F.col("_clicked"), F.lit(True)) & F.col("click").isNotNull()
    return facts.filter(new | late).select(
        "impression_id", F.when(F.col("_clicked").isNull(), F.col("impression")).alias("impression"), "click")


def fact_impressions(facts: DataFrame) -> DataFrame:
    """The impressions of ``load_facts``."""
    return facts.filter(F.col("impression").isNotNull()).select("impression_id", "impression.*")


def fact_clicks(facts: DataFrame) -> DataFrame:
    """The clicks of ``load_facts``; a click has the id of its impression, which is unique."""
    return facts.filter(F.col("click").isNotNull()).select(F.col("impression_id").alias("click_id"), "impression_id", "click.*")


def fact_rows(facts: DataFrame) -> DataFrame:
    """The impressions of ``load_facts`` with the columns of their click."""
    click_id = F.when(F.col("click").isNotNull(), F.col("impression_id")).alias("click_id")
    return facts.filter(F.col("impression").isNotNull()).select("impression_id", "impression.*", click_id, "click.*")


def late_rows(facts: DataFrame) -> DataFrame:
    """The clicks of ``load_facts`` whose impression was stored by an earlier load."""
    return facts.filter(F.col("impression").isNull()).select("impression_id", F.col("impression_id").alias("click_id"), "click.*")


def load_star(
    users_raw: DataFrame,
    campaigns_raw: DataFrame,
    events_raw: DataFrame,
    ci: bool = False,
    store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
    existing: Mapping[str, DataFrame] | None = None,
) -> Star:
    """All five tables, parents first; ``existing`` holds the tables of an earlier load, whose keys are skipped.

    Its ``shown`` are the stored impressions with their ``click_id``. A click that
    comes in a later load than its impression is added to the clicks.
    ``store(rows, name)`` may add the new rows of a table to what is there and
    return the whole table as read back, and is asked to keep ``facts``, from
    which both fact tables are written. Children then look up stored parents,
    whose known size lets Spark choose between a broadcast and a shuffle before
    it moves any event.
    """
    there = existing or {}
    users = store(load_users(users_raw, there.get("users")), "users")
    advertisers = store(load_advertisers(campaigns_raw, there.get("advertisers"), ci), "advertisers")
    campaigns = store(load_campaigns(campaigns_raw, advertisers, ci, there.get("campaigns")), "campaigns")
    facts = store(load_facts(events_raw, campaigns, users, ci, there.get("shown")), "facts")
    return Star(advertisers, users, campaigns, store(fact_impressions(facts), "impressions"),
                store(fact_clicks(facts), "clicks"))


def _money(column: str):
    return F.col(column).cast("float").cast("decimal(10,4)")


def _staged_events(events_raw: DataFrame) -> DataFrame:
    return events_raw.withColumn("impression_id", hex_id(F.col("EventID")))


def _name_key(column: str, ci: bool):
    return F.collate(F.col(column), "UNICODE_CI_AI") if ci else F.col(column)


def _first_by_name(dimension: DataFrame, id_name: str, ci: bool) -> DataFrame:
    named = dimension.select(_name_key("name", ci).alias("_name"), id_name)
    return first_per_key(named, ["_name"])

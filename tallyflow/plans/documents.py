"""Nested user documents: demographics, sessions, impressions, clicks.

A document is bounded: it holds a run of up to ``per_document`` impressions of
a user's time line, and a user has as many documents (part 0, 1, 2, ...) as
that takes, so that no row and no task ever holds a whole hot user. A user
never shown anything has one, without sessions. The parts together are
complete, and every read below takes a user's parts as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.text import split_list
from tallyflow.functions.times import midnight
from tallyflow.operators.sessions import DEFAULT_TIMEOUT, assign_sessions, session_labels
from tallyflow.plans.engagement import clicked_facts, described, of_user
from tallyflow.plans.star import Star

PER_DOCUMENT = 20_000

DOCUMENT_KEY = ["user_id", "part"]


def _part(per_document: int, offset: Column) -> Column:
    """Document number of the row ``offset`` rows into its slice.

    A slice of at most ``per_document`` rows goes to one document whole; only a
    larger one is spread over the documents its rows fill.
    """
    whole = F.col("n_rows") <= per_document
    place = F.col("rows_before") + F.when(whole, F.lit(0)).otherwise(offset)
    return F.floor(place / F.lit(per_document))


def user_documents(
    star: Star,
    timeout: int = DEFAULT_TIMEOUT,
    per_document: int = PER_DOCUMENT,
    user_id: int | None = None,
) -> DataFrame:
    """One document per user (several parts for a very busy one); users never shown anything
    keep an empty session list. ``click`` is NULL where an impression was not clicked."""
    shown = of_user(star.impressions, user_id)
    labels = session_labels(shown, timeout)
    # rows of a large slice are spread by a hash of their id
    part = _part(per_document, F.pmod(F.xxhash64("impression_id"), F.col("n_rows")))
    rows = described(
        clicked_facts(assign_sessions(shown, labels, timeout), star.clicks), star.campaigns, star.advertisers
    )
    impression = F.struct(
        "timestamp",
        "impression_id",
        "device",
        F.col("bid_amount").cast("double").alias("bid_amount"),
        F.struct("campaign_id", F.col("campaign_name").alias("name"), "advertiser_name").alias("campaign"),
        "category",
        F.when(
            F.col("click_timestamp").isNotNull(),
            F.struct("click_timestamp", F.col("revenue_generated").cast("double").alias("revenue_generated")),
        ).alias("click"),
    )
    # one exchange by document serves both levels of nesting
    sessions = (
        rows.select("user_id", part.alias("part"), "session_seq", "session_start",
                    impression.alias("impression"))
        .repartition(*[F.col(c) for c in DOCUMENT_KEY])
        .groupBy(*DOCUMENT_KEY, "session_seq", "session_start")
        .agg(F.sort_array(F.collect_list("impression")).alias("impressions"))
    )
    bodies = sessions.groupBy(*DOCUMENT_KEY).agg(
        F.sort_array(
            F.collect_list(
                F.struct("session_seq", "session_start", F.to_date("session_start").alias("session_date"),
                         "impressions")
            )
        ).alias("sessions")
    )
    first, last = _part(per_document, F.lit(0)), _part(per_document, F.col("n_rows") - 1)
    parts = labels.select("user_id", F.explode(F.sequence(first, last)).alias("part")).distinct()
    demographics = F.struct("age", "gender", "location", split_list(F.col("interests")).alias("interests"))
    # users meet their documents on the full document key, which no hot user dominates
    heads = of_user(star.users, user_id).join(parts, "user_id", "left").select(
        "user_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        demographics.alias("demographics"),
        midnight(F.col("signup_date")).alias("signup_date"),
    )
    return (
        heads.join(bodies, DOCUMENT_KEY, "left")
        .filter((F.col("part") == 0) | F.col("sessions").isNotNull())
        .withColumn("sessions", F.coalesce("sessions", F.array().cast(bodies.schema["sessions"].dataType)))
    )


def user_history(documents: DataFrame, user_id: int | None = None) -> DataFrame:
    """Demographics and sessions of one user, a row for each of its documents; without an id, of every user."""
    return of_user(documents, user_id).select("user_id", "part", "demographics", "sessions")


def flatten(documents: DataFrame) -> DataFrame:
    """The impressions inside documents as rows; documents without sessions vanish."""
    return (
        documents.select("user_id", "part", F.explode("sessions").alias("session"))
        .select("user_id", "part", "session.session_seq", "session.session_start",
                F.explode("session.impressions").alias("impression"))
        .select(
            "user_id", "part", "session_seq", "session_start", "impression.impression_id",
            "impression.timestamp", "impression.device", "impression.bid_amount",
            "impression.campaign.campaign_id", F.col("impression.campaign.name").alias("campaign_name"),
            "impression.campaign.advertiser_name", "impression.category",
            "impression.click.click_timestamp", "impression.click.revenue_generated",
        )
    )


def engaged(documents: DataFrame) -> DataFrame:
    """All documents of the users with a click in any of them."""
    clicked = documents.filter(F.exists("sessions", lambda s: F.exists(s["impressions"], lambda i: i["click"].isNotNull())))
    return documents.join(clicked.select("user_id").distinct(), "user_id", "left_semi").select(*documents.columns)


def last_sessions_of_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    """Documents cut to the last ``n`` sessions of their user; documents left empty vanish, but for a user's first.

    Sessions are numbered over all of a user's documents, so the newest number
    tells which to keep.
    """
    newest = documents.groupBy("user_id").agg(
        F.max(F.array_max(F.transform("sessions", lambda s: s["session_seq"]))).alias("newest"))
    joined = documents.join(newest, "user_id")
    kept = F.filter("sessions", lambda s: s["session_seq"] > F.col("newest") - F.lit(n))
    cut = joined.withColumn("sessions", kept).filter((F.size("sessions") > 0) | F.col("newest").isNull())
    return cut.select(*documents.columns)

"""Tweet-like records out of reviews, and author rows out of tweet messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.text import ellipsize, first_filled, squeeze
from tallyflow.functions.times import from_json_scalar, iso_utc, minute_label, utc

# fixed values
SOURCE = "amazon_reviews"
TEXT_LIMIT = 280
MINUTE_FILE = "tweets_{minute}.csv"

# fixed values: message fields, each list in the order it is tried
AUTHOR_FIELDS = ["author_id", "user_id", "customer_id"]
TEXT_FALLBACKS = ["review_body", "review_headline"]
MESSAGE_FIELDS = ["created_at", "text", *AUTHOR_FIELDS, *TEXT_FALLBACKS]


def build_tweets(reviews: DataFrame, now: str | None = None, sequence: Column | None = None) -> DataFrame:
    """One record per review: squeezed text of at most 280 characters, created now.

    ``sequence`` numbers the rows and names records without review id; where
    the source has no such number a hash of the row does, which stays the same
    when a task is repeated.
    """
    number = F.xxhash64(*reviews.columns) if sequence is None else sequence
    created = iso_utc(utc(now))
    body = squeeze(first_filled(F.col("review_body"), F.col("review_headline"), F.lit("")))
    # a column of its own, so that the text is squeezed once
    return reviews.withColumn("_body", F.coalesce(body, F.lit(""))).select(
        first_filled(F.col("review_id"), F.concat(F.lit("generated-"), number.cast("string"))).alias("tweet_id"),
        first_filled(F.col("customer_id"), F.lit("unknown")).alias("user_id"),
        ellipsize(F.col("_body"), TEXT_LIMIT).alias("text"),
        created.alias("created_at"),
        created.alias("review_date"),
        F.col("review_date").alias("original_review_date"),
        "product_id",
        "star_rating",
        F.lit(SOURCE).alias("source"),
    )


def as_messages(df: DataFrame) -> DataFrame:
    """One JSON text ``value`` per row; NULL fields stay in the text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def parsed_objects(messages: DataFrame) -> DataFrame:
    """JSON objects of the messages as VARIANT ``payload``; anything else and ``{}`` is skipped."""
    value = F.col("value")
    if dict(messages.dtypes)["value"] == "binary":
        value = F.try_validate_utf8(value.cast("string"))
    payload = messages.withColumn("payload", F.try_parse_json(value))
    kind = F.schema_of_variant("payload")
    return payload.filter(kind.startswith("OBJECT<") & (kind != "OBJECT<>"))


def _shown(value: Column) -> Column:
    """Text of a JSON scalar; a true flag reads ``True``."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _truthy(value: Column) -> Column:
    """Text of a JSON value; NULL for absent, null, empty, zero and false values."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    empty = (
        ((kind == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"))
        | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == 0))
        | kind.isin("OBJECT<>", "ARRAY<VOID>") & F.to_json(value).isin("{}", "[]")
    )
    return F.when(~F.coalesce(empty, F.lit(False)), F.nullif(_shown(value), F.lit("")))


def tweet_rows(messages: DataFrame, now: str | None = None) -> DataFrame:
    """Author, creation time and squeezed text of each JSON message.

    ``created_at`` is the ISO text, ``created_ts`` the timestamp behind it.
    """
    fields = parsed_objects(messages).select(
        *[F.try_variant_get("payload", f"$.{name}", "variant").alias(name) for name in MESSAGE_FIELDS]
    )
    author = F.coalesce(*[_truthy(F.col(f)) for f in AUTHOR_FIELDS], F.lit(""))
    text = F.coalesce(_shown(F.col("text")), *[_truthy(F.col(f)) for f in TEXT_FALLBACKS], F.lit(""))
    rows = fields.select(
        author.alias("author_id"),
        from_json_scalar(F.col("created_at"), utc(now)).alias("created_ts"),
        squeeze(text).alias("text"),
    )
    return rows.withColumn("created_at", iso_utc(F.col("created_ts")))


def minute_rows(rows: DataFrame) -> DataFrame:
    """Rows of the minute files: the three columns and the ``minute`` they belong to."""
    return rows.select("author_id", "created_at", "text", minute_label(F.col("created_ts")).alias("minute"))


def tweets_by_minute(rows: DataFrame) -> DataFrame:
    """Number of rows of each minute file."""
    prefix, suffix = MINUTE_FILE.split("{minute}")
    name = F.concat(F.lit(prefix), F.col("minute"), F.lit(suffix))
    return minute_rows(rows).groupBy(name.alias("file")).agg(F.count("*").alias("rows"))

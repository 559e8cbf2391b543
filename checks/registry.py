"""Queries by name, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyflow.bindings import driver_tables as data
from tallyflow.operators.keyed import duplicate_keys, upsert
from tallyflow.operators.profile import dropped_rows, null_blank_counts
from tallyflow.plans import documents, engagement, page_events, reports, reviews, rollups, tweets
from tallyflow.plans.bundles import campaign_reports
from tallyflow.plans.star import (
    Star,
    fact_clicks,
    fact_impressions,
    load_advertisers,
    load_campaigns,
    load_facts,
    load_users,
)
from tallyflow.schemas import EVENTS_RAW, REVIEWS_RAW
from tallyflow.session import scratch_folder, shuffles_freed
from tallyflow.sinks import levels, minutes, star_tables, tables, topics, user_documents
from tallyflow.sinks.reports import write_reports
from tallyflow.sources import captures, files
from tallyflow.sources.relational import star_from_folder
from tallyflow.sources.topics import folder_topic, stored_topic
from tallyflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"
ASOF = "2024-01-30 12:00:00"
NOW = "2024-06-01 12:00:00"
SIX_HOURS = 6 * 3600
ADVERTISER = "NATION_3"
CAMPAIGN_ID, ADVERTISER_ID, USER_ID = 3, 3, 8
PRODUCT_ID, CUSTOMER_ID, REVIEW_ID = "17", "41", "100-1"
FIRST_MONTH, LAST_MONTH = "1996-03", "1999-10"


def _star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(data.star(spark, sf_dir))


def _loaded(name: str) -> Query:
    """One table of the star load; the tables it depends on are written first, as in the load itself."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users, campaigns = data.raw_users(spark, sf_dir), data.raw_campaigns(spark, sf_dir)
        if name == "users":
            return load_users(users)
        if name == "advertisers":
            return load_advertisers(campaigns)
        root = scratch_folder(spark, "star")
        advertisers = tables.stored(load_advertisers(campaigns), f"{root}/advertisers")
        if name == "campaigns":
            return load_campaigns(campaigns, advertisers)
        events = data.raw_events(spark, sf_dir)
        campaigns = tables.stored(load_campaigns(campaigns, advertisers), f"{root}/campaigns")
        facts = load_facts(events, campaigns, tables.stored(load_users(users), f"{root}/users"))
        return fact_impressions(facts) if name == "impressions" else fact_clicks(facts)

    return run


def _loaded_twice(name: str) -> Query:
    """A star loaded from every second event, then from all events with other devices: what is stored stays."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_folder(spark, "star")
        users, campaigns, events = (f(spark, sf_dir) for f in (data.raw_users, data.raw_campaigns, data.raw_events))
        even = events.filter("conv(substr(EventID, -2, 1), 16, 10) % 2 = 0")
        star_tables.write_star(users.filter("user_id % 2 = 0"), campaigns, even.filter("UserID % 2 = 0"), root)
        star_tables.write_star(users, campaigns, even, root)
        star_tables.write_star(users, campaigns, events.withColumn("Device", F.upper("Device")), root)
        return star_tables.read_star_table(spark, root, name)

    return run


class _Crash(Exception):
    """A job that ends between two writes."""


def _facts_of(spark: SparkSession, root: str) -> DataFrame:
    """Impressions, clicks and cost by campaign as each of the stored tables has them."""
    star = star_from_folder(spark, root)
    plain = [star_tables.read_star_table(spark, root, name) for name in ("impressions", "clicks")]
    found = {
        "tables": reports.campaign_totals(*plain),
        "shown": reports.campaign_totals(star.impressions, star.clicks),
        "by_user": reports.campaign_totals(star_from_folder(spark, root, by_user=True).impressions, star.clicks),
        "totals": star_tables.read_star_table(spark, root, "campaign_totals"),
    }
    rows = [reports.performance_of_totals(t).withColumn("source", F.lit(name)) for name, t in found.items()]
    return reduce(DataFrame.unionByName, rows)


def _after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that ends after each of its writes in turn and is run again, then a second load that does."""
    root = scratch_folder(spark, "star")
    users, campaigns = (f(spark, sf_dir) for f in (data.raw_users, data.raw_campaigns))
    # every load reads the events, which are put together once
    events = tables.stored(data.raw_events(spark, sf_dir), f"{root}/events")

    def load(rows: DataFrame, last: str | None) -> None:
        def stop(name: str) -> None:
            if name == last:
                raise _Crash(name)

        try:
            star_tables.write_star(users, campaigns, rows, root, written=stop)
        except _Crash:
            pass

    for part, stops in ((events.filter("hash(UserID) % 2 = 0"), ("shown", "impressions")), (events, ("late",))):
        for name in (*stops, None):
            load(part, name)
    return _facts_of(spark, root)


def _devices(s: Star) -> DataFrame:
    return reports.device_ctr(s.impressions, s.clicks)


def _late_clicks(build: Callable[[SparkSession, str], DataFrame], fold: bool = False) -> Query:
    """A star of events that nobody clicked yet, loaded again with every click; ``fold`` compacts it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_folder(spark, "star")
        users, campaigns, events = (f(spark, sf_dir) for f in (data.raw_users, data.raw_campaigns, data.raw_events))
        star_tables.write_star(users, campaigns, events.withColumn("WasClicked", F.lit(False)), root)
        star_tables.write_star(users, campaigns, events, root)
        if fold:
            star_tables.compact_star(spark, root)
            star_tables.forget_older(spark, root)
        return build(spark, root)

    return run


def _stored(build: Callable[[Star], DataFrame]) -> Query:
    """A report over the layout of the load: facts joined once, by time."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star, path = data.star(spark, sf_dir), scratch_folder(spark, "shown")
        facts = reports.joined_facts(star.impressions, star.clicks)
        return build(replace(star, impressions=tables.stored(tables.by_range(facts, ["timestamp", "impression_id"]), path)))

    return run


def _totals(build: Callable[[DataFrame, Star], DataFrame]) -> Query:
    """A lookup over the stored totals of campaigns."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star, path = data.star(spark, sf_dir), scratch_folder(spark, "totals")
        totals = tables.by_range(reports.campaign_totals(star.impressions, star.clicks), ["campaign_id"])
        return build(tables.stored(totals, path), star)

    return run


def _by_user(build: Callable[[Star], DataFrame]) -> Query:
    """A question about one user over facts laid out by user."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star, path = data.star(spark, sf_dir), scratch_folder(spark, "users")
        facts = reports.joined_facts(star.impressions, star.clicks)
        laid = tables.by_range(facts, ["user_id", "timestamp", "impression_id"])
        return build(replace(star, impressions=tables.stored(laid, path)))

    return run


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star load out of compressed CSV files."""
    root = scratch_folder(spark, "files")
    events = data.raw_events(spark, sf_dir)
    others = [c for c in StructType.fromDDL(EVENTS_RAW).names if c not in events.columns]
    frames = {"users": data.raw_users(spark, sf_dir), "campaigns": data.raw_campaigns(spark, sf_dir),
              "events": events.withColumns({c: F.lit(None).cast("string") for c in others})}
    with shuffles_freed(spark):
        for name, frame in frames.items():
            frame.write.options(header="true", escape='"', compression="snappy").csv(f"{root}/{name}")
    star_tables.write_star(files.read_users(spark, f"{root}/users"), files.read_campaigns(spark, f"{root}/campaigns"),
                           files.read_events(spark, f"{root}/events"), f"{root}/star")
    return star_tables.read_star_table(spark, f"{root}/star", "impressions")


def _reviews_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review results out of a TSV file that need not be read as a whole, written twice and read back."""
    root = scratch_folder(spark, "files")
    data.raw_reviews(spark, sf_dir).write.options(header="true", escape='"', sep="\t").csv(f"{root}/reviews")
    clean = reviews.clean_basic(files.read_reviews(spark, f"{root}/reviews", "\t", multi_line=False))
    tables.write_review_results(clean.filter("star_rating = 1"), f"{root}/results")
    tables.write_review_results(clean, f"{root}/results")
    return spark.read.parquet(f"{root}/results/product_reviews_summary")


def one_file(df: DataFrame, path: str, **options: str) -> None:
    """One CSV file: the rows come out of all tasks, and the last one only writes them down as they arrive."""
    df.repartition(1).write.options(header="true", escape='"', **options).csv(path)


def _reviews_with_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review results out of one CSV file whose quoted bodies span lines, with the checks of the same pass."""
    root = scratch_folder(spark, "files")
    raw = data.raw_reviews(spark, sf_dir)
    body = F.concat("review_body", F.lit(',\n"'), "review_headline", F.lit('"\r\n'))
    # one file is what the job is about
    one_file(raw.withColumn("review_body", body), f"{root}/reviews", emptyValue="")
    found = tables.checked_review_results(files.read_reviews(spark, f"{root}/reviews"), f"{root}/results")
    checks = [F.lit(found[c]).alias(c) for c in ("raw_rows", "kept_rows", "dropped_rows", "empty_product_id", "empty_star_rating")]
    return spark.read.parquet(f"{root}/results/product_reviews_summary").select("*", *checks)


def _top_of_rollups(name: str, months: Callable[[DataFrame], DataFrame]) -> Query:
    """A top list from stored roll-ups of a month table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_folder(spark, "rollups")
        rollups.write_rollup(months(reviews.clean_strict(data.raw_reviews(spark, sf_dir))), name, path)
        return rollups.top_of_rollup(spark, path, FIRST_MONTH, LAST_MONTH)

    return run


def _documents_by_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents brought up to date after each of two loads, the second with later impressions and earlier clicks."""
    root = scratch_folder(spark, "documents")
    users, campaigns, events = data.star(spark, sf_dir).users, data.star_campaigns(spark, sf_dir), data.star_events(spark, sf_dir)
    # both loads read the events, which are put together once
    events = tables.stored(events, f"{root}/events")
    first = events.filter(F.col("Timestamp") < F.lit(ASOF).cast("timestamp")).withColumn(
        "WasClicked", F.col("WasClicked") & (F.col("UserID") % 3 > 0))
    for rows in (first, events):
        star_tables.write_star(users, campaigns, rows, f"{root}/star")
        user_documents.update_documents(spark, f"{root}/star", f"{root}/table", timeout=SIX_HOURS)
    return documents.flatten(user_documents.read_documents(spark, f"{root}/table")).drop("part")


def _json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "reports")
    write_reports({"device_performance": campaign_reports(data.star(spark, sf_dir), START, END)["device_performance"]}, root)
    return spark.read.schema("device string, ctr_percentage double").json(f"{root}/device_performance")


def _months_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a month table that was appended to itself."""
    months = reviews.monthly_product_reviews(reviews.clean_basic(data.raw_reviews(spark, sf_dir)))
    path = scratch_folder(spark, "months")
    for _ in range(2):
        months.write.mode("append").parquet(path)
    return duplicate_keys(spark.read.parquet(path), ["product_id", "year", "month"])


def _documents_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all users, then a load that drops them for those of every third user."""
    root, star = scratch_folder(spark, "documents"), data.star(spark, sf_dir)
    tables.write_documents(star, root)
    again = replace(star, users=star.users.filter("user_id % 3 = 0"), impressions=star.impressions.filter("user_id % 3 = 0"))
    tables.write_documents(again, root, drop_existing=True)
    return documents.flatten(tables.read_documents(spark, root)).drop("part")


def _documents_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all users, then a second load with other sessions for every third user."""
    root, star = scratch_folder(spark, "documents"), data.star(spark, sf_dir)
    tables.write_documents(star, root, timeout=SIX_HOURS)
    again = replace(star, users=star.users.filter("user_id % 3 = 0"), impressions=star.impressions.filter("user_id % 3 = 0"))
    tables.write_documents(again, root)
    return documents.flatten(tables.read_documents(spark, root)).drop("part")


def _reviews_twice(name: str) -> Query:
    """Review tables of all reviews, then a second load of the verified ones under a new title."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, clean = scratch_folder(spark, "reviews"), reviews.clean_strict(data.raw_reviews(spark, sf_dir))
        if name == "reviews_by_product":
            second = clean.filter("verified_purchase").withColumn("product_title", F.concat("product_title", F.lit(" II")))
            tables.write_review_tables(clean, root)
            tables.write_review_tables(second, root)
            return tables.read_review_table(spark, root, name).groupBy("product_title").agg(F.count("*").alias("rows"))
        # months of two halves, each in its own load
        tables.write_review_tables(clean.filter("month(review_date) % 2 = 0"), root)
        tables.write_review_tables(clean.filter("month(review_date) % 2 = 1"), root)
        return tables.read_review_table(spark, root, name).select("year_month", "customer_id", "review_count")

    return run


def _raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(data.raw_reviews(spark, sf_dir))


def _basic(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _raw(lambda raw: build(reviews.clean_basic(raw)))


def _strict(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _raw(lambda raw: build(reviews.clean_strict(raw)))


def _last_sessions_nested(s: Star) -> DataFrame:
    return documents.flatten(documents.last_sessions_of_documents(documents.user_documents(s, SIX_HOURS)))


def _split(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _star(lambda s: build(documents.user_documents(s, SIX_HOURS, per_document=5)))


def _engaged(s: Star) -> DataFrame:
    return documents.engaged(documents.user_documents(s)).select("user_id", "part")


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = tweets.as_messages(page_events.page_create_filter(data.page_messages(spark, sf_dir)))
    return page_events.page_creations(page_events.page_rows(processed))


def _review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by product, with the verified ones arriving again as a second load under a new title."""
    table = reviews.reviews_by_product_table(reviews.clean_strict(data.raw_reviews(spark, sf_dir)))
    second = table.filter("verified_purchase").withColumn("product_title", F.concat("product_title", F.lit(" II")))
    return upsert(table, second, reviews.PRODUCT_KEY).groupBy("product_title").agg(F.count("*").alias("rows"))


def _stream_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews in a folder, streamed to tweet messages, read back."""
    root = scratch_folder(spark, "tweets")
    source = data.document_reviews(spark, sf_dir)
    source.write.parquet(f"{root}/reviews")
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/reviews")
    _finish(jobs.to_topic(jobs.tweet_messages(stream, NOW), f"{root}/topic", f"{root}/checkpoint"))
    return stored_topic(spark, f"{root}/topic")


def _stream_tweets_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review files in CSV, streamed file by file to tweet messages, read back."""
    root = scratch_folder(spark, "tweets")
    source = data.document_reviews(spark, sf_dir)
    names = StructType.fromDDL(REVIEWS_RAW).names
    frame = source.select(*[F.col(c) if c in source.columns else F.lit(None).cast("string").alias(c) for c in names])
    frame.write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(f"{root}/reviews")
    stream = files.stream_reviews(spark, f"{root}/reviews", max_files=1)
    _finish(jobs.to_topic(jobs.tweet_messages(stream, NOW), f"{root}/topic", f"{root}/checkpoint"))
    return stored_topic(spark, f"{root}/topic")


def _stream_minutes_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that arrive in two parts, any minute in both, to minute files; the stream starts again for the second."""
    root = scratch_folder(spark, "minutes")
    messages = data.tweet_messages(spark, sf_dir)
    for part in (0, 1):
        topics.store(messages.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == part), f"{root}/topic")
        _finish(jobs.minute_files(folder_topic(spark, f"{root}/topic"), f"{root}/files", f"{root}/checkpoint", NOW))
    return minutes.read_minutes(spark, f"{root}/files")


def _page_table_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages into one page table twice, the second time by a stream that lost its checkpoint."""
    root = scratch_folder(spark, "pages")
    topics.store(jobs.page_messages(data.page_messages(spark, sf_dir)), f"{root}/processed")
    for part in (0, 1):
        processed = folder_topic(spark, f"{root}/processed")
        _finish(jobs.page_table(processed, f"{root}/table", f"{root}/checkpoint-{part}"))
    return levels.read_table(spark, f"{root}/table", page_events.PAGE_KEY).select(*page_events.PAGE_KEY)


def _half_described(s: Star) -> Star:
    """The star without every second campaign and every third advertiser, whose impressions get defaults."""
    return replace(s, campaigns=s.campaigns.filter("campaign_id % 2 = 0"), advertisers=s.advertisers.filter("advertiser_id % 3 > 0"))


def _stream_tweets_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweet messages that a producer sends twice, streamed into a topic that holds each once."""
    root = scratch_folder(spark, "tweets")
    messages = tweets.as_messages(tweets.build_tweets(data.document_reviews(spark, sf_dir), NOW))
    for _ in range(2):
        topics.store(messages, f"{root}/sent")
    kept = jobs.once(folder_topic(spark, f"{root}/sent"), "1 day")
    _finish(jobs.to_topic(kept, f"{root}/topic", f"{root}/checkpoint"))
    return stored_topic(spark, f"{root}/topic")


def _stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in a folder topic, streamed to minute files, counted per minute."""
    root = scratch_folder(spark, "minutes")
    topics.store(data.tweet_messages(spark, sf_dir), f"{root}/topic")
    _finish(jobs.minute_files(folder_topic(spark, f"{root}/topic"), f"{root}/files", f"{root}/checkpoint", NOW))
    return minutes.read_minutes(spark, f"{root}/files")


def _stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page events in a folder topic, through the processed topic, to the keyed table."""
    root = scratch_folder(spark, "pages")
    topics.store(data.page_messages(spark, sf_dir), f"{root}/input")
    raw = folder_topic(spark, f"{root}/input")
    _finish(jobs.to_topic(jobs.page_messages(raw), f"{root}/processed", f"{root}/checkpoint-1"))
    processed = folder_topic(spark, f"{root}/processed")
    _finish(jobs.page_table(processed, f"{root}/table", f"{root}/checkpoint-2"))
    return levels.read_table(spark, f"{root}/table", page_events.PAGE_KEY).select(*page_events.PAGE_KEY)


def _stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured event text in files, streamed to a topic of raw events, read back."""
    root = scratch_folder(spark, "raw")
    data.sse_chunks(spark, sf_dir).write.option("lineSep", "\n\n\n").text(f"{root}/captured")
    chunks = files.stream_sse(spark, f"{root}/captured", "\n\n\n")
    _finish(jobs.to_topic(jobs.raw_messages(chunks), f"{root}/topic", f"{root}/checkpoint"))
    return stored_topic(spark, f"{root}/topic")


def _stream_raw_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with all kinds of line ends, streamed by byte ranges to a topic of raw events, read back."""
    root = scratch_folder(spark, "raw")
    kind = F.pmod(F.xxhash64("value"), F.lit(3))
    text = F.when(kind == 0, F.regexp_replace("value", "\r\n|\n", "\r")).when(
        kind == 1, F.regexp_replace("value", "\r\n|\n", "\r\n")).otherwise(F.col("value"))
    data.sse_chunks(spark, sf_dir).select(text.alias("value")).write.option("lineSep", "\n\n\n").text(f"{root}/captured")
    # ranges smaller than the files, so that events lie across their borders
    chunks = captures.stream_captures(spark, f"{root}/captured", range_bytes=4096)
    _finish(jobs.to_topic(jobs.raw_messages(chunks), f"{root}/topic", f"{root}/checkpoint"))
    return stored_topic(spark, f"{root}/topic")


def _page_table_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one page table, the second with a checkpoint of its own and only new messages."""
    root = scratch_folder(spark, "pages")
    messages = data.page_messages(spark, sf_dir)
    for part in (0, 1):
        chosen = messages.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == part)
        topics.store(jobs.page_messages(chosen), f"{root}/processed-{part}")
        processed = folder_topic(spark, f"{root}/processed-{part}")
        _finish(jobs.page_table(processed, f"{root}/table", f"{root}/checkpoint-{part}"))
    return levels.read_table(spark, f"{root}/table", page_events.PAGE_KEY).select(*page_events.PAGE_KEY)


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


REGISTRY: dict[str, Query] = {
    # reports over the star tables
    "campaign_ctr_top": _star(lambda s: reports.campaign_ctr_top(s.campaigns, s.impressions, s.clicks, START, END)),
    "advertiser_spending": _star(
        lambda s: reports.advertiser_spending(s.advertisers, s.campaigns, s.impressions, START, END)),
    "cost_efficiency": _star(lambda s: reports.cost_efficiency(s.campaigns, s.impressions, s.clicks)),
    "regional_revenue": _star(lambda s: reports.regional_revenue(s.impressions, s.clicks)),
    "top_users_by_clicks": _star(lambda s: reports.top_users_by_clicks(s.users, s.impressions, s.clicks)),
    "budget_warnings": _star(lambda s: reports.budget_warnings(s.campaigns)),
    "device_ctr": _star(lambda s: reports.device_ctr(s.impressions, s.clicks)),
    "campaign_performance": _star(lambda s: reports.campaign_performance(s.impressions, s.clicks, CAMPAIGN_ID)),
    "campaign_performance_unknown": _star(lambda s: reports.campaign_performance(s.impressions, s.clicks, -1)),
    "campaign_performance_each": _star(lambda s: reports.campaign_performance(s.impressions, s.clicks)),
    "advertiser_total_spend": _star(
        lambda s: reports.advertiser_total_spend(s.impressions, s.campaigns, ADVERTISER_ID)),
    "advertiser_total_spend_each": _star(lambda s: reports.advertiser_total_spend(s.impressions, s.campaigns)),
    "device_ctr_json": _json_report,
    # the same from the layout of the load
    "campaign_ctr_top_stored": _stored(lambda s: reports.campaign_ctr_top(s.campaigns, s.impressions, s.clicks, START, END)),
    "cost_efficiency_stored": _stored(lambda s: reports.cost_efficiency(s.campaigns, s.impressions, s.clicks)),
    "regional_revenue_stored": _stored(lambda s: reports.regional_revenue(s.impressions, s.clicks)),
    "top_users_by_clicks_stored": _stored(lambda s: reports.top_users_by_clicks(s.users, s.impressions, s.clicks)),
    "device_ctr_stored": _stored(lambda s: reports.device_ctr(s.impressions, s.clicks)),
    "campaign_performance_each_stored": _stored(lambda s: reports.campaign_performance(s.impressions, s.clicks)),
    "campaign_performance_totals": _totals(lambda t, s: reports.performance_of_totals(t, CAMPAIGN_ID)),
    "campaign_performance_unknown_totals": _totals(lambda t, s: reports.performance_of_totals(t, -1)),
    "advertiser_total_spend_totals": _totals(lambda t, s: reports.advertiser_total_spend(t, s.campaigns, ADVERTISER_ID)),
    "user_engagements_by_user": _by_user(lambda s: engagement.user_engagements(s, USER_ID)),
    "last_sessions_by_user": _by_user(lambda s: engagement.last_sessions(s, USER_ID)),
    "user_sessions_stored": _stored(lambda s: engagement.user_sessions(s.impressions, s.clicks)),
    "user_documents_stored": _stored(lambda s: documents.flatten(documents.user_documents(s, SIX_HOURS)).drop("part")),
    "hourly_click_performance_stored": _stored(lambda s: engagement.hourly_click_performance(s, ADVERTISER)),
    "targeting_categories_each_stored": _stored(engagement.targeting_categories),
    "validation_summary_stored": _stored(engagement.validation_summary),
    # star tables out of raw rows
    "load_star_schema_users": _loaded("users"),
    "load_star_schema_advertisers": _loaded("advertisers"),
    "load_star_schema_campaigns": _loaded("campaigns"),
    "load_star_schema_impressions": _loaded("impressions"),
    "load_star_schema_clicks": _loaded("clicks"),
    "load_star_from_files": _from_files,
    "load_star_second": _loaded_twice("impressions"),
    "load_star_second_clicks": _loaded_twice("clicks"),
    "load_star_after_crash": _after_crash,
    "load_star_late_clicks": _late_clicks(_facts_of),
    "load_star_late_clicks_compacted": _late_clicks(_facts_of, fold=True),
    "late_clicks_by_device": _late_clicks(lambda spark, root: _devices(star_from_folder(spark, root))),
    # sessions, documents and engagement
    "user_sessions": _star(lambda s: engagement.user_sessions(s.impressions, s.clicks)),
    "user_sessions_6h": _star(lambda s: engagement.user_sessions(s.impressions, s.clicks, SIX_HOURS)),
    "user_documents": _star(documents.user_documents),
    "user_documents_flat": _star(lambda s: documents.flatten(documents.user_documents(s, SIX_HOURS))),
    "user_documents_heads": _star(lambda s: documents.user_documents(s, SIX_HOURS).select(
        "user_id", "demographics.age", "demographics.gender", "demographics.location",
        F.array_join("demographics.interests", "|").alias("interests"), "signup_date",
        F.size("sessions").cast("bigint").alias("n_sessions"))),
    "user_history": _star(lambda s: documents.user_history(documents.user_documents(s, user_id=USER_ID), USER_ID)),
    "user_history_flat": _star(lambda s: documents.flatten(documents.user_documents(s, user_id=USER_ID))),
    "last_sessions": _star(lambda s: engagement.last_sessions(s, USER_ID)),
    "last_sessions_each": _star(lambda s: engagement.last_sessions(s, timeout=SIX_HOURS)),
    "last_sessions_of_documents": _star(_last_sessions_nested),
    "hourly_performance": _star(lambda s: engagement.hourly_performance(s, ADVERTISER, ASOF)),
    "hourly_performance_each": _star(lambda s: engagement.hourly_performance(s, None, ASOF, 24 * 31)),
    "hourly_click_performance": _star(lambda s: engagement.hourly_click_performance(s, ADVERTISER)),
    "hourly_click_performance_each": _star(lambda s: engagement.hourly_click_performance(s, None)),
    "ad_fatigue": _star(engagement.ad_fatigue),
    "ad_fatigue_100": _star(lambda s: engagement.ad_fatigue(s, limit=100)),
    "ad_fatigue_each": _star(lambda s: engagement.ad_fatigue(s, limit=None)),
    "targeting_categories": _star(lambda s: engagement.targeting_categories(s, USER_ID)),
    "targeting_categories_each": _star(engagement.targeting_categories),
    "active_subject": _star(engagement.active_subject),
    "user_engagements": _star(lambda s: engagement.user_engagements(s, USER_ID)),
    "user_engagements_each": _star(engagement.user_engagements),
    "user_engagements_with_defaults": _star(lambda s: engagement.user_engagements(_half_described(s))),
    "engaged_documents": _star(_engaged),
    # documents of five impressions each, so that users span several
    "user_documents_split": _split(lambda d: documents.flatten(d).drop("part")),
    "last_sessions_of_split_documents": _split(
        lambda d: documents.flatten(documents.last_sessions_of_documents(d)).drop("part")),
    "engaged_split_documents": _split(lambda d: documents.engaged(d).select("user_id").distinct()),
    "documents_second_load": _documents_twice,
    "documents_by_load": _documents_by_load,
    "documents_dropped_load": _documents_dropped,
    "validation_summary": _star(engagement.validation_summary),
    # reviews
    "null_blank_profile": _raw(null_blank_counts),
    "dropped_reviews_basic": _raw(lambda r: dropped_rows(r, reviews.CRITICAL_BASIC)),
    "clean_reviews_basic": _basic(lambda c: c),
    "clean_reviews_strict": _strict(lambda c: c),
    "product_review_summary": _basic(reviews.product_review_summary),
    "customer_review_counts": _basic(reviews.customer_review_counts),
    "monthly_product_reviews": _basic(reviews.monthly_product_reviews),
    "monthly_product_reviews_duplicates": _months_twice,
    "product_review_summary_from_files": _reviews_from_files,
    "product_review_summary_checked": _reviews_with_line_ends,
    "top_reviewed_products_all": _basic(
        lambda c: reviews.top_reviewed_products_all(reviews.product_review_summary(c))),
    "top_verified_customers_all": _basic(
        lambda c: reviews.top_verified_customers_all(reviews.customer_review_counts(c))),
    "product_summary_lookup": _basic(
        lambda c: reviews.product_summary_lookup(reviews.product_review_summary(c), PRODUCT_ID)),
    "product_monthly_trend": _basic(
        lambda c: reviews.product_monthly_trend(reviews.monthly_product_reviews(c), PRODUCT_ID)),
    "reviews_by_product_table": _strict(reviews.reviews_by_product_table),
    "reviews_by_product_rating_table": _strict(reviews.reviews_by_product_rating_table),
    "reviews_by_customer_table": _strict(reviews.reviews_by_customer_table),
    "reviews_by_product": _strict(
        lambda c: reviews.reviews_by_product(reviews.reviews_by_product_table(c), PRODUCT_ID)),
    "reviews_by_product_rating": _strict(
        lambda c: reviews.reviews_by_product_rating(reviews.reviews_by_product_rating_table(c), PRODUCT_ID, 5)),
    "reviews_by_customer": _strict(
        lambda c: reviews.reviews_by_customer(reviews.reviews_by_customer_table(c), CUSTOMER_ID)),
    "review_upsert": _review_upsert,
    "review_tables_second_load": _reviews_twice("reviews_by_product"),
    "month_tables_second_load": _reviews_twice("customer_haters_by_month"),
    "product_reviews_by_month": _strict(reviews.product_reviews_by_month),
    "customer_verified_by_month": _strict(reviews.customer_verified_by_month),
    "customer_haters_by_month": _strict(reviews.customer_haters_by_month),
    "customer_backers_by_month": _strict(reviews.customer_backers_by_month),
    "customer_classes_by_month": _strict(reviews.customer_classes_by_month),
    "top_products": _strict(lambda c: reviews.top_products(c, FIRST_MONTH, LAST_MONTH)),
    "top_customers": _strict(lambda c: reviews.top_customers(c, FIRST_MONTH, LAST_MONTH)),
    "top_haters": _strict(lambda c: reviews.top_haters(c, FIRST_MONTH, LAST_MONTH)),
    "top_backers": _strict(lambda c: reviews.top_backers(c, FIRST_MONTH, LAST_MONTH)),
    "top_products_rollup": _top_of_rollups("product_id", reviews.product_reviews_by_month),
    "top_customers_rollup": _top_of_rollups("customer_id", reviews.customer_verified_by_month),
    "top_haters_rollup": _top_of_rollups("customer_id", reviews.customer_haters_by_month),
    "top_backers_rollup": _top_of_rollups("customer_id", reviews.customer_backers_by_month),
    "top_products_of_month_table": _strict(lambda c: reviews.top_of_months(
        reviews.product_reviews_by_month(c), "product_id", FIRST_MONTH, LAST_MONTH)),
    # events
    "build_tweets": lambda spark, sf: tweets.build_tweets(data.document_reviews(spark, sf), NOW),
    "tweet_rows": lambda spark, sf: tweets.tweet_rows(data.tweet_messages(spark, sf), NOW).drop("created_ts"),
    "tweets_by_minute": lambda spark, sf: tweets.tweets_by_minute(
        tweets.tweet_rows(data.tweet_messages(spark, sf), NOW)),
    "sse_events": lambda spark, sf: page_events.sse_payloads(data.sse_chunks(spark, sf)),
    "page_create_filter": lambda spark, sf: page_events.page_create_filter(data.page_messages(spark, sf)),
    "page_creations": _page_table,
    # the same through Structured Streaming
    "stream_tweets": _stream_tweets,
    "stream_tweets_from_csv": _stream_tweets_from_csv,
    "stream_tweets_once": _stream_tweets_once,
    "stream_minute_files_restarted": _stream_minutes_restarted,
    "page_table_replayed": _page_table_replayed,
    "stream_minute_files": _stream_minutes,
    "stream_page_creations": _stream_pages,
    "page_table_new_checkpoint": _page_table_twice,
    "stream_raw_events": _stream_raw,
    "stream_raw_events_by_range": _stream_raw_ranges,
}


def write_lookups(spark: SparkSession, sf_dir: str, parts: Sequence[str] = ("ads", "reviews", "rollups")) -> str:
    """The stored tables that lookups read: the layouts of the star, the review tables and their roll-ups."""
    root, star = scratch_folder(spark, "lookups"), data.star(spark, sf_dir)
    if "ads" in parts:
        facts = reports.joined_facts(star.impressions, star.clicks)
        tables.write_sorted(facts, f"{root}/shown_by_user", ["user_id", "timestamp", "impression_id"])
        tables.write_sorted(reports.campaign_totals(star.impressions, star.clicks), f"{root}/campaign_totals", ["campaign_id"])
        for name in ("campaigns", "advertisers"):
            tables.overwrite(getattr(star, name), f"{root}/{name}")
    if "reviews" in parts:
        tables.write_review_tables(reviews.clean_strict(data.raw_reviews(spark, sf_dir)), f"{root}/reviews", "first")
    if "rollups" in parts:
        tables.write_month_rollups(spark, f"{root}/reviews", f"{root}/rollups")
    return root


def _stored_user(spark: SparkSession, root: str) -> DataFrame:
    names = {name: spark.read.parquet(f"{root}/{name}") for name in ("advertisers", "campaigns", "shown_by_user")}
    return engagement.user_engagements(
        Star(names["advertisers"], names["shown_by_user"], names["campaigns"], names["shown_by_user"], names["shown_by_user"]), USER_ID)


def _stored_top(name: str) -> Query:
    return lambda spark, root: rollups.top_of_rollup(spark, f"{root}/rollups/{name}", FIRST_MONTH, LAST_MONTH)


#: Lookups over tables that ``write_lookups`` wrote before; the bench times these alone.
LOOKUPS: dict[str, Query] = {
    "campaign_performance": lambda spark, root: reports.performance_of_totals(
        spark.read.parquet(f"{root}/campaign_totals"), CAMPAIGN_ID),
    "advertiser_total_spend": lambda spark, root: reports.advertiser_total_spend(
        spark.read.parquet(f"{root}/campaign_totals"), spark.read.parquet(f"{root}/campaigns"), ADVERTISER_ID),
    "user_engagements": _stored_user,
    "reviews_by_product": lambda spark, root: reviews.reviews_by_product(
        tables.read_review_table(spark, f"{root}/reviews", "reviews_by_product", product_id=PRODUCT_ID), PRODUCT_ID),
    "reviews_by_customer": lambda spark, root: reviews.reviews_by_customer(
        tables.read_review_table(spark, f"{root}/reviews", "reviews_by_customer", customer_id=CUSTOMER_ID), CUSTOMER_ID),
    "review_by_id": lambda spark, root: tables.read_review_table(
        spark, f"{root}/reviews", "reviews_by_product", review_id=REVIEW_ID),
    "top_products": _stored_top("product_reviews_by_month"),
    "top_customers": _stored_top("customer_verified_by_month"),
    "top_haters": _stored_top("customer_haters_by_month"),
    "top_backers": _stored_top("customer_backers_by_month"),
}


def _looked_up(name: str) -> Query:
    part = "reviews" if name.startswith("review") else "ads"
    return lambda spark, sf_dir: LOOKUPS[name](spark, write_lookups(spark, sf_dir, [part]))


# the top lists over roll-ups are registered above
REGISTRY |= {f"{name}_lookup": _looked_up(name) for name in LOOKUPS if not name.startswith("top")}

"""Command line of the jobs, for ``spark-submit``: ``cli.py <job> --option value ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tallyflow.operators.sessions import DEFAULT_TIMEOUT
from tallyflow.plans import bundles, reviews, rollups
from tallyflow.session import build_session
from tallyflow.sinks import reports, star_tables, tables, user_documents
from tallyflow.sources import captures, files, topics
from tallyflow.sources.relational import star_from_folder
from tallyflow.streaming import jobs


def load_star(spark: SparkSession, o: argparse.Namespace) -> None:
    events = files.read_events(spark, o.events, o.limit)
    star_tables.write_star(files.read_users(spark, o.users), files.read_campaigns(spark, o.campaigns), events, o.out, o.ci)


def compact_star(spark: SparkSession, o: argparse.Namespace) -> None:
    """All loads of a star as one, later clicks folded in; ``--forget`` deletes what was there before."""
    star_tables.compact_star(spark, o.out)
    if o.forget:
        star_tables.forget_older(spark, o.out)


def load_documents(spark: SparkSession, o: argparse.Namespace) -> None:
    tables.write_documents(star_from_folder(spark, o.star), o.out, o.load, o.drop_existing, timeout=o.timeout)


def update_documents(spark: SparkSession, o: argparse.Namespace) -> None:
    """Documents of the users that loads of the star since the last update touched."""
    user_documents.update_documents(spark, o.star, o.out, timeout=o.timeout)


def month_rollups(spark: SparkSession, o: argparse.Namespace) -> None:
    """Roll-ups of the month tables that ``review-tables`` wrote."""
    tables.write_month_rollups(spark, o.tables, o.out)


def top_list(spark: SparkSession, o: argparse.Namespace) -> None:
    """The top products, customers, haters or backers of a range of months, as JSON, from the roll-ups."""
    found = rollups.top_of_rollup(spark, f"{o.rollups}/{o.table}", o.start, o.end, o.n)
    reports.write_reports({o.table: found}, o.out)


def compact_table(spark: SparkSession, o: argparse.Namespace) -> None:
    """The current rows of a keyed table (pages, documents, review tables) as a new table of one load."""
    tables.compact(spark, o.table, o.key.split(","), o.out, o.descending.split(","))


def campaign_reports(spark: SparkSession, o: argparse.Namespace) -> None:
    reports.write_reports(bundles.campaign_reports(star_from_folder(spark, o.star), o.start, o.end), o.out)


def engagement_reports(spark: SparkSession, o: argparse.Namespace) -> None:
    reports.write_reports(bundles.engagement_reports(star_from_folder(spark, o.star), o.asof, o.timeout), o.out)


def review_results(spark: SparkSession, o: argparse.Namespace) -> None:
    raw = files.read_reviews(spark, o.reviews, o.sep, not o.single_line)
    options = dict(pair.split("=", 1) for pair in o.option)
    print(json.dumps(tables.checked_review_results(raw, o.out, o.format, **options)))


def review_tables(spark: SparkSession, o: argparse.Namespace) -> None:
    raw = files.read_reviews(spark, o.reviews, o.sep, not o.single_line)
    tables.write_review_tables(reviews.clean_strict(raw), o.out, o.load)


def _source(spark: SparkSession, o: argparse.Namespace):
    if o.servers:
        return topics.kafka_topic(spark, o.servers, o.source, o.starting, o.max_per_trigger)
    return topics.folder_topic(spark, o.source, o.max_per_trigger)


def _run(writer, o: argparse.Namespace) -> None:
    if o.once:
        writer = writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def _send(messages, o: argparse.Namespace) -> None:
    """Messages to a topic, with ``--once-within`` without repeats."""
    messages = jobs.once(messages, o.once_within) if o.once_within else messages
    _run(jobs.to_topic(messages, o.out, o.checkpoint, o.servers), o)


def stream_tweets(spark: SparkSession, o: argparse.Namespace) -> None:
    messages = jobs.tweet_messages(files.stream_reviews(spark, o.source, o.sep, o.max_per_trigger, not o.single_line))
    _send(messages, o)


def stream_minutes(spark: SparkSession, o: argparse.Namespace) -> None:
    _run(jobs.minute_files(_source(spark, o), o.out, o.checkpoint), o)


def stream_raw(spark: SparkSession, o: argparse.Namespace) -> None:
    """Captured event text in a folder to a topic of raw events."""
    chunks = (captures.stream_captures if o.any_line_end else files.stream_sse)(spark, o.source, max_files=o.max_per_trigger)
    _send(jobs.raw_messages(chunks), o)


def stream_pages(spark: SparkSession, o: argparse.Namespace) -> None:
    _send(jobs.page_messages(_source(spark, o)), o)


def stream_page_table(spark: SparkSession, o: argparse.Namespace) -> None:
    _run(jobs.page_table(_source(spark, o), o.out, o.checkpoint), o)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="tallyflow")
    commands = root.add_subparsers(dest="job", required=True)

    def job(run, *required: str, **optional) -> argparse.ArgumentParser:
        command = commands.add_parser(run.__name__.replace("_", "-"))
        command.set_defaults(run=run)
        for name in (*required, "out"):
            command.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            flag = f"--{name.replace('_', '-')}"
            if isinstance(default, bool):
                command.add_argument(flag, action="store_true")
            else:
                command.add_argument(flag, default=default, type=int if isinstance(default, int) else str)
        return command

    job(load_star, "users", "campaigns", "events", ci=False).add_argument("--limit", type=int)
    job(compact_star, forget=False)
    job(compact_table, "table", "key", descending="review_date")
    job(load_documents, "star", load=None, drop_existing=False, timeout=DEFAULT_TIMEOUT)
    job(update_documents, "star", timeout=DEFAULT_TIMEOUT)
    job(month_rollups, "tables")
    job(top_list, "rollups", "table", "start", "end", n=10)
    job(campaign_reports, "star", start=bundles.DEFAULT_START, end=bundles.DEFAULT_END)
    job(engagement_reports, "star", "asof", timeout=DEFAULT_TIMEOUT)
    results = job(review_results, "reviews", sep=",", format="parquet", single_line=False)
    results.add_argument("--option", action="append", default=[], help="name=value for the connector of --format")
    job(review_tables, "reviews", sep="\t", load=None, single_line=False)
    for run, starting in ((stream_tweets, None), (stream_minutes, "earliest"), (stream_raw, None),
                          (stream_pages, "latest"), (stream_page_table, "latest")):
        command = job(run, "source", "checkpoint", servers=None, starting=starting, sep=",", once=False, single_line=False,
                      once_within=None)
        command.add_argument("--max-per-trigger", type=int)
        if run is stream_raw:
            command.add_argument("--any-line-end", action="store_true", help="captures with carriage returns, read by byte ranges")
    return root


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    if getattr(options, "timeout", 1) < 1:
        raise SystemExit("--timeout must be 1 second or more")
    options.run(build_session(f"tallyflow-{options.job}"), options)


if __name__ == "__main__":
    main()

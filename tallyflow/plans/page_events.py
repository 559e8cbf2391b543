"""Page-create events: framing, filtering, and the keyed table of pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.text import strip
from tallyflow.functions.times import page_time
from tallyflow.operators.keyed import first_per_key
from tallyflow.schemas import PAGE_EVENT, PROCESSED_EVENT

# fixed values: the domains whose events pass
ALLOWED_DOMAINS = ["en.wikipedia.org", "www.wikidata.org", "commons.wikimedia.org"]

PAGE_KEY = ["domain", "created_at", "page_title", "user_id"]
EVENT_FIELDS = ["user_id", "domain", "created_at", "page_title"]

Fields = dict[str, Callable[[Column], Column]]

LINE_END = r"\r\n|\r|\n"
# a line end is taken as a whole: the two signs of one are no blank line
BLANK_LINE = rf"(?U)(?>{LINE_END})[\s&&[^\r\n]]*(?>{LINE_END})"


def sse_payloads(chunks: DataFrame) -> DataFrame:
    """JSON payloads of server-sent events held in text chunks.

    A blank line ends an event, so a chunk is any run of whole events. The
    ``data:`` lines of an event are joined with newlines; comments and other
    fields are ignored; payloads that are no JSON are dropped.
    """
    blocks = chunks.select(F.explode(F.split("value", BLANK_LINE)).alias("block"))
    lines = F.transform(F.split("block", LINE_END), strip)
    data = F.transform(
        F.filter(lines, lambda line: line.startswith("data:")),
        lambda line: F.regexp_replace(F.substr(line, F.lit(6)), r"(?U)^[\s\x1c-\x1f]+", ""),
    )
    payloads = blocks.select(F.array_join(data, "\n").alias("value")).filter("value <> ''")
    return payloads.filter(F.try_parse_json("value").isNotNull())


def _fields_of(messages: DataFrame, schema: str, keep: Callable[[Column], Column], fields: Fields) -> DataFrame:
    """The fields of JSON messages that pass ``keep``, of those messages that have them all."""
    read = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("message"))
    message = F.col("message")
    return read.filter(keep(message)).select(*[f(message).alias(name) for name, f in fields.items()]).dropna()


def page_create_filter(messages: DataFrame, domains: Sequence[str] = tuple(ALLOWED_DOMAINS)) -> DataFrame:
    """Page creations by people on the allowed domains, four complete text fields.

    An event without bot flag is dropped, like one by a bot.
    """
    return _fields_of(
        messages, PAGE_EVENT,
        lambda m: ~m["performer"]["user_is_bot"] & m["meta"]["domain"].isin(*domains),
        {
            "user_id": lambda m: m["performer"]["user_id"].cast("string"),
            "domain": lambda m: m["meta"]["domain"],
            # events of some streams have their time under the other name
            "created_at": lambda m: F.coalesce(m["created_at"], m["dt"]),
            "page_title": lambda m: m["page_title"],
        })


def page_rows(processed: DataFrame) -> DataFrame:
    """Processed messages as typed rows; incomplete ones and unreadable times are dropped."""
    fields: Fields = {name: (lambda m, name=name: m[name]) for name in EVENT_FIELDS}
    fields["created_at"] = lambda m: page_time(m["created_at"])
    return _fields_of(processed, PROCESSED_EVENT, lambda m: m.isNotNull(), fields)


def page_creations(rows: DataFrame) -> DataFrame:
    """The keyed table: one row per domain, time, title and user."""
    return first_per_key(rows.select(*PAGE_KEY), PAGE_KEY)

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.functions.text import ellipsize, split_list, squeeze
from tallyflow.plans import page_events, tweets

NOW = "2024-06-01 12:00:00"
NOW_ISO = "2024-06-01T12:00:00+00:00"


def messages(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", [
    " a \t b\n", "", "   ", "a  b　", "\x1ca\x1fb\x85c", "a​b", "plain"])
def test_squeeze_is_split_and_join(spark, text):
    assert one(spark, squeeze, text) == " ".join(text.split())


@pytest.mark.parametrize("length", [0, 279, 280, 281, 5000])
def test_ellipsis(spark, length):
    text = ("é😀x" * length)[:length]
    assert one(spark, ellipsize, text) == (text if length <= 280 else text[:277] + "...")


@pytest.mark.parametrize("text,items", [("tech, music ,,", ["tech", "music"]), ("", []), (None, []), (" , ", [])])
def test_split_list(spark, text, items):
    assert one(spark, split_list, text) == items


def test_build_tweets(spark):
    columns = "review_id string, customer_id string, review_body string, review_headline string, " \
              "review_date string, product_id string, star_rating string"
    reviews = spark.createDataFrame([
        ("r1", "c1", " long\n body ", "head", "2015-01-01", "p", "5"),
        ("r2", "", "", "head", None, None, None),
        ("r3", None, "  \n", "head", None, None, None),
        ("", None, None, None, None, "q", None),
        (None, None, None, "", None, "p", None)], columns)
    got = tweets.build_tweets(reviews, NOW).collect()
    assert [r.text for r in got] == ["long body", "head", "", "", ""]
    assert [r.user_id for r in got] == ["c1"] + ["unknown"] * 4
    assert [r.tweet_id for r in got][:3] == ["r1", "r2", "r3"]
    generated = [r.tweet_id for r in got][3:]
    assert all(g.startswith("generated-") for g in generated) and len(set(generated)) == 2
    numbered = tweets.build_tweets(reviews.limit(5), NOW, F.lit(4)).collect()
    assert numbered[3].tweet_id == "generated-4"
    assert {(r.created_at, r.review_date, r.source) for r in got} == {(NOW_ISO, NOW_ISO, "amazon_reviews")}
    assert got[0].original_review_date == "2015-01-01"
    sent = json.loads(tweets.as_messages(tweets.build_tweets(reviews, NOW)).first().value)
    assert sent["star_rating"] == "5" and list(sent)[:3] == ["tweet_id", "user_id", "text"]


@pytest.mark.parametrize("value,expected", [
    (None, NOW_ISO), ("", NOW_ISO), ("  ", NOW_ISO), ("yesterday", NOW_ISO), ([1], NOW_ISO), ({"a": 1}, NOW_ISO),
    (1700000000, "2023-11-14T22:13:20+00:00"), (1700000000.25, "2023-11-14T22:13:20.250000+00:00"),
    (-1.5, "1969-12-31T23:59:58.500000+00:00"), (0, "1970-01-01T00:00:00+00:00"), (True, "1970-01-01T00:00:01+00:00"),
    (1e18, NOW_ISO), (1e3, "1970-01-01T00:16:40+00:00"), ("1700000000", NOW_ISO), ("2024", NOW_ISO), ("12:30", NOW_ISO),
    ("2024-01-05T10:11:12Z", "2024-01-05T10:11:12+00:00"),
    ("2024-01-05T10:11:12.5+02:00", "2024-01-05T08:11:12.500000+00:00"),
    ("2024-01-05T10:11:12+0530", "2024-01-05T04:41:12+00:00"),
    (" 2024-01-05 10:11:12 ", "2024-01-05T10:11:12+00:00"), ("2024-01-05T10:11", "2024-01-05T10:11:00+00:00"),
    ("2024-01-05", "2024-01-05T00:00:00+00:00"), ("2024-1-5 3:4:5", "2024-01-05T03:04:05+00:00"),
    ("2024-1-5", "2024-01-05T00:00:00+00:00"), ("20240105T101112", "2024-01-05T10:11:12+00:00"),
    ("20240105", "2024-01-05T00:00:00+00:00"), ("2024-01-05T10:11:12 Europe/Paris", NOW_ISO),
    ("2024-02-30", NOW_ISO), ("2024-01-05T10:11:12,123456789", "2024-01-05T10:11:12.123456+00:00"),
])
def test_created_at(spark, value, expected):
    got = tweets.tweet_rows(messages(spark, {"created_at": value, "text": "t"}), NOW).first()
    assert got.created_at == expected


def test_epoch_numbers_equal_python(spark):
    numbers = [1700000000.1, 1699999999.999999, 1700000000.0000005, -12345.678901, 1e9 + 1 / 3]
    got = tweets.tweet_rows(messages(spark, *[{"created_at": n, "text": str(i)} for i, n in enumerate(numbers)]), NOW)
    found = {int(r.text): r.created_at for r in got.collect()}
    assert found == {i: datetime.fromtimestamp(n, timezone.utc).isoformat() for i, n in enumerate(numbers)}


@pytest.mark.parametrize("payload,author,text", [
    ({"author_id": "a", "user_id": "u", "text": " x \n y "}, "a", "x y"),
    ({"author_id": "", "user_id": 0, "customer_id": 7, "text": None, "review_body": "b"}, "7", "b"),
    ({"author_id": False, "user_id": True, "text": ""}, "True", ""),
    ({"author_id": [], "user_id": {}, "customer_id": 1.5, "review_body": "", "review_headline": "h"}, "1.5", "h"),
    ({"text": 5}, "", "5"), ({"text": False, "review_body": "b"}, "", "False"),
])
def test_author_and_text_fallbacks(spark, payload, author, text):
    got = tweets.tweet_rows(messages(spark, payload), NOW).first()
    assert (got.author_id, got.text) == (author, text)


def test_messages_that_are_no_objects_are_skipped(spark):
    kept = tweets.tweet_rows(messages(spark, "{}", "[1]", "5", "null", "{bad", "", '{"text": "a", "text": "b"}'), NOW)
    assert [r.text for r in kept.collect()] == ["b"]
    raw = spark.createDataFrame([(b'{"text":"ok"}',), (b'{"text":"\xff"}',)], "value binary")
    assert [r.text for r in tweets.tweet_rows(raw, NOW).collect()] == ["ok"]


def test_tweets_by_minute(spark, rows):
    at = datetime(2024, 1, 5, 10, 59, 59)
    rows_ = tweets.tweet_rows(messages(spark, *[
        {"created_at": (at + timedelta(seconds=s)).isoformat(), "text": "x"} for s in (0, 0, 1)]), NOW)
    assert rows(tweets.tweets_by_minute(rows_)) == [
        ("tweets_05_01_2024_10_59.csv", 2), ("tweets_05_01_2024_11_00.csv", 1)]


def test_sse_framing(spark):
    text = (
        ": hello\n\nevent: message\nid: 1\ndata: {\"a\":1}\n\n"
        "data: {\"b\":\ndata:  2}\nretry: 5\n  \t\ndata:{\"c\":3}\r\n\r\n"
        "data: not json\n\n\n\ndata: [4]\n: comment\n\ndata:\n\nid: 9\n\n  data: \"five\"  ")
    chunks = spark.createDataFrame([(text,)], "value string")
    got = [r.value for r in page_events.sse_payloads(chunks).collect()]
    assert got == ['{"a":1}', '{"b":\n2}', '{"c":3}', "[4]", '"five"']


def event(domain="en.wikipedia.org", bot=False, user=5, created="2024-01-01T00:00:00Z", dt="2024-01-02T00:00:00Z", title="T"):
    return {"meta": {"domain": domain, "id": "x"}, "performer": {"user_id": user, "user_is_bot": bot},
            "created_at": created, "dt": dt, "page_title": title}


def test_page_create_filter(spark, rows):
    found = page_events.page_create_filter(messages(
        spark, event(), event(created=None), event(bot=True), event(bot=None), event(domain="de.wikipedia.org"),
        event(domain=None), event(user=None), event(title=None), event(created=None, dt=None), "{bad", "[]", "{}"))
    assert rows(found) == [("5", "en.wikipedia.org", "2024-01-01T00:00:00Z", "T"),
                           ("5", "en.wikipedia.org", "2024-01-02T00:00:00Z", "T")]
    other = page_events.page_create_filter(messages(spark, event(domain="de.wikipedia.org")), ["de.wikipedia.org"])
    assert other.count() == 1


def test_page_rows_and_table(spark, rows):
    def row(created, user="5"):
        return {"user_id": user, "domain": "d", "created_at": created, "page_title": "T"}

    typed = page_events.page_rows(messages(
        spark, row("2024-01-01T00:00:00Z"), row("2024-01-01T00:00:00.000Z"), row("2024-01-01T02:00:00+02:00"),
        row("soon"), row(None), row("2024-01-01T00:00:00Z", None)))
    assert typed.count() == 3
    assert rows(page_events.page_creations(typed)) == [("d", datetime(2024, 1, 1), "T", "5")]
    assert page_events.page_creations(typed).columns == ["domain", "created_at", "page_title", "user_id"]
    assert schemas.PROCESSED_EVENT.startswith("user_id")


def test_line_ends_of_two_signs_are_no_blank_lines(spark):
    """Events over several data lines, with each kind of line end."""
    for end in ("\n", "\r", "\r\n"):
        text = end.join(["event: m", 'data: {"a": 1,', 'data: "b": 2}', "", 'data: {"a": 3}', "", ""])
        found = page_events.sse_payloads(spark.createDataFrame([(text,)], "value string"))
        assert sorted(r.value for r in found.collect()) == ['{"a": 1,\n"b": 2}', '{"a": 3}']

import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.plans import page_events, tweets
from tallyflow.sinks import commits, levels, minutes, topics
from tallyflow.sources.files import stream_reviews
from tallyflow.sources.topics import folder_topic, stored_topic
from tallyflow.streaming import jobs

NOW = "2024-06-01 12:00:00"
T0 = datetime(2024, 1, 5, 10, 0, 30)


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def send(spark, folder, *payloads):
    topics.store(spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string").coalesce(1), folder)


def tweet(seconds, text="t"):
    return {"user_id": "u", "created_at": (T0 + timedelta(seconds=seconds)).isoformat(), "text": text}


def page(number, bot=False, domain="en.wikipedia.org"):
    return {"meta": {"domain": domain}, "performer": {"user_id": number, "user_is_bot": bot},
            "created_at": "2024-01-05T10:00:00Z", "page_title": f"P{number}"}


def test_minute_files_equal_the_batch_and_take_late_rows(spark, rows, folder):
    topic, out, checkpoint = (f"{folder}/{n}" for n in ("topic", "out", "checkpoint"))

    def run():
        finish(jobs.minute_files(folder_topic(spark, topic), out, checkpoint, NOW))

    send(spark, topic, tweet(0, 'a "quoted", text'), tweet(40, "b"), {"text": ""})
    run()
    send(spark, topic, tweet(1, "late"), tweet(100, "c"))
    run()
    run()
    batch = tweets.minute_rows(tweets.tweet_rows(stored_topic(spark, topic), NOW))
    columns = ["author_id", "created_at", "text", "minute"]
    assert rows(minutes.read_minutes(spark, out).select(*columns)) == rows(batch.select(*columns))
    assert minutes.read_minutes(spark, out).filter("minute = '05_01_2024_10_00'").count() == 2
    assert sorted(n for n in os.listdir(out) if n.startswith("tweets_") and not n.endswith(".crc")) == [
        "tweets_01_06_2024_12_00.csv", "tweets_05_01_2024_10_00.csv", "tweets_05_01_2024_10_01.csv",
        "tweets_05_01_2024_10_02.csv"][4 - len(set(r.minute for r in batch.collect())):]
    text = open(f"{out}/tweets_05_01_2024_10_00.csv").read().splitlines()
    assert text[0] == "author_id,created_at,text" and len(text) == 3 and "late" in text[2]


def test_minute_files_take_each_batch_once(spark, rows, folder):
    """A batch that failed after its parts, before its marker, or in the midst of its files, and is run again."""
    def batch(*texts):
        return spark.createDataFrame([(t, "2024-01-05T10:00:00", t, m) for t, m in texts],
                                     "author_id string, created_at string, text string, minute string")

    one, two = "05_01_2024_10_00", "05_01_2024_10_01"
    minutes.add_rows(batch(("a", one), ("b", two)), folder, "q-0")
    expected = rows(minutes.read_minutes(spark, folder))
    minutes.add_rows(batch(("a", one), ("b", two)), folder, "q-0")
    assert rows(minutes.read_minutes(spark, folder)) == expected and len(expected) == 2
    # parts without the marker of a finished write
    broken = batch(("c", one)).withColumn("batch", F.lit(1))
    broken.withColumn("of", F.col("minute")).write.partitionBy("of").parquet(f"{folder}/_parts/q-1")
    os.remove(f"{folder}/_parts/q-1/_SUCCESS")
    minutes.add_rows(batch(("d", two)), folder, "r-0")
    assert [r.text for r in minutes.read_minutes(spark, folder).orderBy("text").collect()] == ["a", "b", "d"]
    # a file that was not replaced before the failure
    real, left = commits.replace, ["one file"]

    def failing(*names):
        if not left:
            raise OSError("lost")
        left.pop()
        real(*names)

    commits.replace = failing
    try:
        with pytest.raises(OSError, match="lost"):
            minutes.add_rows(batch(("c", one), ("e", two)), folder, "q-1")
    finally:
        commits.replace = real
    for _ in range(2):
        minutes.add_rows(batch(("c", one), ("e", two)), folder, "q-1")
        found = minutes.read_minutes(spark, folder).orderBy("text").collect()
        assert [(r.text, r.minute) for r in found] == [("a", one), ("b", two), ("c", one), ("d", two), ("e", two)]
    minutes.add_rows(batch(), folder, "q-2")
    assert open(f"{folder}/tweets_{one}.csv").read().count("author_id") == 1


def test_minute_files_cost_little_each(spark, rows, folder, monkeypatch):
    """Parts by hour, not by minute, and no file context (a process for each file on a local disk) to rename a file."""
    def refuse(*names):
        raise AssertionError(names)

    monkeypatch.setattr(commits, "_rename", refuse)
    minutes_ = [f"05_01_2024_{10 + h}_{m:02d}" for h in range(2) for m in range(15)]
    frame = spark.createDataFrame([(m, "2024-01-05T10:00:00", "t", m) for m in minutes_],
                                  "author_id string, created_at string, text string, minute string")
    minutes.add_rows(frame, folder, "q-0")
    minutes.add_rows(frame.filter("minute < '05_01_2024_10_03'"), folder, "q-1")
    assert len(commits.names(spark, f"{folder}/_parts/q-0/of=*")) == 2
    found = {r.minute: r["count"] for r in minutes.read_minutes(spark, folder).groupBy("minute").count().collect()}
    assert found == {m: 1 + (m < "05_01_2024_10_03") for m in minutes_}


def test_repeated_messages_arrive_once(spark, rows, folder):
    """Repeats within a batch, in a later batch and after a restart go; old content does not matter."""
    topic, out, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "c"))

    def run():
        finish(jobs.to_topic(jobs.once(folder_topic(spark, topic, 1), "1 hour"), out, checkpoint))

    send(spark, topic, page(1), page(2), page(1))
    send(spark, topic, page(2), page(3))
    run()
    send(spark, topic, page(3), {**page(4), "created_at": "1999-01-01T00:00:00Z"})
    run()
    found = [json.loads(r.value)["performer"]["user_id"] for r in stored_topic(spark, out).collect()]
    assert sorted(found) == [1, 2, 3, 4]


def test_reviews_become_tweet_messages(spark, folder):
    names = [c.split()[0] for c in schemas.REVIEWS_RAW.split(", ")]
    body = 'two\nlines, "quoted"'
    data = [tuple({"review_id": f"r{i}", "review_body": body}.get(n, n) for n in names) for i in range(5)]
    frame = spark.createDataFrame(data, schemas.REVIEWS_RAW)
    for start in (0, 2):
        frame.filter(F.col("review_id").between(f"r{start}", f"r{start + 1 + start}")).coalesce(1).write.mode(
            "append").options(header="true", escape='"').csv(f"{folder}/in")
    reviews = stream_reviews(spark, f"{folder}/in", max_files=1)
    finish(jobs.to_topic(jobs.tweet_messages(reviews), f"{folder}/topic", f"{folder}/checkpoint"))
    sent = [json.loads(r.value) for r in stored_topic(spark, f"{folder}/topic").collect()]
    assert sorted(s["tweet_id"] for s in sent) == [f"r{i}" for i in range(5)]
    assert {s["text"] for s in sent} == {'two lines, "quoted"'}
    assert all(s["created_at"] == s["review_date"] and s["original_review_date"] == "review_date" for s in sent)


def test_page_pipeline_restarts_and_replays(spark, rows, folder):
    raw, processed, table = (f"{folder}/{n}" for n in ("input", "processed", "table"))

    def run():
        finish(jobs.to_topic(jobs.page_messages(folder_topic(spark, raw)), processed, f"{folder}/c1"))
        return finish(jobs.page_table(folder_topic(spark, processed), table, f"{folder}/c2"))

    def current():
        return rows(levels.read_table(spark, table, page_events.PAGE_KEY).select(*page_events.PAGE_KEY))

    def batch():
        found = page_events.page_create_filter(stored_topic(spark, raw))
        return rows(page_events.page_creations(page_events.page_rows(tweets.as_messages(found))))

    send(spark, raw, page(1), page(2, bot=True), page(3), page(4, domain="de.wikipedia.org"))
    run()
    assert current() == batch() and len(current()) == 2
    send(spark, raw, page(1), page(5))
    run()
    assert current() == batch() and len(current()) == 3
    # a lost checkpoint sends everything again: the key keeps the table the same
    shutil.copytree(f"{folder}/processed", f"{folder}/replayed", ignore=shutil.ignore_patterns("_spark_metadata"))
    finish(jobs.page_table(folder_topic(spark, f"{folder}/replayed"), table, f"{folder}/c3"))
    assert current() == batch()


def test_empty_batches_write_nothing(spark, folder):
    send(spark, f"{folder}/in", {"user_id": None})
    finish(jobs.page_table(folder_topic(spark, f"{folder}/in"), f"{folder}/table", f"{folder}/c"))
    with pytest.raises(FileNotFoundError):
        levels.read_table(spark, f"{folder}/table", page_events.PAGE_KEY)


@pytest.mark.parametrize("here", [0, 1_000])
def test_plain_minute_files_are_those_of_sparks_writer(spark, folder, monkeypatch, here):
    """Byte for byte, with odd texts, and a hot minute over many batches; only plain files are made here."""
    monkeypatch.setattr(minutes, "RENAMES_HERE", here)
    odd = ["a", "", None, 'say "hi"', "x,y", " lead", "trail ", "two\nlines", "\\", "'", "é漢", '"', ","]
    values = [(a, "2024-01-05T10:00:00+00:00", t, f"05_01_2024_10_{(i + j) % 4:02d}") for i, a in enumerate(odd) for j, t in enumerate(odd)]
    values += [("hot", str(i), "t", "05_01_2024_11_00") for i in range(300)]
    frame = spark.createDataFrame(values, "author_id string, created_at string, text string, minute string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        for name in ("plain", "spark"):
            with monkeypatch.context() as m:
                m.setattr(minutes, "_put_local" if name == "spark" else "_put", minutes._put if name == "spark" else None)
                minutes.add_rows(frame, f"{folder}/{name}", "q-0")
                minutes.add_rows(frame.filter("author_id = 'hot'"), f"{folder}/{name}", "q-1")
            files = [f for f in os.listdir(f"{folder}/{name}") if f.startswith("tweets_")]
            found[name] = {f: open(f"{folder}/{name}/{f}", "rb").read() for f in files}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found["plain"] == found["spark"] and len(found["plain"]) == 5
    assert found["plain"]["tweets_05_01_2024_11_00.csv"].count(b"\n") == 601


def test_many_minute_files_are_read_by_few_tasks(spark, folder):
    names = [f"05_01_2024_{10 + h}_{m:02d}" for h in range(4) for m in range(60)]
    frame = spark.createDataFrame([(m, "c", "t", m) for m in names], "author_id string, created_at string, text string, minute string")
    minutes.add_rows(frame, folder, "q-0")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
        found = minutes.read_minutes(spark, folder)
        assert found.rdd.getNumPartitions() <= 15 and {r.minute for r in found.collect()} == set(names)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

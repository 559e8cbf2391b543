import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import registry
from tallyflow.plans.star import load_star
from tallyflow.session import scratch_folder
from tallyflow.sinks import commits
from tallyflow.sinks.reports import plain, write_reports
from tallyflow.sources import files

EVENT_HEADER = (
    "CampaignName,EventID,AdvertiserName,CampaignStartDate,CampaignEndDate,CampaignTargetingCriteria,"
    "CampaignTargetingInterest,CampaignTargetingCountry,AdSlotSize,UserID,Device,Location,Timestamp,BidAmount,AdCost,"
    "WasClicked,ClickTimestamp,AdRevenue,Budget,RemainingBudget"
)


def write(folder, name, *lines):
    path = os.path.join(folder, name)
    with open(path, "wb") as handle:
        handle.write("\n".join(lines).encode() if isinstance(lines[0], str) else b"\n".join(lines))
    return path


def test_advertising_files(spark, rows, folder):
    users = files.read_users(spark, write(
        folder, "users.csv", "ID,Years,Sex,Where,Likes,Since", '7,30,F,PL,"tech, music",2024-01-02', "8,NaN,M,NA,,"))
    assert rows(users) == [(7, 30, "F", "PL", "tech, music", date(2024, 1, 2)), (8, None, "M", None, None, None)]
    campaigns = files.read_campaigns(spark, write(
        folder, "campaigns.csv", "a,b,c,d,e,f,g,h,i", "1,Acme,Spring,2024-01-01,2024-02-01,Tech,s,1000,800.5"))
    assert campaigns.first().remaining_budget == Decimal("800.50")
    row = "Spring,8a32d1f9-1111-4222-8333-44444444444{},Acme,2024-01-01,2024-02-01,T,I,C,s,7,m,PL,2024-01-05 10:00:00,0.5,0.1,{},{},2.5,9,8"
    path = write(folder, "events.csv", EVENT_HEADER, row.format(1, "True", "2024-01-05 10:00:05"),
                 row.format(2, "False", ""), row.format(3, "True", "broken"))
    events = files.read_events(spark, path)
    assert events.first().Timestamp == datetime(2024, 1, 5, 10)
    assert files.read_events(spark, path, limit=2).count() == 2
    star = load_star(users, campaigns, events)
    assert star.impressions.count() == 3
    assert rows(star.clicks.select("click_timestamp")) == [(None,), (datetime(2024, 1, 5, 10, 0, 5),)]


def test_event_columns_count_by_name(spark, folder):
    names = EVENT_HEADER.split(",")
    os.mkdir(f"{folder}/events")
    write(folder, "events/a.csv", EVENT_HEADER, ",".join(f"{n}" if n == "Device" else "" for n in names))
    assert files.read_events(spark, f"{folder}/events").first().Device == "Device"
    write(folder, "events/b.csv", ",".join(reversed(names)), "," * (len(names) - 1))
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_events(spark, f"{folder}/events").collect()


def test_missing_values(spark, rows):
    df = spark.createDataFrame([("nan", float("nan")), ("x", 1.0)], "s string, d double")
    assert rows(files.missing_to_null(df)) == [(None, None), ("x", 1.0)]


def test_review_files(spark, folder):
    names = files.REVIEWS_RAW.replace(" string", "").split(", ")
    for sep in (",", "\t"):
        values = ["v"] * 12 + ['"a ""quoted"" one"', '"two\nlines"', "2015-01-01"]
        path = write(folder, f"r{ord(sep)}.csv", sep.join(names), sep.join(values))
        got = files.read_reviews(spark, path, sep).collect()
        assert [(r.review_headline, r.review_body, r.review_date) for r in got] == [
            ('a "quoted" one', "two\nlines", "2015-01-01")]


def test_undecodable_bytes_are_replaced(spark, folder):
    header = files.REVIEWS_RAW.replace(" string", "").replace(", ", ",").encode()
    path = write(folder, "r.csv", header, b",".join([b"caf\xe9"] * 15))
    assert files.read_reviews(spark, path, multi_line=False).first().marketplace == "caf�"


def test_sse_files(spark, folder):
    path = write(folder, "events.txt", "data: 1", "", "data: 2", "data: 3", "", ": end")
    assert [r.value for r in files.read_sse(spark, path).collect()] == ["data: 1", "data: 2\ndata: 3", ": end"]


def test_reports_are_plain(spark, rows, folder):
    df = spark.range(1).select(
        F.lit(Decimal("1.50")).alias("money"), F.lit(date(2024, 1, 2)).alias("day"),
        F.lit(datetime(2024, 1, 2, 3, 4, 5, 6)).alias("at"), F.lit(b"\x01\xff").alias("raw"),
        F.lit(None).cast("int").alias("none"))
    assert rows(plain(df)) == [(1.5, "2024-01-02", "2024-01-02T03:04:05.000006", "01ff", None)]
    write_reports({"one": df, "two": df.limit(0)}, folder)
    assert spark.read.text(f"{folder}/one").first()[0] == (
        '{"money":1.5,"day":"2024-01-02","at":"2024-01-02T03:04:05.000006","raw":"01ff","none":null}')


def test_scratch_folder_is_below_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_folder(spark, "a"), scratch_folder(spark, "a")
    assert first != second
    assert first.startswith(root or "/tmp/run-")


def test_one_file_is_written_out_of_many_tasks(spark, folder):
    registry.one_file(spark.range(0, 40, 1, 4).select(F.spark_partition_id().alias("task")), folder + "/one")
    assert len(commits.names(spark, f"{folder}/one/part-*")) == 1
    assert spark.read.option("header", "true").csv(f"{folder}/one").distinct().count() == 4

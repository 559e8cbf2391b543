"""Levelled keyed tables, documents by load, month roll-ups, quoted line ends and observed checks."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.operators.profile import Watched, dropped_rows, null_blank_counts
from tallyflow.plans import documents, rollups
from tallyflow.plans.reviews import top_of_months
from tallyflow.sinks import commits, levels, user_documents
from tallyflow.sinks.star_tables import compact_star, read_star_table, write_star
from tallyflow.sources.quoted_csv import csv_records, read_quoted_csv
from tallyflow.sources.relational import star_from_folder
from test_keyed import raw_frames


def test_levels_stay_small_and_the_newest_row_wins(spark, folder):
    pick, expected = random.Random(1), {}
    for n in range(30):
        rows = {pick.randrange(12): f"v{n}" for _ in range(4)}
        expected |= rows
        load = spark.createDataFrame(list(rows.items()), "k int, v string").coalesce(1)
        assert levels.add_load(load, folder, ["k"], ("query", n), fan=3)
        assert not levels.add_load(load.withColumn("v", F.lit("again")), folder, ["k"], ("query", n), fan=3)
        held = levels.folders(spark, folder)
        assert len(held) <= 2 * 4 and [f["level"] for f in held] == sorted((f["level"] for f in held), reverse=True)
        if n % 7 == 0:
            assert dict(levels.read_table(spark, folder, ["k"]).collect()) == expected
    assert dict(levels.read_table(spark, folder, ["k"]).collect()) == expected
    # what merges replaced goes after a while
    assert len(commits.names(spark, f"{folder}/load-*")) < 30


def test_a_reader_keeps_its_state_over_a_merge(spark, folder):
    for n in range(2):
        levels.add_load(spark.createDataFrame([(1, n)], "k int, v int"), folder, ["k"], ("q", n), fan=3)
    before = levels.read_table(spark, folder, ["k"])
    levels.add_load(spark.createDataFrame([(1, 9)], "k int, v int"), folder, ["k"], ("q", 2), fan=3)
    assert len(levels.folders(spark, folder)) == 1
    assert before.first().v == 1 and levels.read_table(spark, folder, ["k"]).first().v == 9
    assert "Aggregate" not in levels.read_table(spark, folder, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_a_load_that_fails_is_not_there(spark, folder):
    levels.add_load(spark.createDataFrame([(1, 1)], "k int, v int"), folder, ["k"], ("q", 0))
    bad = spark.createDataFrame([(1, 2)], "k int, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        levels.add_load(bad, folder, ["k"], ("q", 1))
    assert levels.read_table(spark, folder, ["k"]).first().v == 1
    assert levels.add_load(spark.createDataFrame([(1, 3)], "k int, v int"), folder, ["k"], ("q", 1))
    assert levels.read_table(spark, folder, ["k"]).first().v == 3


def flat(spark, rows, path):
    return rows(documents.flatten(user_documents.read_documents(spark, path)))


def test_only_touched_documents_are_built_again(spark, rows, folder):
    users, campaigns, events = raw_frames(spark)
    star, table = f"{folder}/star", f"{folder}/table"
    write_star(users, campaigns, events.filter("UserID = 1").withColumn("WasClicked", F.lit(False)), star)
    assert user_documents.update_documents(spark, star, table) == 0
    # a new impression of user 2 only
    write_star(users, campaigns, events.filter("UserID = 2").withColumn("EventID", F.regexp_replace("EventID", ".$", "8")), star)
    user_documents.update_documents(spark, star, table)
    assert [r.user_id for r in spark.read.parquet(f"{table}/{levels.folders(spark, table)[-1]['folder']}").collect()] == [2]
    # a late click of user 1, and nothing for user 2
    write_star(users, campaigns, events.filter("EventID LIKE '%1'"), star)
    user_documents.update_documents(spark, star, table)
    assert [r.user_id for r in spark.read.parquet(f"{table}/{levels.folders(spark, table)[-1]['folder']}").collect()] == [1]
    whole = documents.user_documents(star_from_folder(spark, star))
    assert flat(spark, rows, table) == rows(documents.flatten(whole))
    assert rows(user_documents.read_documents(spark, table).select("user_id")) == rows(whole.select("user_id"))
    before = len(levels.folders(spark, table))
    user_documents.update_documents(spark, star, table)
    assert len(levels.folders(spark, table)) == before
    # a fold of what was seen touches nobody; one with a load that was not seen builds all
    compact_star(spark, star)
    user_documents.update_documents(spark, star, table)
    assert flat(spark, rows, table) == rows(documents.flatten(whole))
    write_star(users, campaigns, events, star)
    compact_star(spark, star)
    user_documents.update_documents(spark, star, table)
    assert flat(spark, rows, table) == rows(documents.flatten(documents.user_documents(star_from_folder(spark, star))))
    assert read_star_table(spark, star, "shown").count() == read_star_table(spark, star, "impressions").count()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(-20, 400), st.integers(1, 9))
def test_blocks_cover_a_range_once(first, length, depth):
    name = lambda m: f"{2000 + m // 12:04d}-{m % 12 + 1:02d}"
    blocks = rollups.cover(name(first), name(max(0, first + length)), depth)
    months = [m for level, block in blocks for m in range(block << level, (block + 1) << level)]
    assert sorted(months) == list(range(24000 + first, 24000 + max(0, first + length) + 1))
    for level in range(depth - 1):
        assert sum(k == level for k, _ in blocks) <= 2


def test_rolled_up_top_lists(spark, rows, folder):
    pick = random.Random(2)
    months = spark.createDataFrame(
        [(f"{pick.randrange(1999, 2004)}-{pick.randrange(1, 13):02d}", f"p{pick.randrange(20)}", pick.randrange(1, 4)) for _ in range(300)],
        "year_month string, product_id string, review_count int")
    rollups.write_rollup(months, "product_id", folder)
    for start, end in (("1999-01", "2003-12"), ("2000-03", "2000-03"), ("1999-11", "2002-02"), ("2003-01", "2002-01"), ("1990-01", "2030-01")):
        expected = top_of_months(months, "product_id", start, end)
        assert rollups.top_of_rollup(spark, folder, start, end).collect() == expected.collect()
    plan = rollups.top_of_rollup(spark, folder, "1999-11", "2002-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


@pytest.mark.parametrize("seed", range(5))
def test_quoted_line_ends_over_byte_ranges(spark, rows, folder, seed):
    """Files cut into ranges of a few hundred bytes give the rows that one task per file gives."""
    pick = random.Random(seed)
    for f in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"]), quoting=pick.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        writer.writerow("abc")
        for _ in range(pick.randint(0, 50)):
            writer.writerow(["".join(pick.choice(["x", '"', "\n", ",", "é", " ", "yy", "\n\n", "\r\n"]) for _ in range(pick.randint(
                1, pick.choice([5, 5, 300])))) for _ in range(3)])
        with open(f"{folder}/{f}.csv", "w", newline="") as file:
            file.write(out.getvalue())
    schema, small = "a string, b string, c string", {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = read_quoted_csv(spark, folder, schema)
        assert csv_records(spark, folder).rdd.getNumPartitions() > 4
        whole = spark.read.options(header="true", quote='"', escape='"', multiLine="true").schema(schema).csv(folder)
        assert rows(found) == rows(whole)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_checks_come_from_the_pass_that_loads(spark, rows):
    raw = spark.createDataFrame([("a", " "), (None, "x"), ("b", "y"), ("", None)], "k string, v string")
    watched = Watched(["k"])
    assert watched.rows(raw).filter("k = 'b'").count() == 1
    found = watched.counts()
    assert {c: found[f"empty_{c}"] for c in raw.columns} == null_blank_counts(raw).first().asDict()
    assert {c: found[c] for c in ("raw_rows", "kept_rows", "dropped_rows")} == dropped_rows(raw, ["k"]).first().asDict()

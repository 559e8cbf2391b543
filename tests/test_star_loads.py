"""Loads of the star that fail, repeat, and bring clicks of impressions stored before."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyflow.plans import reports
from tallyflow.plans.star import fact_clicks, fact_impressions, load_clicks, load_facts, load_impressions, load_star
from tallyflow.sinks import commits, star_tables
from tallyflow.sinks.star_tables import compact_star, forget_older, read_star_table, write_star
from tallyflow.sources.relational import star_from_folder
from test_keyed import plan_of, raw_frames

TABLES = ("advertisers", "users", "campaigns", "impressions", "clicks", "shown", "shown_by_user", "campaign_totals")


class Crash(Exception):
    pass


def stop_after(last):
    def written(name):
        if name == last:
            raise Crash(name)

    return written


def content(spark, rows, root):
    return {name: rows(read_star_table(spark, root, name)) for name in TABLES}


@pytest.mark.parametrize("last", TABLES)
def test_a_failed_load_changes_nothing_and_repeats(spark, rows, folder, last):
    frames, star = raw_frames(spark), f"{folder}/star"
    with pytest.raises(Crash):
        write_star(*frames, star, written=stop_after(last))
    with pytest.raises(FileNotFoundError):
        read_star_table(spark, star, "shown")
    write_star(*frames, star)
    write_star(*frames, f"{folder}/clean")
    expected = content(spark, rows, f"{folder}/clean")
    assert content(spark, rows, star) == expected
    with pytest.raises(Crash):
        write_star(*frames, star, written=stop_after(last))
    assert content(spark, rows, star) == expected
    write_star(*frames, star)
    assert content(spark, rows, star) == expected


@pytest.mark.parametrize("last", ["late", "shown", "clicks"])
def test_late_clicks(spark, rows, folder, last):
    """Clicks of known impressions come in a second load that first fails; all layouts have them, folded or not."""
    users, campaigns, events = raw_frames(spark)
    star = f"{folder}/star"
    first = events.filter("EventID NOT LIKE '%5'").withColumn("WasClicked", F.lit(False))
    write_star(users, campaigns, first, star)
    assert read_star_table(spark, star, "clicks").count() == 0
    with pytest.raises(Crash):
        write_star(users, campaigns, events, star, written=stop_after(last))
    assert read_star_table(spark, star, "clicks").count() == 0
    write_star(users, campaigns, events, star)
    whole = load_star(users, campaigns, events)
    expected = rows(reports.joined_facts(whole.impressions, whole.clicks))
    totals = rows(reports.campaign_performance(whole.impressions, whole.clicks))

    def check():
        assert rows(read_star_table(spark, star, "clicks")) == rows(whole.clicks)
        assert rows(read_star_table(spark, star, "impressions")) == rows(whole.impressions)
        for layout in ("shown", "shown_by_user"):
            assert rows(read_star_table(spark, star, layout).select(*reports.joined_facts(whole.impressions, whole.clicks).columns)) == expected
        assert rows(reports.performance_of_totals(read_star_table(spark, star, "campaign_totals"))) == totals

    check()
    # an impression has one click: what comes for it later is ignored
    again = events.withColumn("ClickTimestamp", F.lit("2024-12-31 00:00:00")).withColumn("WasClicked", F.lit(True))
    write_star(users, campaigns, again.filter("EventID LIKE '%1'"), star)
    check()
    compact_star(spark, star)
    check()
    forget_older(spark, star)
    check()
    assert len(commits.names(spark, f"{star}/shown/load-*")) == 1 and commits.names(spark, f"{star}/late/load-*") == []


def test_filters_reach_stored_and_late_rows(spark, folder):
    users, campaigns, events = raw_frames(spark)
    write_star(users, campaigns, events.withColumn("WasClicked", F.lit(False)), folder)
    write_star(users, campaigns, events, folder)
    shown = star_from_folder(spark, folder).impressions.filter(F.col("timestamp") >= F.lit(datetime(2024, 10, 5)))
    assert plan_of(shown).count("GreaterThanOrEqual(timestamp") == 2


def test_two_loads_at_once(spark, folder):
    """The second of two loads that began together fails, and changes nothing."""
    frames = raw_frames(spark)

    def other(name):
        if name == "clicks":
            write_star(*frames, folder)

    with pytest.raises(RuntimeError, match="run this one again"):
        write_star(*frames, folder, written=other)
    assert read_star_table(spark, folder, "shown").count() == 4
    write_star(*frames, folder)
    assert read_star_table(spark, folder, "shown").count() == 4


def test_documents_by_load_put_their_events_together_once(spark, folder, monkeypatch):
    """Both loads read stored events, not the tables these are made from; a repeated event stays repeated."""
    from checks import registry

    frames = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NATION_0", 0)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(1, "Supplier#1", 0, 5.0), (2, "Supplier#2", 0, None)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(i, f"c{i}", 0, 1.0, "AUTO") for i in (1, 2, 3)]),
        "events": ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", [
            (i, datetime(2024, 1, day, 10, 0, i), user, kind, 1.5, '{"k": 1}') for i, day, user, kind in
            ((1, 5, 1, "click"), (2, 5, 2, "view"), (3, 31, 3, "click"), (3, 31, 3, "click"), (4, 31, 2, "click"))]
            + [(5, None, 1, "view", None, '{"k": 2}'), (None, datetime(2024, 1, 6), 1, "click", 1.0, '{"k": 2}')]),
    }
    for name, (schema, values) in frames.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    read, counts = [], []
    write = registry.star_tables.write_star

    def watched(users, campaigns, events, root):
        read.append(events.inputFiles())
        counts.append(events.count())
        return write(users, campaigns, events, root)

    monkeypatch.setattr(registry.star_tables, "write_star", watched)
    found = registry.REGISTRY["documents_by_load"](spark, folder)
    assert sorted(r.impression_id[-1] for r in found.collect()) == ["1", "2", "3", "4", "5"]
    assert len(read) == 2 and not any(folder in name for names in read for name in names)
    # the repeated click meets itself twice; the first load takes the events before its time
    made = registry.data.star_events(spark, folder)
    assert counts == [made.filter(made.Timestamp < registry.ASOF).count(), made.count()]


def order_tables(spark, folder):
    """Tables of a few order lines: repeated ones, one without a key, and orders of unknown customers."""
    frames = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NATION_0", 0)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
                     [(1, "Supplier#000000001", 0, 5.0), (2, "Supplier#000000002", 0, None)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(i, f"c{i}", 0, 1.0, "AUTO") for i in range(1, 5)]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                   "o_orderpriority string", [(i, i, "O", 1.0, datetime(2024, 1, 1), "1-URGENT") for i in range(1, 7)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(order, 1, 1 + line % 3, line, 3.0, 1.0, 0.1, 0.2, flag, "O", datetime(2024, 1, 5, 10, 0, line))
                      for order, line, flag in [(o, n, "R" if n % 2 else "N") for o in range(1, 7) for n in (1, 2, 7)] + [(1, 1, "N"), (2, 2, "R")]]
                     + [(1, 1, 1, None, 3.0, 1.0, 0.1, 0.2, "R", "O", None)]),
        "events": ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", []),
    }
    for name, (schema, values) in frames.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")


def test_loads_after_a_crash_put_their_events_together_once(spark, rows, folder, monkeypatch):
    """Each of the loads reads stored events; all tables agree with one load of everything."""
    from checks import registry

    order_tables(spark, folder)
    read = []
    write = registry.star_tables.write_star

    def watched(users, campaigns, events, root, written):
        read.append((events.inputFiles(), events.count()))
        return write(users, campaigns, events, root, written=written)

    monkeypatch.setattr(registry.star_tables, "write_star", watched)
    found = rows(registry.REGISTRY["load_star_after_crash"](spark, folder))
    assert len(read) == 5 and not any(folder in name for names, _ in read for name in names)
    raw = [f(spark, folder) for f in (registry.data.raw_users, registry.data.raw_campaigns, registry.data.raw_events)]
    assert [n for _, n in read][3:] == [raw[2].count()] * 2
    whole = load_star(*raw)
    expected = reports.performance_of_totals(reports.campaign_totals(whole.impressions, whole.clicks))
    for source in ("tables", "shown", "by_user", "totals"):
        assert [r[:-1] for r in found if r[-1] == source] == rows(expected)


def test_load_from_files_reads_compressed_files(spark, rows, folder, monkeypatch):
    from checks import registry

    order_tables(spark, folder)
    monkeypatch.setattr(registry, "scratch_folder", lambda spark, name: f"{folder}/{name}")
    found = rows(registry.REGISTRY["load_star_from_files"](spark, folder))
    written = commits.names(spark, f"{folder}/files/events/part-*")
    assert written and all(name.endswith(".csv.snappy") for name in written)
    whole = load_star(*[f(spark, folder) for f in (registry.data.raw_users, registry.data.raw_campaigns, registry.data.raw_events)])
    assert found == rows(whole.impressions)


@pytest.mark.parametrize("last", ["shown", None])
def test_a_load_leaves_no_scratch_tables(spark, folder, monkeypatch, last):
    monkeypatch.setattr(star_tables, "scratch_folder", lambda spark, name: f"{folder}/{name}")
    seen = []

    def written(name):
        seen.append(commits.exists(spark, f"{folder}/facts"))
        stop_after(last)(name)

    try:
        write_star(*raw_frames(spark), f"{folder}/star", written=written)
    except Crash:
        assert last
    assert any(seen) and not commits.exists(spark, f"{folder}/facts")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_ids_of_events_are_worked_out_once(spark, rows, folder):
    users, campaigns, events = raw_frames(spark)
    odd = events.limit(1)
    for text in (None, "no id", "urn:uuid:8a32d1f9-0000-4000-8000-000000000001", "{8A32D1F9-0000-4000-8000-000000000009}"):
        events = events.unionByName(odd.withColumn("EventID", F.lit(text).cast("string")))
    events.write.parquet(f"{folder}/events")
    stored = spark.read.parquet(f"{folder}/events")
    parents = load_star(users, campaigns, events)
    facts = load_facts(stored, parents.campaigns, parents.users)
    plan = plan_of(facts)
    assert plan[:plan.index("FileScan")].count("unhex(") == 1
    assert rows(fact_impressions(facts)) == rows(load_impressions(events, parents.campaigns, parents.users))
    assert rows(fact_clicks(facts)) == rows(load_clicks(events, parents.impressions))
    known = parents.impressions.withColumn("click_id", F.lit(None).cast("string"))
    late = load_facts(stored, parents.campaigns, parents.users, existing=known)
    assert rows(late.select("impression_id")) == rows(parents.clicks.select("impression_id"))

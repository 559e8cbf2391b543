import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.operators.sessions import assign_sessions, last_labels, session_labels, session_summary
from tallyflow.plans import documents, engagement
from tallyflow.plans.bundles import campaign_reports, engagement_reports
from tallyflow.sinks.reports import write_reports
from tallyflow.sinks.tables import read_documents, write_documents
from tests.sample import T0, click, hand_sample, impression, make_star

EPOCH = datetime(1970, 1, 1)


def sessions_by_hand(times, timeout):
    """Sessions of one user row by row: lists of times, in the order of their start."""
    found, last = [], None
    for i, at in enumerate(sorted(times, key=lambda t: (t is not None, t))):
        if i == 0 or (at and last and (at - last).total_seconds() > timeout):
            found.append([])
        found[-1].append(at)
        last = at
    return sorted(found, key=lambda s: s[0] or EPOCH)


def frame(spark, times, user=1):
    data = [(user, f"{i:04d}", t) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "user_id int, impression_id string, timestamp timestamp")


def summary(spark, times, timeout=1800):
    found = session_summary(session_labels(frame(spark, times), timeout))
    return [(r.session_start, r.n_impressions) for r in found.orderBy("session_seq").collect()]


@pytest.mark.parametrize("gap,expected", [
    (timedelta(seconds=1800), 1), (timedelta(seconds=1800, microseconds=1), 2), (timedelta(0), 1)])
def test_gap_must_exceed_the_timeout(spark, gap, expected):
    assert len(summary(spark, [T0, T0 + gap])) == expected


def test_missing_time_comes_first_and_opens_nothing(spark):
    late = T0 + timedelta(hours=2)
    assert summary(spark, [T0, None, late, None]) == [(None, 3), (late, 1)]
    assert summary(spark, [None, None]) == [(None, 2)]


def test_session_without_start_sorts_as_the_epoch(spark):
    old = [datetime(1960, 1, 1), datetime(1965, 1, 1), T0]
    assert summary(spark, [None, *old]) == [(old[1], 1), (None, 2), (T0, 1)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-4000, 4000)), min_size=1, max_size=40), st.sampled_from([0, 1, 7, 60]))
def test_slices_equal_row_by_row_sessions(spark, offsets, timeout):
    times = [None if o is None else EPOCH + timedelta(seconds=o / 2) for o in offsets]
    expected = [(s[0], len(s)) for s in sessions_by_hand(times, timeout)]
    assert summary(spark, times, timeout) == expected


def test_rows_get_the_session_of_their_slice(spark):
    source = random.Random(7)
    times = [T0 + timedelta(seconds=source.randrange(200_000)) for _ in range(300)]
    labels = session_labels(frame(spark, times), 1800)
    got = {}
    for r in assign_sessions(frame(spark, times), labels, 1800).collect():
        got.setdefault(r.session_seq, []).append(r.timestamp)
    expected = {i + 1: s for i, s in enumerate(sessions_by_hand(times, 1800))}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_last_sessions_keep_all_where_there_are_fewer(spark):
    few = frame(spark, [T0, T0 + timedelta(hours=1)], 1)
    many = frame(spark, [T0 + timedelta(hours=i) for i in range(9)], 2)
    kept = last_labels(session_labels(few.unionByName(many)), 5).groupBy("user_id").agg(F.collect_set("session_seq"))
    assert {r[0]: sorted(r[1]) for r in kept.collect()} == {1: [1, 2], 2: [5, 6, 7, 8, 9]}


def test_hand_sample_is_one_session(spark, rows):
    s = hand_sample(spark)
    assert rows(engagement.user_sessions(s.impressions, s.clicks)) == [(1000, 1, T0, 2, 1)]
    kinds = [r.engagement_type for r in engagement.user_engagements(s, 1000).collect()]
    assert kinds == ["click", "impression"]


def busy_star(spark, n=400):
    """One user holds most impressions, many of them at one moment; another has none."""
    source = random.Random(3)
    times = [T0 if i % 3 == 0 else T0 + timedelta(seconds=source.randrange(400_000)) for i in range(n)]
    shown = [impression(i, user=1000 if i % 8 else 1001, at=t) for i, t in enumerate(times)]
    return make_star(spark, shown, [click(i, T0) for i in range(0, n, 5)], users=(1000, 1001, 1002))


def test_documents_hold_everything_in_order(spark):
    s = busy_star(spark)
    docs = {r.user_id: r for r in documents.user_documents(s).collect()}
    assert set(docs) == {1000, 1001, 1002}
    assert docs[1002].sessions == [] and docs[1002].part == 0
    assert docs[1000].demographics.interests == ["tech", "music"]
    assert docs[1000].signup_date == datetime(2024, 1, 2)
    shown = {}
    for r in s.impressions.collect():
        shown.setdefault(r.user_id, []).append(r.timestamp)
    clicked = {r.impression_id for r in s.clicks.collect()}
    for user in (1000, 1001):
        expected = [sorted(x) for x in sessions_by_hand(shown[user], 1800)]
        assert [[i.timestamp for i in x.impressions] for x in docs[user].sessions] == expected
        assert [x.session_start for x in docs[user].sessions] == [x[0] for x in expected]
        for session in docs[user].sessions:
            order = [(i.timestamp, i.impression_id) for i in session.impressions]
            assert order == sorted(order)
            assert session.session_date == session.session_start.date()
            assert all((i.click is not None) == (i.impression_id in clicked) for i in session.impressions)


def test_busy_users_continue_in_further_documents(spark, rows):
    s = busy_star(spark)
    whole, split = documents.user_documents(s), documents.user_documents(s, per_document=20)
    sizes = documents.flatten(split).groupBy("user_id", "part").count().collect()
    assert max(r["count"] for r in sizes) <= 60
    assert len([r for r in sizes if r.user_id == 1000]) > 5
    assert rows(documents.flatten(split).drop("part")) == rows(documents.flatten(whole).drop("part"))
    assert split.filter("user_id = 1002").count() == 1
    assert split.groupBy("user_id", "part").count().filter("count > 1").count() == 0


def test_documents_are_replaced_as_a_whole(spark, rows, folder):
    before, after = busy_star(spark), hand_sample(spark)
    write_documents(before, folder, drop_existing=True, per_document=20)
    write_documents(after, folder)
    current = read_documents(spark, folder)
    assert current.filter("user_id = 1000").count() == 1
    assert rows(documents.flatten(current.filter("user_id = 1000"))) == rows(documents.flatten(documents.user_documents(after)))
    old = documents.flatten(documents.user_documents(before, per_document=20))
    assert rows(documents.flatten(current.filter("user_id = 1001"))) == rows(old.filter("user_id = 1001"))
    write_documents(after, folder, drop_existing=True)
    assert read_documents(spark, folder).count() == 1


def test_report_bundles(spark, rows, folder):
    s = hand_sample(spark)
    campaign = campaign_reports(s)
    assert len(campaign) == 7 and campaign["device_performance"].count() == 1
    bundle = engagement_reports(s, "2024-10-06 00:00:00")
    assert rows(bundle["real_time_targeting"]) == [("Tech", 1)]
    assert bundle["hourly_performance"].count() == 1
    write_reports(bundle, folder)
    assert spark.read.json(f"{folder}/user_interaction_history").first().user_id == 1000
    assert engagement_reports(make_star(spark, [impression(1)]), "2024-10-06 00:00:00") == {}


@pytest.mark.parametrize("per_document", [20_000, 20])
def test_document_reads_over_all_parts(spark, rows, per_document):
    s = busy_star(spark)
    docs = documents.user_documents(s, per_document=per_document)
    one = documents.user_history(documents.user_documents(s, user_id=1001), 1001).collect()
    assert {r.user_id for r in one} == {1001}
    assert {r.user_id for r in documents.engaged(docs).collect()} == {1000, 1001}
    flat = documents.flatten(documents.last_sessions_of_documents(docs, 5))
    keys = ["user_id", "session_seq", "impression_id", "click_timestamp"]
    assert rows(flat.select(*keys)) == rows(engagement.last_sessions(s).select(*keys))
    assert rows(documents.last_sessions_of_documents(docs, 10_000)) == rows(docs)


def test_sessions_need_no_shuffle_of_unaggregated_rows(spark):
    s = busy_star(spark)
    plan = session_labels(s.impressions)._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "partial_min(timestamp" in plan[first_exchange:]

"""The star as stored tables: loads that are there as a whole or not at all, and clicks that come later.

Eight tables belong together: the five of the star, the impressions joined with their clicks laid out by
time (``shown``) and by user (``shown_by_user``), and ``campaign_totals``. A load adds a folder to each
and commits all of them at once (see ``commits``).

A click of an impression that an earlier load stored is written to ``late`` as the impression's whole new
row. Readers leave out the older row and take this one; ``compact_star`` folds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.plans.reports import CLICK_COLUMNS, campaign_totals
from tallyflow.plans.star import Star, fact_rows, late_rows, load_star
from tallyflow.session import scratch_folder, shuffles_freed
from tallyflow.sinks import commits

STAR = ("advertisers", "users", "campaigns", "impressions", "clicks")
SHOWN = {"shown": ["timestamp", "impression_id"], "shown_by_user": ["user_id", "timestamp", "impression_id"]}


def by_range(df: DataFrame, order: list[str]) -> DataFrame:
    columns = [F.asc(c) for c in order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _read(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{name}/{folder}" for folder in folders])


def read_star_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The committed rows of one of the eight tables.

    Both layouts of ``shown`` take later clicks into account: filters on their columns reach the stored
    rows and the later ones alike, and only ids of later ones meet the stored rows.
    """
    _, state = commits.latest(spark, root)
    if not state:
        raise FileNotFoundError(f"{root} holds no finished load")
    return _current(spark, root, name, state)


def _current(spark: SparkSession, root: str, name: str, state: dict) -> DataFrame:
    rows = _read(spark, root, name, state["loads"])
    if name not in SHOWN or not state["late"]:
        return rows
    late = _read(spark, root, "late", state["late"])
    ids = late.select("impression_id")
    return rows.join(ids, "impression_id", "left_anti").select(*rows.columns).unionByName(late.select(*rows.columns))


def _impressions_of(shown: DataFrame, columns: list[str]) -> DataFrame:
    """The impressions of a written ``shown``, whose ranges of time they keep without moving again."""
    return shown.select(*columns).sortWithinPartitions(*SHOWN["shown"])


def write_star(
    users_raw: DataFrame, campaigns_raw: DataFrame, events_raw: DataFrame, root: str, ci: bool = False,
    written: Callable[[str], None] = lambda name: None,
) -> Star:
    """Load the five star tables, parents first, into what is there: rows whose key is stored already are skipped.

    Children check their keys against the written parents. A clicked event of a stored impression that
    has no click yet adds its click. A load that fails at any point changes nothing, and can be run
    again; so can one that did not fail, as all its keys are known then. ``written`` is called with the
    name of each table after it is written, before the commit.
    """
    spark = users_raw.sparkSession
    number, state = commits.latest(spark, root)
    folder, older = commits.new_folder(number + 1), state.get("loads", [])
    there = {name: _current(spark, root, name, state) for name in (*STAR, "shown") if state}
    facts = scratch_folder(spark, "facts")
    late: list[str] = list(state.get("late", []))

    def add(df: DataFrame, name: str, write_to: str = "") -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{write_to or name}/{folder}")
        written(write_to or name)
        return _read(spark, root, name, [*older, folder]) if not write_to else df

    def store(df: DataFrame, name: str) -> DataFrame:
        if name == "impressions":
            df = _impressions_of(_read(spark, root, "shown", [folder]), df.columns)
        if name != "facts":
            return add(df, name)
        df.write.parquet(facts)
        kept = spark.read.schema(df.schema).parquet(facts)
        rows = fact_rows(kept)
        totals = campaign_totals(rows, rows)
        if state and not late_rows(kept).isEmpty():
            columns = [c for c in there["shown"].columns if c not in CLICK_COLUMNS]
            changed = there["shown"].select(*columns).join(late_rows(kept), "impression_id").select(*columns, *CLICK_COLUMNS)
            add(changed, "shown", "late")
            late.append(folder)
            changed = _read(spark, root, "late", [folder])
            more = changed.groupBy("campaign_id").agg(F.count("click_id").alias("clicks"))
            totals = totals.unionByName(more.select("campaign_id", F.lit(0).cast("long").alias("impressions"), "clicks", F.lit(0).cast(
                totals.schema["cost_paid"].dataType).alias("cost_paid")))
        for layout, order in SHOWN.items():
            add(by_range(rows, order), layout)
        add(by_range(totals, ["campaign_id"]), "campaign_totals")
        return kept

    try:
        with shuffles_freed(spark):
            star = load_star(users_raw, campaigns_raw, events_raw, ci, store, there)
        commits.commit(spark, root, number + 1, {**state, "loads": [*older, folder], "late": late})
    finally:
        # both fact tables are written out of it, or the load is run again
        commits.remove(spark, facts)
    return star


def compact_star(spark: SparkSession, root: str) -> None:
    """Write every table as one load with later clicks folded in, and switch to it at once.

    Older folders stay for readers that began before; ``forget_older`` removes them.
    """
    number, state = commits.latest(spark, root)
    if not state:
        raise FileNotFoundError(f"{root} holds no finished load")
    folder = commits.new_folder(number + 1)
    # later clicks are folded in once, into ``shown``; its other layout and the impressions are made from it
    for name in ("shown", *[n for n in (*STAR, *SHOWN) if n != "shown"], "campaign_totals"):
        rows = _current(spark, root, name, state) if name not in ("shown_by_user", "impressions") else _read(spark, root, "shown", [folder])
        if name == "impressions":
            _impressions_of(rows, _read(spark, root, name, state["loads"]).columns).write.parquet(f"{root}/{name}/{folder}")
            continue
        if name == "campaign_totals":
            rows = rows.groupBy("campaign_id").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "campaign_id"])
        order = {"campaign_totals": ["campaign_id"], **SHOWN}.get(name)
        (by_range(rows, order) if order else rows).write.parquet(f"{root}/{name}/{folder}")
    commits.commit(spark, root, number + 1, {"loads": [folder], "late": [], "folded": number})


def forget_older(spark: SparkSession, root: str) -> None:
    """Delete the folders that the newest commit does not name, those of failed loads included. No load may run meanwhile."""
    _, state = commits.latest(spark, root)
    kept = {*state["loads"], *state["late"]}
    for name in (*STAR, *SHOWN, "campaign_totals", "late"):
        for folder in commits.names(spark, f"{root}/{name}/load-*"):
            if folder not in kept:
                commits.remove(spark, f"{root}/{name}/{folder}")

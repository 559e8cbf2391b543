"""User documents kept up to date with a stored star: a load rebuilds the documents of the users it touched."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tallyflow.plans.documents import user_documents
from tallyflow.sinks import commits, levels
from tallyflow.sources.relational import star_from_folder

KEY = ["user_id"]


def touched_users(spark: SparkSession, star_root: str, since: int) -> DataFrame | None:
    """Users with rows in the loads of a star after commit ``since``; None when loads were folded since then."""
    _, state = commits.latest(spark, star_root)
    folded = state.get("folded", -1)
    if since < folded:
        return None

    def new(folders: list[str]) -> list[str]:
        # a folder carries the number of its commit; that of a fold comes right after what it folded
        return [f for f in folders if int(f.split("-")[1]) > max(since, folded + 1 if folded >= 0 else -1)]

    tables = {"users": state["loads"], "shown_by_user": state["loads"], "late": state["late"]}
    frames = [spark.read.parquet(f"{star_root}/{name}/{f}").select("user_id") for name, all_ in tables.items() for f in new(all_)]
    return reduce(DataFrame.unionByName, frames).distinct() if frames else spark.createDataFrame([], "user_id int")


def update_documents(spark: SparkSession, star_root: str, path: str, **options: int) -> int:
    """Bring a table of documents up to the newest load of a star and return that load's number.

    Only users of new impressions, new clicks or new user rows are built again; a first run, or one after
    loads were folded that it had not seen, builds all. ``options`` are those of ``user_documents`` and must
    stay the same. The documents and the number are committed together, so a failed run is run again.
    """
    number, _ = commits.latest(spark, star_root)
    done = commits.latest(spark, path)[1].get("star", -1)
    if done == number:
        return number
    star, users = star_from_folder(spark, star_root, by_user=True), touched_users(spark, star_root, done) if done >= 0 else None
    if users is not None:
        star = replace(star, users=star.users.join(users, KEY, "left_semi"), impressions=star.impressions.join(users, KEY, "left_semi"))
    levels.add_load(user_documents(star, **options), path, KEY, star=number)
    return number


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The current documents of all users."""
    return levels.read_table(spark, path, KEY)

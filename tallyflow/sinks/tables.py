"""Keyed tables on a shared file system.

An update never rewrites a table: each load adds a folder of its own, with the
next free version number, and readers keep the newest version of each key. A
load repeated under its own name replaces its folder, so that restarts and
replays change nothing; a load under another name never touches it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.keyed import newest_row, newest_version
from tallyflow.operators.profile import Watched
from tallyflow.plans import reviews as rv
from tallyflow.plans.documents import user_documents
from tallyflow.plans.rollups import write_rollup
from tallyflow.plans.star import Star
from tallyflow.session import shuffles_freed


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options: str) -> None:
    """Replace a result; ``fmt`` may name any connector on the cluster."""
    df.write.mode("overwrite").format(fmt).options(**options).partitionBy(*partition_by).save(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return it as read back: its lineage ends here and its size is known."""
    overwrite(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_range(df: DataFrame, order: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Rows range-partitioned and sorted on a whole key.

    One hot leading value spreads over many partitions, and each covers a
    narrow key range that lookups can prune.
    """
    columns = [F.desc(c) if c in descending else F.asc(c) for c in order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], descending: Sequence[str] = (),
                 partition_by: Sequence[str] = ()) -> None:
    """Replace a table laid out by its key."""
    overwrite(by_range(df, order, descending), path, partition_by=partition_by)


def _loads(spark: SparkSession, path: str) -> dict[str, int]:
    """Version number of every load of a keyed table."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(fs_path(f"{path}/version=*/load=*")) or []
    folders = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in found]
    return {load.removeprefix("load="): int(version.removeprefix("version=")) for version, load in folders}


def blooms(*columns: str) -> dict[str, str]:
    """Write options for Bloom filters, by which lookups on columns out of order skip row groups; as large as their values need."""
    return {"parquet.bloom.filter.adaptive.enabled": "true", **{f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}}


def write_version(df: DataFrame, path: str, load: str | None = None, partition_by: Sequence[str] = (), **options: str) -> int:
    """Write one load of a keyed table and return its version.

    A load without a name is a new one; a named one that was written before
    replaces itself and keeps its version.
    """
    load = f"l-{load or uuid.uuid4().hex}"
    loads = _loads(df.sparkSession, path)
    version = loads.get(load, max(loads.values(), default=-1) + 1)
    overwrite(df, f"{path}/version={version}/load={load}", partition_by=partition_by, **options)
    return version


def newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the rows of a keyed table as stored, those of the newest load of each key."""
    # loads that began together share a number; their names decide then
    return newest_version(rows.withColumn("version", F.struct("version", "load")), key).drop("version", "load")


def read_newest(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The current rows of a keyed table: of each key those of the newest load; a single load is read as it is."""
    rows = spark.read.parquet(path)
    return rows.drop("version", "load") if len(_loads(spark, path)) == 1 else newest(rows, key)


def compact(
    spark: SparkSession, path: str, key: Sequence[str], target: str, descending: Sequence[str] = ("review_date",)
) -> None:
    """Write the current rows to a new table as its first load, laid out by key; later loads come after it.

    The layout is that of the loads: a folder for each ``year_month`` where the key has one, and
    ``descending`` columns of the key from the newest on.
    """
    order, months = [c for c in descending if c in key], [c for c in key if c == "year_month"]
    write_version(by_range(read_newest(spark, path, key), key, order), target, "compacted", months, **(
        blooms("review_id") if "review_id" in key else {}))


def write_documents(star: Star, path: str, load: str | None = None, drop_existing: bool = False, **options: int) -> None:
    """Load user documents; a user's new document (all its parts) replaces the older one.

    ``drop_existing`` empties the collection first. ``options`` are those of
    ``user_documents``.
    """
    documents = user_documents(star, **options)
    if drop_existing:
        name = f"l-{load or uuid.uuid4().hex}"
        stamped = documents.withColumns({"version": F.lit(0), "load": F.lit(name)})
        overwrite(stamped, path, partition_by=["version", "load"])
    else:
        write_version(documents, path, load)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The current user documents."""
    return read_newest(spark, path, ["user_id"])


def save_star(star: Star, database: str, root: str, buckets: int) -> None:
    """Save the star as catalog tables with both fact tables bucketed by impression.

    Reports join the two on every run; equal buckets make that join free of
    shuffles. Ids are unique, so buckets are even.
    """
    for name in ("advertisers", "users", "campaigns", "impressions", "clicks"):
        df = getattr(star, name)
        if name in ("impressions", "clicks"):
            df = df.repartition(buckets, "impression_id")
            writer = df.write.bucketBy(buckets, "impression_id").sortBy("impression_id")
        else:
            writer = df.write
        writer.mode("overwrite").option("path", f"{root}/{name}").saveAsTable(f"{database}.{name}")


#: Names and columns of the month tables, and what they are rolled up by.
MONTH_TABLES = {
    "product_reviews_by_month": "product_id",
    "customer_verified_by_month": "customer_id",
    "customer_haters_by_month": "customer_id",
    "customer_backers_by_month": "customer_id",
}


def write_month_rollups(spark: SparkSession, root: str, target: str) -> None:
    """Roll-ups of the stored month tables, from which top lists over any range of months are answered."""
    for name, id_name in MONTH_TABLES.items():
        write_rollup(read_review_table(spark, root, name), id_name, f"{target}/{name}")


def checked_review_results(raw: DataFrame, root: str, fmt: str = "parquet", **options: str) -> dict[str, int]:
    """``write_review_results`` over basic cleaning; counts of empty cells and dropped rows come from the same pass."""
    watched = Watched(rv.CRITICAL_BASIC)
    write_review_results(rv.clean_basic(watched.rows(raw)), root, fmt, **options)
    return watched.counts()


def write_review_results(clean: DataFrame, root: str, fmt: str = "parquet", **options: str) -> None:
    """The three results over basic cleaning, one collection each; ``options`` address the connector ``fmt``."""
    kept = clean.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        overwrite(rv.product_review_summary(kept), f"{root}/product_reviews_summary", fmt, **options)
        overwrite(rv.customer_review_counts(kept), f"{root}/customer_review_counts", fmt, **options)
        overwrite(rv.monthly_product_reviews(kept), f"{root}/monthly_product_reviews", fmt, **options)
    finally:
        kept.unpersist()


#: Tables of the reviews over strict cleaning and their keys.
REVIEW_TABLES = {
    "reviews_by_product": rv.PRODUCT_KEY,
    "reviews_by_product_rating": rv.RATING_KEY,
    "reviews_by_customer": rv.CUSTOMER_KEY,
    "product_reviews_by_month": ["year_month", "product_id"],
    "customer_verified_by_month": ["year_month", "customer_id"],
    "customer_haters_by_month": ["year_month", "customer_id"],
    "customer_backers_by_month": ["year_month", "customer_id"],
}


def write_review_tables(clean: DataFrame, root: str, load: str | None = None) -> None:
    """Add a load to the seven tables over strict cleaning, each laid out for its question; the last row of a key wins.

    Rows move once for the two tables by product and once for the one by customer, and are collapsed where
    they arrive. Reviews of very many rows are collapsed before they move, and lie in files of their own.
    """
    load = load or uuid.uuid4().hex
    spark, held = clean.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    def add(name: str, frame: DataFrame) -> None:
        # a review is also looked up by its own id
        options = blooms("review_id") if "review_id" in REVIEW_TABLES[name] else {}
        months = [c for c in REVIEW_TABLES[name] if c == "year_month"]
        write_version(frame, f"{root}/{name}", load, months, compression="zstd", **options)

    def add_reviews(laid: DataFrame, name: str) -> None:
        key = REVIEW_TABLES[name]
        frame = rv.laid_table(laid, key)
        if crowds:
            frame = frame.unionByName(by_range(rv.review_table(crowded, key), key, ["review_date"]))
        add(name, frame)

    try:
        with shuffles_freed(spark):
            rows = kept(clean)
            crowds = rv.crowded_reviews(rows)
            others, crowded = rv.split_crowds(rows, crowds) if crowds else (rows, rows)
            add("product_reviews_by_month", by_range(rv.product_reviews_by_month(rows), REVIEW_TABLES["product_reviews_by_month"]))
            classes = kept(by_range(rv.customer_classes_by_month(rows), ["year_month", "customer_id"]))
            for name in ("verified", "haters", "backers"):
                add(f"customer_{name}_by_month", rv.class_month_table(classes, name))
            held.pop().unpersist()
            add_reviews(rv.laid_by(others, rv.CUSTOMER_KEY), "reviews_by_customer")
            laid = kept(rv.laid_by(others, rv.PRODUCT_KEY))
            for name in ("reviews_by_product", "reviews_by_product_rating"):
                add_reviews(laid, name)
    finally:
        for df in reversed(held):
            df.unpersist()


def read_review_table(spark: SparkSession, root: str, name: str, **key: object) -> DataFrame:
    """The current rows of a review table; values for columns of its key prune what is read."""
    reader = spark.read
    if name in MONTH_TABLES:
        # a class without reviews has folders without files
        reader = reader.schema(f"{MONTH_TABLES[name]} string, review_count int, version int, load string, year_month string")
    rows = reader.parquet(f"{root}/{name}")
    for column, value in key.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    loads = _loads(spark, f"{root}/{name}")
    if len(loads) == 1:
        return rows.drop("version", "load")
    if len(set(loads.values())) < len(loads):
        rows = rows.withColumn("version", F.struct("version", "load"))
    return newest_row(rows, REVIEW_TABLES[name]).drop("version", "load")

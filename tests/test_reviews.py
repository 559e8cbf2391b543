import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.functions.numbers import lenient_int
from tallyflow.operators.profile import dropped_rows, null_blank_counts
from tallyflow.plans import reviews as rv
from tallyflow.sinks.tables import read_review_table, write_review_results, write_review_tables
from tallyflow.sources.files import read_partition

NAMES = [c.split()[0] for c in schemas.REVIEWS_RAW.split(", ")]


def review(**values):
    row = dict.fromkeys(NAMES, "x") | {
        "review_id": "r1", "product_id": "p1", "customer_id": "c1", "star_rating": "5",
        "review_date": "2015-03-01", "verified_purchase": "Y"} | values
    return tuple(row[n] for n in NAMES)


def frame(spark, *reviews):
    return spark.createDataFrame(list(reviews), schemas.REVIEWS_RAW)


@pytest.mark.parametrize("text,expected", [
    ("5", 5), (" 4 ", 4), ("4.7", 4), ("-3.", -3), ("x", None), ("", None), (None, None), ("99999999999", None),
    ("1e1", None)])
def test_lenient_int(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_int(F.col("t"))).first()[0] == expected


def test_profile_and_dropped_rows(spark, rows):
    raw = frame(spark, review(), review(vine=None), review(vine=" ", review_id=""), review(star_rating=None))
    profile = null_blank_counts(raw).first()
    assert (profile.vine, profile.review_id, profile.star_rating, profile.product_id) == (2, 1, 1, 0)
    assert rows(dropped_rows(raw, rv.CRITICAL_BASIC)) == [(4, 2, 2)]


def test_basic_cleaning_keeps_bad_ratings_and_dates_as_null(spark):
    raw = frame(spark, review(), review(review_id="r2", star_rating="x"), review(review_id="r3", review_date="2015-3-1"),
                review(review_id="r4", verified_purchase=None), review(review_id="r5", verified_purchase="N"),
                review(review_id=" "), review(review_id="r6", customer_id=None, verified_purchase="true"))
    clean = rv.clean_basic(raw)
    found = {r.review_id: (r.star_rating, r.review_date) for r in clean.collect()}
    assert found == {"r1": (5, date(2015, 3, 1)), "r2": (None, date(2015, 3, 1)), "r3": (5, None),
                     "r6": (5, date(2015, 3, 1))}
    summary = rv.product_review_summary(clean).first()
    assert (summary.total_reviews, summary.avg_star_rating) == (4, 5.0)
    monthly = rv.monthly_product_reviews(clean).collect()
    assert [tuple(r) for r in monthly] == [("p1", None, None, 1), ("p1", 2015, 3, 3)]


def test_strict_cleaning(spark):
    bad = [dict(star_rating=s) for s in ("0", "6", "x", " ", None)]
    bad += [dict(review_date=d) for d in ("2015-02-30", "soon", "", None)]
    bad += [dict(customer_id=c) for c in (" ", None)]
    raw = frame(spark, review(), review(review_id="r2", verified_purchase=None), review(review_id="r3", verified_purchase="N"),
                *[review(**b) for b in bad])
    found = {r.review_id: (r.verified_purchase, r.year_month) for r in rv.clean_strict(raw).collect()}
    assert found == {"r1": (True, "2015-03"), "r2": (None, "2015-03"), "r3": (False, "2015-03")}


def test_average_is_rounded_to_two_digits(spark):
    stars = ["1", "2", "2"]
    clean = rv.clean_basic(frame(spark, *[review(review_id=str(i), star_rating=s) for i, s in enumerate(stars)]))
    assert rv.product_review_summary(clean).first().avg_star_rating == 1.67


def some_reviews(spark):
    return rv.clean_strict(frame(
        spark,
        review(review_body="old"), review(review_body="new"),
        review(review_id="r0"), review(review_id="r9", review_date="2015-04-01", star_rating="1", verified_purchase="N"),
        review(review_id="s1", customer_id="c2", product_id="p2", star_rating="3", review_date="2015-01-31"),
        review(review_id="s2", customer_id="c2", product_id="p2", star_rating="2", review_date="2015-05-31"),
    ))


def test_review_lookups(spark):
    clean = some_reviews(spark)
    found = rv.reviews_by_product(rv.reviews_by_product_table(clean), "p1").collect()
    assert [(str(r.review_date), r.review_id) for r in found] == [
        ("2015-04-01", "r9"), ("2015-03-01", "r0"), ("2015-03-01", "r1")]
    rated = rv.reviews_by_product_rating(rv.reviews_by_product_rating_table(clean), "p1", 1).collect()
    assert [r.review_id for r in rated] == ["r9"]
    assert rv.reviews_by_customer(rv.reviews_by_customer_table(clean), "c2").count() == 2
    assert rv.reviews_by_product(rv.reviews_by_product_table(clean), "none").count() == 0
    with pytest.raises(ValueError):
        rv.reviews_by_product_rating(clean, "p1", 6)


def test_month_tables_count_rows_before_the_key_collapse(spark, rows):
    clean = some_reviews(spark)
    assert rows(rv.product_reviews_by_month(clean)) == [
        ("2015-01", "p2", 1), ("2015-03", "p1", 3), ("2015-04", "p1", 1), ("2015-05", "p2", 1)]
    classes = rv.customer_classes_by_month(clean)
    assert rows(rv.class_month_table(classes, "verified")) == rows(rv.customer_verified_by_month(clean))
    assert rows(rv.class_month_table(classes, "haters")) == rows(rv.customer_haters_by_month(clean))
    assert rows(rv.class_month_table(classes, "backers")) == rows(rv.customer_backers_by_month(clean))
    assert rows(rv.customer_backers_by_month(clean)) == [("2015-03", "c1", 3)]


def test_top_lists(spark):
    clean = some_reviews(spark)

    def top(build, *args):
        return [tuple(r) for r in build(clean, *args).collect()]

    assert top(rv.top_products, "2015-01", "2015-12") == [("p1", 4), ("p2", 2)]
    assert top(rv.top_haters, "2015-1", "2015-12", 1) == [("c1", 1)]
    for build, id_name, table in ((rv.top_haters, "customer_id", rv.customer_haters_by_month),
                                  (rv.top_products, "product_id", rv.product_reviews_by_month)):
        of_table = rv.top_of_months(table(clean), id_name, "2015-02", "2015-12")
        assert top(build, "2015-02", "2015-12") == [tuple(r) for r in of_table.collect()]
    assert top(rv.top_haters, "2015-05", "2015-12") == [("c2", 1)]
    assert top(rv.top_customers, "2015-05", "2015-01") == []
    for n in (0, 101):
        with pytest.raises(ValueError):
            rv.top_backers(clean, "2015-01", "2015-12", n)


def test_document_reads(spark):
    clean = rv.clean_basic(frame(spark, *[
        review(review_id=str(i), product_id=f"p{i % 3}", customer_id=f"c{i % 2}", review_date=f"2015-0{1 + i % 2}-01")
        for i in range(7)]))
    summary, counts = rv.product_review_summary(clean), rv.customer_review_counts(clean)
    assert [r.product_id for r in rv.top_reviewed_products_all(summary, 2).collect()] == ["p0", "p1"]
    assert [r.customer_id for r in rv.top_verified_customers_all(counts).collect()] == ["c0", "c1"]
    assert rv.product_summary_lookup(summary, "p2").first().total_reviews == 2
    trend = rv.product_monthly_trend(rv.monthly_product_reviews(clean), "p0").collect()
    assert [(r.month, r.review_count) for r in trend] == [(1, 2), (2, 1)]


def test_written_tables(spark, rows, folder):
    clean = some_reviews(spark)
    write_review_tables(clean, folder)
    write_review_results(clean, folder)
    columns = rv.reviews_by_product_table(clean).columns
    table = read_review_table(spark, folder, "reviews_by_product").select(*columns)
    assert rows(table) == rows(rv.reviews_by_product_table(clean))
    one = read_review_table(spark, folder, "reviews_by_product", product_id="p2")
    assert {r.review_id for r in one.collect()} == {"s1", "s2"}
    assert read_partition(spark, f"{folder}/reviews_by_product", product_id="p2").count() == 2
    months = read_review_table(spark, folder, "customer_haters_by_month")
    assert rows(months.select("year_month", "customer_id", "review_count")) == rows(rv.customer_haters_by_month(clean))
    # a second load of one review leaves the others and replaces that one
    write_review_tables(clean.filter("review_id = 's1'").withColumn("product_title", F.lit("new")), folder)
    titles = read_review_table(spark, folder, "reviews_by_product")
    assert titles.count() == len(rows(table)) and titles.filter("product_title = 'new'").count() == 1
    assert spark.read.parquet(f"{folder}/product_reviews_summary").count() == 2


def copied_reviews(spark):
    """Copies of a review that differ in columns of some keys only, and many of one that differ in none or in the title."""
    clean = some_reviews(spark)
    more = [review(review_id="hot", product_title=f"t{i % 3}", review_body=None if i % 2 else "b") for i in range(40)]
    more += [review(review_id="hot", star_rating=str(1 + i % 2), customer_id=f"c{i % 2}", product_id="p3") for i in range(6)]
    more += [review(review_id="r1", star_rating="4", verified_purchase=None), review(review_id="r1", customer_id="c0")]
    return clean.unionByName(rv.clean_strict(frame(spark, *more)))


def test_laid_tables_hold_the_rows_of_the_grouped_ones(spark, rows):
    """Both tables by product come out of one exchange by ranges, which nothing follows."""
    clean = copied_reviews(spark)
    laid = rv.laid_by(clean, rv.PRODUCT_KEY).persist()
    try:
        for key, table in ((rv.PRODUCT_KEY, rv.reviews_by_product_table), (rv.RATING_KEY, rv.reviews_by_product_rating_table)):
            found = rv.laid_table(laid, key)
            assert found.columns == table(clean).columns and rows(found) == rows(table(clean))
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert re.findall(r"Exchange (\w+)", plan) == ["rangepartitioning"]
    finally:
        laid.unpersist()
    found = rv.laid_table(rv.laid_by(clean, rv.CUSTOMER_KEY), rv.CUSTOMER_KEY)
    assert rows(found) == rows(rv.reviews_by_customer_table(clean))
    listed = [(r.product_id, -r.review_date.toordinal(), r.review_id) for r in rv.laid_table(laid, rv.PRODUCT_KEY).collect()]
    assert listed == sorted(listed)


@pytest.mark.parametrize("crowd", [20, 50_000])
def test_crowded_reviews_are_written_like_others(spark, rows, folder, monkeypatch, crowd):
    monkeypatch.setattr(rv, "CROWD", crowd)
    clean = copied_reviews(spark)
    assert rv.crowded_reviews(clean) == (["hot"] if crowd == 20 else [])
    assert rv.crowded_reviews(clean.limit(0)) == []
    write_review_tables(clean, folder)
    for name, table in (("reviews_by_product", rv.reviews_by_product_table), ("reviews_by_product_rating", rv.reviews_by_product_rating_table),
                        ("reviews_by_customer", rv.reviews_by_customer_table), ("product_reviews_by_month", rv.product_reviews_by_month),
                        ("customer_haters_by_month", rv.customer_haters_by_month), ("customer_verified_by_month", rv.customer_verified_by_month)):
        expected = table(clean)
        assert rows(read_review_table(spark, folder, name).select(*expected.columns)) == rows(expected)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_the_newest_load_is_told_by_its_number(spark, rows, folder):
    """Rows move with the number of their load; its name goes along only where loads that began together share one."""
    clean = some_reviews(spark)
    for title in ("one", "two"):
        write_review_tables(clean.withColumn("product_title", F.lit(title)), folder)

    def titles():
        table = read_review_table(spark, folder, "reviews_by_product")
        return table, {r.product_title for r in table.collect()}

    table, found = titles()
    assert found == {"two"} and "named_struct(version" not in table._jdf.queryExecution().optimizedPlan().toString()
    rv.reviews_by_product_table(clean).withColumn("product_title", F.lit("three")).write.parquet(
        f"{folder}/reviews_by_product/version=1/load=l-{'g' * 32}")
    assert titles()[1] == {"three"}

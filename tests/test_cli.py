import os

import pytest

from tallyflow.cli import main
from tallyflow.schemas import REVIEWS_RAW
from tallyflow.sinks import user_documents
from tallyflow.sinks.minutes import read_minutes
from tallyflow.sinks.tables import read_documents
from tests.test_files import EVENT_HEADER, write


def test_advertising_jobs(spark, folder):
    write(folder, "users.csv", "a,b,c,d,e,f", '7,30,F,PL,"tech, music",2024-01-02')
    write(folder, "campaigns.csv", "a,b,c,d,e,f,g,h,i", "1,Acme,Spring,2024-01-01,2024-02-01,Tech,s,1000,100")
    row = "Spring,8a32d1f9-1111-4222-8333-444444444441,Acme,2024-01-01,2024-02-01,T,I,C,s,7,m,PL,2024-10-05 10:00:00,0.5,0.1,True,2024-10-05 10:00:05,2.5,9,8"
    write(folder, "events.csv", EVENT_HEADER, row)
    inputs = [x for n in ("users", "campaigns", "events") for x in (f"--{n}", f"{folder}/{n}.csv")]
    main(["load-star", *inputs, "--out", f"{folder}/star"])
    main(["load-documents", "--star", f"{folder}/star", "--out", f"{folder}/docs", "--drop-existing"])
    assert read_documents(spark, f"{folder}/docs").first().sessions[0].impressions[0].click.revenue_generated == 2.5
    main(["compact-star", "--out", f"{folder}/star", "--forget"])
    main(["update-documents", "--star", f"{folder}/star", "--out", f"{folder}/updated"])
    assert user_documents.read_documents(spark, f"{folder}/updated").first().sessions[0].impressions[0].click.revenue_generated == 2.5
    with pytest.raises(SystemExit):
        main(["update-documents", "--star", f"{folder}/star", "--out", f"{folder}/updated", "--timeout", "0"])
    main(["campaign-reports", "--star", f"{folder}/star", "--out", f"{folder}/reports"])
    assert spark.read.json(f"{folder}/reports/budget_warnings").first().budget_spent_percentage == 90.0
    main(["engagement-reports", "--star", f"{folder}/star", "--asof", "2024-10-06 00:00:00", "--out", f"{folder}/more"])
    assert len(os.listdir(f"{folder}/more")) == 5


def test_review_and_stream_jobs(spark, folder):
    names = REVIEWS_RAW.replace(" string", "").split(", ")
    values = {"star_rating": "5", "review_date": "2015-01-01", "verified_purchase": "Y"}
    os.mkdir(f"{folder}/in")
    for sep, name in ((",", "in/reviews.csv"), ("\t", "reviews.tsv")):
        write(folder, name, sep.join(names), sep.join(values.get(n, n) for n in names))
    main(["review-results", "--reviews", f"{folder}/in", "--out", f"{folder}/results"])
    main(["review-tables", "--reviews", f"{folder}/reviews.tsv", "--out", f"{folder}/tables"])
    assert spark.read.parquet(f"{folder}/results/customer_review_counts").count() == 1
    assert spark.read.parquet(f"{folder}/tables/customer_backers_by_month").count() == 1
    main(["month-rollups", "--tables", f"{folder}/tables", "--out", f"{folder}/rollups"])
    main(["top-list", "--rollups", f"{folder}/rollups", "--table", "customer_backers_by_month", "--start", "2014-01", "--end", "2015-12",
          "--out", f"{folder}/top"])
    assert spark.read.json(f"{folder}/top/customer_backers_by_month").first().review_count == 1
    main(["stream-tweets", "--once-within", "1 hour", "--source", f"{folder}/in", "--out", f"{folder}/topic", "--checkpoint", f"{folder}/c1", "--once"])
    main(["stream-minutes", "--source", f"{folder}/topic", "--out", f"{folder}/minutes", "--checkpoint", f"{folder}/c2", "--once"])
    assert read_minutes(spark, f"{folder}/minutes").first().text == "review_body"

"""From landed pages to reports."""

import csv
import glob

from pyspark.sql import functions as F

from listingflow.plans.listing_run import listings_from_pages, run, write_run
from listingflow.plans.queries_listings import RULES
from listingflow.sources import html as H
from listingflow.sources import stores

def as_of():
    return F.lit("2024-01-10").cast("date")


PAGES = "task_ord long, keyword string, category string, location string, mode string, page int, html string, failed boolean, duration double"


def card(i, title="Ring economy", place="Town"):
    return (
        f'<li><div class="base-card job-search-card" data-entity-urn="urn:li:jobPosting:{i}"><h3 class="base-search-card__title">{title} {i}</h3>'
        f'<h4 class="base-search-card__subtitle"><a href="#">Firm {i % 3}</a></h4><span class="job-search-card__location">{place}</span></div> </li>'
    )


def pages(spark):
    page = lambda *ids: "".join(card(i) for i in ids)
    rows = [
        (0, "ring", "small", "Town", "onsite", 0, page(1, 2, 3, 3), False, 1.0),
        (0, "ring", "small", "Town", "onsite", 1, page(3, 4), False, 2.0),
        (0, "ring", "small", "Town", "onsite", 2, page(5, 6), False, 4.0),
        (1, "rod", "small", "Town (x)", "hybrid", 0, page(2, 7), False, 1.0),
        (1, "rod", "small", "Town (x)", "hybrid", 1, "", True, 1.0),
        (1, "rod", "small", "Town (x)", "hybrid", 2, page(8), False, 1.0),
        (2, "bolt", "small", "Remote", "remote", 0, card(9, "Blocked bolt") + card(10), False, 3.0),
    ]
    return spark.createDataFrame(rows, PAGES)


def from_pages(spark):
    aliases = {"category": ["category"], "keyword": ["keyword"]}
    return listings_from_pages(pages(spark), H.base_card_listings, "site", as_of(), aliases, {"title": "Unknown Position"}, max_pages=5)


def test_paging_rules_and_modes(spark):
    listed, log = from_pages(spark)
    rows = sorted(listed.collect(), key=lambda r: r["ord"])
    assert [r["job_id"].removeprefix("linkedin_") for r in rows] == ["1", "2", "3", "4", "2", "7", "9", "10"]
    assert [r["location"] for r in rows] == ["Town"] * 4 + ["Town (Hybrid)"] * 2 + ["Remote"] * 2
    read = {(r["task"], r["page"]): (r["rows"], r["dups"], r["failed"], r["early_stopped"]) for r in log.collect()}
    assert read[(0, 0)] == (4, 1, False, False) and read[(0, 1)] == (2, 1, False, True)
    assert read[(1, 1)] == (0, 0, True, False) and (0, 2) not in read


def test_run_from_pages_to_files(spark, tmp_path):
    listed, log = from_pages(spark)
    listed = listed.withColumn("posted", F.col("date").cast("date"))
    profile = spark.createDataFrame([("that economy ring",)], "text string")
    progress = spark.createDataFrame([("firm_1_ring_economy_1", "done", "f")], "job_key string, status string, folder string")
    cache = listed.where("job_id = 'linkedin_3'").select("title", "company")
    out = run(listed, None, profile, RULES, as_of(), ["blocked"], min_score=0.0, target=50, cache=cache, progress=progress)
    assert out.rejected.count() == 1 and out.new.count() == 7
    assert "linkedin_3" not in {r["job_id"] for r in out.scored.collect()}
    assert "linkedin_1" not in {r["job_id"] for r in out.recommended.collect()}
    path = str(tmp_path / "out")
    write_run(out, path, log, progress, as_of(), F.lit(2.5))
    reports = [r for f in glob.glob(path + "/recommended/*.csv") for r in csv.reader(open(f, newline=""))]
    assert len([r for r in reports if r[0] != "title"]) == out.recommended.count() == 5
    after = stores.read_keyed_lines(spark, path + "/progress", stores.PROGRESS_TYPE, "job_key").collect()
    assert len(after) == 5 and all(r["status"] == "done" for r in after)
    saved = spark.read.parquet(path + "/statistics").first()
    assert saved["total_scraped"] == 7 and saved["sources"]["site"]["pages_scraped"] >= 3
    assert spark.read.parquet(path + "/cache").count() == out.scored.count()


def test_scoring_stops_at_the_target(spark):
    listed, _ = from_pages(spark)
    listed = listed.withColumn("posted", F.col("date").cast("date"))
    profile = spark.createDataFrame([("that economy ring",)], "text string")
    out = run(listed, None, profile, RULES, as_of(), min_score=0.0, target=3, stop_at_target=True)
    assert out.scored.count() == 3 and sorted(r["ord"] for r in out.scored.collect()) == sorted(r["ord"] for r in listed.collect())[:3]

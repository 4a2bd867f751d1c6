"""Queries over landed pages: fields, cards, layouts, fallbacks, descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingflow.functions import text as X
from listingflow.operators import filters
from listingflow.plans.driver_tables import LISTINGS_SQL, as_of, listings, spread, table
from listingflow.plans.registry import query, sql_clean, sql_strip
from listingflow.sources import html as H

TITLE = r"(?s)<title>(.*?)</title>"
LINK = r'<li><a href="[^"]+">[^<]*</a></li>'
LINK_URL = r'href="([^"]+)"'
LINK_TEXT = r"(?s)<a [^>]*>(.*?)</a>"
ARTICLE = r"(?s)<article>.*?</article>"
HEAD = r"(?s)<h1>(.*?)</h1>"
LEAD = r"(?s)<p>([^<]{60,}?)</p>"
AD = r'(?s)<div class="ad">(.*?)</div>'


def _pages(spark, d):
    return filters.with_html(spread(spark, d, "pages"))


@query("html_title", f"SELECT page_id, {sql_clean(f'''regexp_extract(html, '{TITLE}', 1)''')} AS title FROM pages")
def html_title(spark, d):
    return _pages(spark, d).select("page_id", H.read_field(F.col("html"), H.Field((TITLE,))).alias("title"))


@query("links", f"""SELECT page_id, regexp_extract(card, '{LINK_URL}', 1) AS url, {sql_clean(f"regexp_extract(card, '{LINK_TEXT}', 1)")} AS title, pos - 1 AS pos
FROM (SELECT page_id, unnest(c) AS card, generate_subscripts(c, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{LINK}') AS c FROM pages))""")
def links(spark, d):
    fields = {"url": H.Field((LINK_URL,), clean=False), "title": H.Field((LINK_TEXT,))}
    return H.extract_cards(_pages(spark, d), "html", LINK, fields, ["page_id"])


@query("article_cards", f"""SELECT page_id, pos - 1 AS pos, {sql_clean(f"regexp_extract(card, '{HEAD}', 1)")} AS title,
  coalesce(nullif({sql_clean(f"regexp_extract(card, '{LEAD}', 1)")}, ''), nullif({sql_clean(f"regexp_extract(card, '(?s)<b>(.*?)<br>', 1)")}, ''), 'Unknown') AS lead
FROM (SELECT page_id, unnest(c) AS card, generate_subscripts(c, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{ARTICLE}') AS c FROM pages))""")
def article_cards(spark, d):
    fields = {"title": H.Field((HEAD,)), "lead": H.Field((LEAD, r"(?s)<b>(.*?)<br>"), default="Unknown")}
    return H.extract_cards(_pages(spark, d), "html", ARTICLE, fields, ["page_id"])


@query("clean_html", f"SELECT page_id, {sql_clean('html')} AS text FROM pages")
def clean_html(spark, d):
    return _pages(spark, d).select("page_id", X.clean_html("html").alias("text"))


@query("long_text", f"""SELECT page_id, CASE WHEN len(a) > 50 THEN a WHEN len(b) > 50 THEN b ELSE '' END AS description FROM (
  SELECT page_id, {sql_clean(f"regexp_extract(html, '{AD}', 1)")} AS a, {sql_clean("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS b FROM pages)""")
def long_text(spark, d):
    patterns = (AD.replace("(?s)", ""), r"<article>(.*?)</article>")
    return _pages(spark, d).select("page_id", H.long_text("html", patterns).alias("description"))


@query("parser_fallback", f"""SELECT page_id, pos - 1 AS pos, {sql_clean(f"regexp_extract(card, '{LINK_TEXT}', 1)")} AS title FROM (
  SELECT page_id, unnest(c) AS card, generate_subscripts(c, 1) AS pos FROM (
    SELECT page_id, CASE WHEN len(a) > 0 THEN a ELSE regexp_extract_all(html, '{LINK}') END AS c
    FROM (SELECT page_id, html, regexp_extract_all(html, '<a href="/the[^"]*">[^<]*</a>') AS a FROM pages)))""")
def parser_fallback(spark, d):
    """Cards of the first pattern; those of the second only for pages without any."""
    fields = {"title": H.Field((LINK_TEXT,))}
    a = H.card_array("html", r'<a href="/the[^"]*">[^<]*</a>', fields)
    b = H.card_array("html", LINK, fields)
    rows = _pages(spark, d).select("page_id", F.posexplode(H.first_parser(a, b)).alias("pos", "c"))
    return rows.select("page_id", "pos", "c.title")


@query("decode_pages", "SELECT page_id, chr(65533) || html AS html FROM pages")
def decode_pages(spark, d):
    """Landed bytes that begin with one that is not UTF-8."""
    raw = F.concat(F.unhex(F.lit("FF")), F.col("html").cast("binary"))
    return table(spark, d, "pages").select("page_id", X.decode_response(raw).alias("html"))


_T = sql_clean(f"regexp_extract(html, '{TITLE}', 1)")
_TITLED = f"titled AS (SELECT page_id, url, {_T} AS t FROM pages)"


def _titled(spark, d):
    return html_title(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id")


@query("layout_tag_json", f"""WITH {_TITLED} SELECT page_id, 0 AS pos, t AS title,
  CASE WHEN page_id % 3 = 0 THEN 'Firm ' || page_id ELSE 'Unknown Company' END AS company,
  CASE WHEN page_id % 3 = 0 THEN 'here' WHEN page_id % 3 = 1 THEN 'loc' WHEN page_id % 2 = 0 THEN '' ELSE 'here' END AS location,
  CASE WHEN page_id % 3 = 0 THEN 'j' || page_id ELSE 'naukri_two_words_' END AS job_id,
  CASE WHEN page_id % 3 = 0 THEN 'https://www.naukri.com/job-details/j' || page_id ELSE '' END AS url FROM titled WHERE page_id % 3 = 0 OR t <> ''""")
def layout_tag_json(spark, d):
    """First layout: every third page carries JSON with a repeated id behind a broken and an
    empty tag; the others carry cards with a location, a blank one or none."""
    row = F.to_json(
        F.struct(
            F.concat(F.lit("j"), F.col("page_id").cast("string")).alias("jobId"), F.col("title").alias("jobTitle"),
            F.concat(F.lit("Firm "), F.col("page_id").cast("string")).alias("company"),
        )
    )
    tag = F.concat(
        F.lit('<script type="application/json" id="__NEXT_DATA__">{"props":{"broken</script>'),
        F.lit('<script type="application/json" id="__NEXT_DATA__">{"props":{"pageProps":{"jobList":[]}}}</script>'),
        F.lit('<script type="application/json" id="__NEXT_DATA__">{"props":{"pageProps":{"searchResults":{"jobDetails":[]},"jobList":['),
        row, F.lit(","), row, F.lit("]}}}</script>"),
    )
    escaped = F.replace(F.replace(F.col("title"), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    card = F.concat(
        F.lit('<article class="x jobTuple y"><a class="title z" href="/q">'), escaped,
        F.lit("</a>"),
        F.when(F.col("page_id") % 3 == 1, '<span class="loc"> loc </span>').when(F.col("page_id") % 2 == 0, '<span class="loc"> </span>').otherwise(""),
        F.lit("</article>"),
    )
    pages = _titled(spark, d).select(
        "page_id", F.lit("two words").alias("keyword"), F.lit("here").alias("location_hint"),
        F.when(F.col("page_id") % 3 == 0, tag).otherwise(card).alias("html"),
    )
    found = H.tag_json_listings(pages, ["page_id"])
    return found.select("page_id", "pos", "title", "company", "location", "job_id", "url")


@query("layout_beacon_cards", f"""WITH {_TITLED} SELECT page_id, 0 AS pos, CASE WHEN t = '' THEN 'Unknown Position' ELSE t END AS title, 'ACME & Co' AS company,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE 'here' END AS location, 'indeed_k' || page_id AS job_id, 'https://b.example/viewjob?jk=k' || page_id AS url, 'short note' AS description FROM titled""")
def layout_beacon_cards(spark, d):
    """Second layout without JSON: two equal cards per page, one listing."""
    escaped = F.replace(F.replace(F.col("title"), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    card = F.concat(
        F.lit('<td><div class="job_seen_beacon"><h2 class="jobTitle"><a href="/viewjob?jk=k'), F.col("page_id").cast("string"),
        F.lit('&amp;x=1">'), F.replace(escaped, F.lit("&"), F.lit("&amp;")),
        F.lit('</a></h2><span class="company"> ACME &amp; Co </span><div class="summary">short  <b>note</b></div>'),
        F.when(F.col("page_id") % 2 == 0, '<div class="location"> <br> </div>').otherwise(""), F.lit(" </div></td>"),
    )
    pages = _titled(spark, d).select(
        "page_id", F.lit("two words").alias("keyword"), F.lit("here").alias("location_hint"), F.concat(card, card).alias("html")
    )
    found = H.marker_json_listings(pages, ["page_id"], "https://b.example")
    return found.select("page_id", "pos", "title", "company", "location", "job_id", "url", "description")


@query("layout_base_cards", f"""WITH {_TITLED} SELECT page_id, pos, CASE WHEN t = '' THEN 'Unknown Position' ELSE t END AS title, 'Firm' AS company, CASE WHEN pos = 0 THEN 'Town' ELSE '' END AS location,
  CASE WHEN pos = 0 THEN 'linkedin_' || page_id ELSE 'linkedin_9' || page_id END AS job_id, url FROM titled, (VALUES (0), (1)) p(pos)""")
def layout_base_cards(spark, d):
    """Third layout: one id from the attribute, one from the link."""
    escaped = F.replace(F.replace(F.col("title"), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    pid = F.col("page_id").cast("string")

    def card(attribute, view, town):
        return F.concat(
            F.lit('<li><div class="base-card job-search-card" '), attribute, F.lit('><a class="base-card__full-link x" href="'), F.col("url"),
            F.lit('"></a>'), view, F.lit('<h3 class="base-search-card__title"> '), F.replace(escaped, F.lit("&"), F.lit("&amp;")),
            F.lit(' </h3><h4 class="base-search-card__subtitle"><a href="#"> Firm </a></h4><span class="job-search-card__location"> '), F.lit(town), F.lit(' </span></div> </li>'),
        )

    first = card(F.concat(F.lit('data-entity-urn="urn:li:jobPosting:'), pid, F.lit('"')), F.lit(""), "Town")
    second = card(F.lit('data-x=""'), F.concat(F.lit("<i>/jobs/view/9"), pid, F.lit("</i>")), "")
    pages = _titled(spark, d).select(
        "page_id", "url", F.lit("two words").alias("keyword"), F.lit("here").alias("location_hint"), F.concat(first, second).alias("html")
    )
    found = H.base_card_listings(pages.drop("url"), ["page_id"])
    return found.select("page_id", "pos", "title", "company", "location", "job_id", "url")


@query("fill_descriptions", f"""SELECT o.o_orderkey AS ord, CASE WHEN o.o_orderkey % 2 = 0 THEN 'own text' WHEN p.page_id IS NULL THEN ''
  WHEN len(p.t) > 50 THEN p.t WHEN p.page_id % 2 = 0 THEN trim(repeat('an older landing of the same page ', 3)) ELSE '' END AS description
FROM orders o LEFT JOIN (SELECT page_id, {sql_clean("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS t FROM pages) p
  ON p.page_id = o.o_custkey % (2 * (SELECT count(*) FROM pages))""")
def fill_descriptions(spark, d):
    """Half of the listings have a text; the others take it from the last landed detail page
    that has one, if there is one. Pages are landed up to three times."""
    pages = table(spark, d, "pages")
    n = pages.agg(F.count(F.lit(1))).scalar()
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % (n * 2)).cast("string").alias("job_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "own text").otherwise("").alias("description"),
    )
    landed = pages.select(F.col("page_id").cast("string").alias("job_id"), "html", F.lit(2).alias("landing"))
    older = landed.select("job_id", F.lit("<article>" + "an older landing of the same page " * 3 + "</article>").alias("html"), F.lit(1).alias("landing"))
    blank = landed.select("job_id", F.lit("").alias("html"), F.lit(3).alias("landing"))
    details = landed.unionByName(older.where("cast(job_id as long) % 2 = 0")).unionByName(blank)
    return H.fill_descriptions(rows, details, (r"<article>(.*?)</article>",), order="landing").select("ord", "description")


@query("normalize_cards", f"""WITH {LISTINGS_SQL} SELECT ord, 'q' AS category, CASE WHEN category = 'small' THEN 'Unknown Position' ELSE {sql_strip('title')} END AS title,
  company, CASE WHEN category = 'promo' THEN 'Anywhere' WHEN category = 'large' THEN '9 years experience' ELSE location END AS location,
  '2001-08-01' AS date, CAST(ord AS VARCHAR) AS job_id, '' AS description, 'https://jobs.example/' || ord AS url, 'Site' AS source, 'kw' AS keyword FROM listings""")
def normalize_cards(spark, d):
    """Raw cards with alias columns and label lists become canonical listings."""
    exp = F.lit("9 years experience")
    labels = (
        F.when(F.col("category") == "promo", F.array().cast("array<struct<label:string>>"))
        .when(F.col("category") == "large", F.array(F.struct(exp.alias("label"))))
        .otherwise(F.array(F.struct(exp.alias("label")), F.struct(F.lit(" ").alias("label")), F.struct(F.col("location").alias("label"))))
    )
    raw = listings(spark, d, description=False).select(
        "ord", F.lit("q").alias("category"), F.when(F.col("category") != "small", F.col("title")).alias("title"),
        F.col("company").alias("companyName"), H.label_location(labels, "Anywhere").alias("location"),
        F.lit(None).cast("string").alias("jdid"), F.col("ord").cast("string").alias("jobId"), F.lit("kw").alias("keyword"),
    )
    return H.normalize_cards(
        raw, "Site", as_of(),
        {"company": ["companyName", "company"], "job_id": ["jdid", "jobId"]},
        {"title": "Unknown Position", "company": "Unknown Company", "location": "India"},
        "https://jobs.example/",
    )


@query("with_title_or_id", f"WITH {LISTINGS_SQL} SELECT ord FROM listings WHERE NOT (url = '' AND category = 'small')")
def with_title_or_id(spark, d):
    rows = listings(spark, d, description=False).select(
        "ord", F.when(F.col("category") != "small", F.col("title")).alias("title"), F.col("url").alias("job_id")
    )
    return filters.with_title_or_id(rows).select("ord")

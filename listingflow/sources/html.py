"""Listings out of landed HTML pages, by declarative specs.

A spec says how a card is found and how each field is read from it. It compiles to
column expressions, so pages stay in the JVM and the work is one narrow step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.functions.text import clean_html, col, strip, text_or_empty


@dataclass(frozen=True)
class Field:
    """One field of a card: patterns tried in order, group 1 is the value.

    ``clean`` drops tags; with ``entities`` it also decodes entities and collapses spaces.
    With ``blank`` a match without text counts: the value is then empty, and null only
    where no pattern matches.
    """

    patterns: tuple[str, ...]
    clean: bool = True
    default: str = ""
    entities: bool = True
    blank: bool = False


def landed_pages(spark, path: str) -> DataFrame:
    """Landed raw pages from files, gzipped or not; one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.make_valid_utf8("value").alias("html")
    )


def read_field(card: Column, field: Field) -> Column:
    """Value of the first pattern that gives a non-empty one; else the default."""
    tries = []
    for p in field.patterns:
        value = F.regexp_extract(card, p, 1)
        if field.clean and field.entities:
            value = clean_html(value)
        elif field.clean:
            value = strip(F.regexp_replace(value, "<[^>]+>", " "))
        tries.append(F.when(F.regexp_like(card, F.lit(p)), value) if field.blank else F.nullif(value, F.lit("")))
    return F.coalesce(*tries) if field.blank else F.coalesce(*tries, F.lit(field.default))


def cards(df: DataFrame, html: str, card_pattern: str, keep: Sequence[str]) -> DataFrame:
    """One row per card of a page, with its position and source text."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(card_pattern), F.lit(0))
    return df.where(text_or_empty(html) != "").select(*keep, F.posexplode(found).alias("pos", "card"))


def extract_cards(
    df: DataFrame, html: str, card_pattern: str, fields: Mapping[str, Field], keep: Sequence[str]
) -> DataFrame:
    """Cards with their fields read; rows come from the page alone, nothing is shuffled."""
    return cards(df, html, card_pattern, keep).select(
        *keep, "pos", *[read_field(F.col("card"), f).alias(n) for n, f in fields.items()]
    )


def card_array(html: Column | str, card_pattern: str, fields: Mapping[str, Field]) -> Column:
    """Cards of a page as an array of structs, for fallback chains inside a row."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(card_pattern), F.lit(0))
    return F.transform(
        found, lambda c: F.struct(*[read_field(c, f).alias(n) for n, f in fields.items()])
    )


def json_after(html: Column | str, marker: str) -> Column:
    """Text from the first brace after a marker; the JSON reader stops at the object's end."""
    c = text_or_empty(html)
    tail = F.substr(c, F.instr(c, marker) + F.lit(len(marker)))
    start = F.instr(tail, "{")
    return F.when(F.contains(c, F.lit(marker)) & (start > 0), F.substr(tail, start))


def json_in_tags(html: Column | str, tag_pattern: str) -> Column:
    """Bodies of all elements a pattern matches (group 1), in page order."""
    return F.regexp_extract_all(text_or_empty(html), F.lit("(?s)" + tag_pattern), F.lit(1))


def first_json_rows(bodies: Column, schema: str, paths: Sequence[str]) -> Column:
    """Rows of the first body that holds any; broken or empty ones are passed over."""
    tries = F.transform(bodies, lambda body: json_rows(body, schema, paths))
    return F.get(F.filter(tries, lambda rows: F.size(rows) > 0), 0)


def json_rows(text: Column, schema: str, paths: Sequence[str]) -> Column:
    """Array at the first path that holds a non-empty one. Broken JSON gives null."""
    parsed = F.from_json(text, schema)

    def pick(p: Column) -> Column:
        tries = []
        for path in paths:
            value = p
            for step in path.split("."):
                value = value[step]
            tries.append(F.when(F.size(value) > 0, value))
        return F.coalesce(*tries)

    # The one-element transform binds the parsed value, so the text is parsed once.
    return F.transform(F.array(parsed), pick)[0]


def first_rows_by_id(rows: Column, id_field: str) -> Column:
    """Array without later elements of an id already seen; elements without id stay."""
    ids = F.transform(rows, lambda r: text_or_empty(r[id_field]))

    def keep(bound: Column) -> Column:
        return F.filter(
            rows,
            lambda r, i: (text_or_empty(r[id_field]) == "")
            | (F.array_position(bound, text_or_empty(r[id_field])) == i + 1),
        )

    return F.transform(F.array(ids), keep)[0]


def first_parser(*results: Column) -> Column:
    """Rows of the first parser that found any for the page."""
    tries = [F.when(F.size(r) > 0, r) for r in results]
    return F.coalesce(*tries)


def long_text(html: Column | str, patterns: Sequence[str], longer_than: int = 50) -> Column:
    """First of several patterns whose cleaned text is long enough, else empty."""
    tries = []
    for p in patterns:
        value = clean_html(F.regexp_extract(text_or_empty(html), "(?s)" + p, 1))
        tries.append(F.when(F.length(value) > longer_than, value))
    return F.coalesce(*tries, F.lit(""))


def fill_descriptions(
    listings: DataFrame, details: DataFrame, patterns: Sequence[str], key: str = "job_id", order: str | None = None
) -> DataFrame:
    """Take a missing description from the landed detail page of the same id.

    Only listings without one take part in the join; the pages are cut down to the
    extracted text before it, one for each id: the last landed by the column ``order``,
    or without it the greatest text. A blank id joins nothing.
    """
    found = details.select(
        F.col(key).alias("_key"), long_text("html", patterns).alias("_text"), *([F.col(order).alias("_order")] if order else [])
    ).where((F.col("_text") != "") & (F.col("_key") != ""))
    last = F.max_by("_text", F.struct("_order", "_text")) if order else F.max("_text")
    texts = found.groupBy("_key").agg(last.alias("_text"))
    need = text_or_empty("description") == ""
    # Listings that already have a text go around the join, so they are not moved.
    missing = listings.where(need).join(texts, F.col(key) == F.col("_key"), "left")
    filled = missing.withColumn("description", F.coalesce("_text", F.lit(""))).drop("_key", "_text")
    return listings.where(~need).unionByName(filled)


def label_location(labels: Column | str, default: str) -> Column:
    """First non-empty label that does not speak of experience; else the first; else the default."""
    arr = col(labels)
    text = lambda x: F.trim(text_or_empty(x["label"]))
    good = F.filter(arr, lambda x: (text(x) != "") & ~F.contains(F.lower(text(x)), F.lit("experience")))
    return F.when(F.coalesce(F.size(arr), F.lit(0)) == 0, F.lit(default)).otherwise(
        F.coalesce(F.trim(F.get(good, 0)["label"]), F.get(arr, 0)["label"], F.lit(default))
    )


def normalize_cards(
    raw: DataFrame,
    source: str,
    as_of: Column,
    aliases: Mapping[str, Sequence[str]],
    defaults: Mapping[str, str],
    url_prefix: str = "",
) -> DataFrame:
    """Raw cards to the canonical listing columns.

    ``aliases`` names the raw columns of a field in order of preference, ``defaults``
    the value where none is present. Missing columns count as absent.
    """

    def value(name: str) -> Column:
        present = [F.nullif(F.trim(F.col(a)), F.lit("")) for a in aliases.get(name, [name]) if a in raw.columns]
        return F.coalesce(*present, F.lit(defaults.get(name, "")))

    url = value("url")
    if url_prefix:
        url = F.when(url != "", url).when(value("job_id") != "", F.concat(F.lit(url_prefix), value("job_id"))).otherwise(F.lit(""))
    extra = [c for c in ("ord",) if c in raw.columns]
    return raw.select(
        *extra, value("category").alias("category"), value("title").alias("title"),
        value("company").alias("company"), value("location").alias("location"),
        as_of.cast("string").alias("date"), value("job_id").alias("job_id"),
        value("description").alias("description"), url.alias("url"),
        F.lit(source).alias("source"), value("keyword").alias("keyword"),
    )


# Where the three shipped page layouts keep their data.
TAG_JSON_PATTERN = r'<script[^>]*type="application/json"[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
TAG_JSON_PATHS = ("props.pageProps.searchResults.jobDetails", "props.pageProps.jobList")
MARKERS = ("window._initialData=", "window.mosaic.providerData=")
MARKER_JSON_PATHS = ("results", "jobList", "jobs", "metaData.results", "searchMeta.results")
TUPLE_CARD = r'(?s)<article[^>]*class="[^"]*jobTuple[^"]*"[^>]*>(.*?)</article>'
TUPLE_FIELDS = {
    "title": Field((r'(?s)<a[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</a>',), entities=False),
    "company": Field((r'(?s)<a[^>]*class="[^"]*subTitle[^"]*"[^>]*>(.*?)</a>',), entities=False),
    "location": Field((r'(?s)<span[^>]*class="[^"]*loc[^"]*"[^>]*>(.*?)</span>',), entities=False, blank=True),
}
BEACON_CARD = r'(?s)<div[^>]*class="[^"]*job_seen_beacon[^"]*"[^>]*>.*?</div>\s*</div>\s*</td>'
BEACON_FIELDS = {
    "title": Field(
        (
            r'(?s)<h2[^>]*class="[^"]*jobTitle[^"]*"[^>]*>.*?<a[^>]*>(.*?)</a>',
            r'(?s)<a[^>]*class="[^"]*jcs-JobTitle[^"]*"[^>]*>(.*?)</a>',
        )
    ),
    "company": Field((r'(?s)<span[^>]*class="[^"]*company[^"]*"[^>]*>\s*(.*?)\s*</span>',)),
    "location": Field((r'(?s)<div[^>]*class="[^"]*location[^"]*"[^>]*>\s*(.*?)\s*</div>',), blank=True),
    "job_key": Field((r'data-jk="([^"]+)"', r'/viewjob\?jk=([^"&]+)'), clean=False),
    "description": Field((r'(?s)<div[^>]*class="[^"]*summary[^"]*"[^>]*>\s*(.*?)\s*</div>',)),
}
BASE_CARD = r'(?s)<div class="base-card[^>]*job-search-card[^>]*"(.*?)</div>\s*</li>'
BASE_FIELDS = {
    "job_key": Field((r'data-entity-urn="urn:li:jobPosting:(\d+)"', r"/jobs/view/(\d+)"), clean=False),
    "title": Field((r'(?s)<h3 class="base-search-card__title">\s*(.*?)\s*</h3>',)),
    "company": Field((r'(?s)<h4 class="base-search-card__subtitle">.*?<a[^>]*>\s*(.*?)\s*</a>',)),
    "location": Field((r'(?s)<span class="job-search-card__location">\s*(.*?)\s*</span>',), blank=True),
    "url": Field((r'<a class="base-card__full-link[^"]*" href="([^"]+)"',), clean=False),
}
DETAIL_PATTERNS = {
    "indeed": (r'<div[^>]*id="[^"]*jobDescriptionText[^"]*"[^>]*>(.*?)</div>',),
    "linkedin": (
        r'<section[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</section>',
        r'<div[^>]*class="[^"]*show-more-less-html[^"]*"[^>]*>(.*?)</div>',
    ),
}

_TAG_ROW = (
    "jobId string, id string, title string, jobTitle string, companyName string, company string, "
    "location string, placeholders array<struct<label:string>>, jobDescription string, description string"
)
TAG_JSON_SCHEMA = (
    "props struct<pageProps:struct<"
    f"searchResults:struct<jobDetails:array<struct<{_TAG_ROW.replace(' string', ':string').replace('placeholders array', 'placeholders:array')}>>>,"
    f"jobList:array<struct<{_TAG_ROW.replace(' string', ':string').replace('placeholders array', 'placeholders:array')}>>>>"
)
_MARK_ROW = (
    "struct<jk:string,jobkey:string,title:string,jobTitle:string,company:string,companyName:string,"
    "location:string,formattedLocation:string,snippet:string,description:string>"
)
MARKER_JSON_SCHEMA = (
    f"results array<{_MARK_ROW}>, jobList array<{_MARK_ROW}>, jobs array<{_MARK_ROW}>, "
    f"metaData struct<results:array<{_MARK_ROW}>>, searchMeta struct<results:array<{_MARK_ROW}>>"
)


def _or(*values: Column) -> Column:
    """First non-empty value, else empty."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def _raw(title, company, location, job_id, job_key, description, url) -> Column:
    return F.struct(
        title.alias("title"), company.alias("company"), location.alias("location"),
        job_id.alias("job_id"), job_key.alias("job_key"), description.alias("description"), url.alias("url"),
    )


def _unfold(pages: DataFrame, rows: Column, keep: Sequence[str]) -> DataFrame:
    return pages.select(*keep, F.posexplode(rows).alias("pos", "_r")).select(*keep, "pos", "_r.*")


def tag_json_listings(pages: DataFrame, keep: Sequence[str], keyword: str = "keyword", location: str = "location_hint") -> DataFrame:
    """First layout: JSON in a script tag; article cards where it gives nothing."""
    kw, place = F.col(keyword), F.col(location)
    rows = first_json_rows(json_in_tags("html", TAG_JSON_PATTERN), TAG_JSON_SCHEMA, TAG_JSON_PATHS)

    def from_json_row(r: Column) -> Column:
        jid = _or(r["jobId"], r["id"])
        return _raw(
            _or(r["title"], r["jobTitle"]), _or(r["companyName"], r["company"]),
            _or(r["location"], F.get(r["placeholders"], 0)["label"], place), jid, F.lit(""),
            _or(r["jobDescription"], r["description"]),
            F.when(jid != "", F.concat(F.lit("https://www.naukri.com/job-details/"), jid)).otherwise(F.lit("")),
        )

    def from_card(c: Column) -> Column:
        return _raw(
            c["title"], _or(c["company"], F.lit("Unknown Company")), F.coalesce(c["location"], place),
            F.replace(F.concat_ws("_", F.lit("naukri"), kw, c["company"]), F.lit(" "), F.lit("_")),
            F.lit(""), F.lit(""), F.lit(""),
        )

    a = first_rows_by_id(F.transform(rows, from_json_row), "job_id")
    found = F.filter(card_array("html", TUPLE_CARD, TUPLE_FIELDS), lambda c: c["title"] != "")
    return _unfold(pages.where(text_or_empty("html") != ""), first_parser(a, F.transform(found, from_card)), keep)


def marker_json_listings(pages: DataFrame, keep: Sequence[str], base: str, keyword: str = "keyword", location: str = "location_hint") -> DataFrame:
    """Second layout: JSON after a script marker; table cards where it gives nothing."""
    kw, place = F.col(keyword), F.col(location)
    view = lambda jk: F.concat(F.lit(f"{base}/viewjob?jk="), jk)

    def from_json_row(r: Column) -> Column:
        jk = _or(r["jk"], r["jobkey"])
        return _raw(
            _or(r["title"], r["jobTitle"]), _or(r["company"], r["companyName"]),
            _or(r["location"], r["formattedLocation"], place), F.concat(F.lit("indeed_"), jk), jk,
            clean_html(F.coalesce(F.nullif(r["snippet"], F.lit("")), r["description"], F.lit(""))), view(jk),
        )

    def from_card(c: Column) -> Column:
        jk = c["job_key"]
        synthetic = F.replace(F.concat_ws("_", F.lit("indeed"), kw, c["company"]), F.lit(" "), F.lit("_"))
        return _raw(
            _or(c["title"], F.lit("Unknown Position")), _or(c["company"], F.lit("Unknown Company")),
            F.coalesce(c["location"], place), F.when(jk != "", F.concat(F.lit("indeed_"), jk)).otherwise(synthetic),
            jk, c["description"], F.when(jk != "", view(jk)).otherwise(F.lit("")),
        )

    parsed = []
    for marker in MARKERS:
        rows = json_rows(json_after("html", marker), MARKER_JSON_SCHEMA, MARKER_JSON_PATHS)
        parsed.append(F.filter(F.transform(rows, from_json_row), lambda r: r["job_key"] != ""))
    # A marker that holds rows ends the search for markers even if none has a key.
    found = F.filter(
        card_array("html", BEACON_CARD, BEACON_FIELDS), lambda c: (c["title"] != "") | (c["job_key"] != "")
    )
    fallback = first_rows_by_id(F.transform(found, from_card), "job_id")
    return _unfold(
        pages.where(text_or_empty("html") != ""), first_parser(F.coalesce(*parsed), fallback), keep
    )


def base_card_listings(pages: DataFrame, keep: Sequence[str], keyword: str = "keyword", location: str = "location_hint") -> DataFrame:
    """Third layout: list cards; the id comes from an attribute, else from the link."""
    kw, place = F.col(keyword), F.col(location)
    found = F.filter(
        card_array("html", BASE_CARD, BASE_FIELDS), lambda c: (c["title"] != "") | (c["job_key"] != "")
    )

    def from_card(c: Column) -> Column:
        jid = c["job_key"]
        synthetic = F.replace(F.concat_ws("_", F.lit("linkedin"), kw, c["company"]), F.lit(" "), F.lit("_"))
        return _raw(
            _or(c["title"], F.lit("Unknown Position")), _or(c["company"], F.lit("Unknown Company")),
            F.coalesce(c["location"], place), F.when(jid != "", F.concat(F.lit("linkedin_"), jid)).otherwise(synthetic),
            jid, F.lit(""), c["url"],
        )

    return _unfold(pages.where(text_or_empty("html") != ""), F.transform(found, from_card), keep)

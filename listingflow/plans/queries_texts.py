"""Queries over documents, responses, projects and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingflow.functions import responses as R
from listingflow.functions import text as X
from listingflow.operators import labels, relevance, scoring, sections
from listingflow.plans.driver_tables import AS_OF, LISTINGS_SQL, as_of, listings, spread, table
from listingflow.plans.queries_listings import RULES
from listingflow.plans.registry import query, sql_any, sql_strip, sql_text
from listingflow.sources import repos, stores

# Section headings and marks over words of the test documents.
HEADINGS = [("THE ", "summary"), ("LE", "skills"), ("ER", "work"), ("DE", "projects"), ("IN", "education")]
SKILL_HEADINGS = ("LA", "QU")
LINKS = ("On", "An")
BULLETS = ("Th", "Re")

_LINES = f"""raw AS (SELECT doc_id, unnest(l) AS line0, generate_subscripts(l, 1) AS p0 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, {sql_strip('line0')} AS line0, p0 FROM raw),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p0) AS pos, line0 AS line FROM lines WHERE line0 <> '')"""


@query("trimmed_lines", f"""WITH {_LINES} SELECT doc_id, count(*) AS n, string_agg(line, '|' ORDER BY pos) AS joined FROM kept GROUP BY 1""")
def trimmed_lines(spark, d):
    lines = spread(spark, d, "documents").select("doc_id", X.trimmed_lines("text").alias("l"))
    # Like the check, leave out documents without a line.
    return lines.where(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("joined"))


_HEAD = "CASE " + " ".join(f"WHEN starts_with(u, '{h}') THEN '{label}'" for h, label in HEADINGS) + " END"
_MARKED = "CASE WHEN starts_with(line, 'Th') OR starts_with(line, 'Re') THEN '- ' || line ELSE line END"
_SECTIONS = f"""{_LINES}, marked AS (SELECT doc_id, pos, {_MARKED} AS line FROM kept),
heads AS (SELECT *, {_HEAD} AS head FROM (SELECT *, regexp_replace(upper(line), ':+$', '') AS u FROM marked)),
sec AS (SELECT doc_id, pos, line, head IS NOT NULL AS is_header,
  last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM heads)"""


def _section_lines(spark, d):
    """Documents whose lines partly carry a bullet mark."""
    docs = spread(spark, d, "documents")
    marked = F.transform(
        X.trimmed_lines("text"),
        lambda x: F.when(
            F.startswith(x, F.lit("Th")) | F.startswith(x, F.lit("Re")), F.concat(F.lit("- "), x)
        ).otherwise(x),
    )
    return sections.section_lines(docs.select("doc_id", F.array_join(marked, "\n").alias("text")), HEADINGS)


@query("running_section", f"WITH {_SECTIONS} SELECT doc_id, pos, is_header, section FROM sec")
def running_section(spark, d):
    return _section_lines(spark, d).select("doc_id", "pos", "is_header", "section")


_KIND = f"""CASE WHEN is_header THEN 'header' WHEN section = 'summary' THEN 'text'
  WHEN section = 'skills' THEN CASE WHEN {' OR '.join(f"starts_with(upper(line), '{h}')" for h in SKILL_HEADINGS)} THEN 'category' WHEN b THEN 'bullet' ELSE 'dropped' END
  WHEN section = 'work' THEN CASE WHEN b THEN 'bullet' WHEN contains(line, '—') THEN 'dated' ELSE 'entry' END
  WHEN section IN ('projects', 'dsa_projects') THEN CASE WHEN {' OR '.join(f"starts_with(line, '{p}')" for p in LINKS)} THEN 'link' WHEN b THEN 'bullet' ELSE 'entry' END
  WHEN b THEN 'bullet' ELSE 'text' END"""


@query("line_kinds", f"""WITH {_SECTIONS}, k AS (SELECT *, starts_with(line, '-') AS b FROM sec), kk AS (SELECT *, {_KIND} AS kind FROM k)
SELECT doc_id, pos, kind, CASE WHEN kind = 'bullet' THEN trim(ltrim(line, '- ')) ELSE line END AS content FROM kk""")
def line_kinds(spark, d):
    kinds = sections.line_kinds(_section_lines(spark, d), skill_headings=SKILL_HEADINGS, link_prefixes=LINKS)
    return kinds.select("doc_id", "pos", "kind", "content")


NOTES, PHRASES = ("the ", "la ", "der "), ("que le", "in the")
_DROP = " OR ".join(f"starts_with(low, '{p}')" for p in NOTES) + " OR " + " OR ".join(f"contains(low, '{p}')" for p in PHRASES)


@query("strip_notes", f"""SELECT doc_id, {sql_strip("coalesce(t, '')")} AS text FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p0) AS t FROM (
    SELECT doc_id, line, p0, lower({sql_strip('line')}) AS low FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p0 FROM documents))
  WHERE NOT ({_DROP}) GROUP BY 1) USING (doc_id)""")
def strip_notes(spark, d):
    return spread(spark, d, "documents").select("doc_id", X.drop_note_lines("text", NOTES, PHRASES).alias("text"))


@query("phrases", r"""SELECT doc_id, len(f) AS n, array_to_string(f, '|') AS joined FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_+#.\s\x0B\x1C-\x1F\x85\p{Z}]*[\p{L}\p{N}_])?'), lambda x: len(x) > 2) AS f FROM documents)""")
def phrases(spark, d):
    found = spread(spark, d, "documents").select("doc_id", X.phrases("text").alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", "|").alias("joined"))


@query("date_ranges", """SELECT o_orderkey AS ord, strftime(o_orderdate, '%b %Y') || ' – ' || strftime(o_orderdate + INTERVAL 90 DAY, '%b %Y') AS range FROM orders""")
def date_ranges(spark, d):
    month = lambda c: F.date_format(c, "MMM yyyy")
    day = F.col("o_orderdate").cast("date")
    text = F.concat(
        F.lit("Worked from "), month(day), F.lit(" – "), month(F.date_add(day, 90)), F.lit(" in 2001, not Foo 2001 to Bar 2002.")
    )
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), X.date_ranges(text).alias("r"))
    return rows.where(F.size("r") == 1).select("ord", F.col("r")[0].alias("range"))


# ---- relevance -------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9+#.]*'))"
_RANKED = f"""tok AS (SELECT item_id, unnest({_TOKENS}) AS w FROM benchmark),
vocab AS (SELECT DISTINCT w FROM tok), low AS (SELECT doc_id, lower(text) AS t FROM documents),
hit AS (SELECT doc_id, w FROM low, vocab WHERE contains(t, w)),
sc AS (SELECT doc_id, item_id, count(*) AS s FROM hit JOIN tok USING (w) GROUP BY 1, 2),
full_ AS (SELECT doc_id, item_id, coalesce(s, 0) AS s FROM (SELECT doc_id, item_id FROM documents, benchmark) LEFT JOIN sc USING (doc_id, item_id)),
ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS rank, item_id AS project, s AS relevance FROM full_)"""


def _projects(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("project_ord"), F.col("text").alias("project_text"))


@query("relevance_rank", f"WITH {_RANKED} SELECT doc_id, rank, project, relevance FROM ranked WHERE rank <= 3")
def relevance_rank(spark, d):
    return relevance.rank_projects(spread(spark, d, "documents"), _projects(spark, d), 3)


@query("project_texts", f"""WITH {_RANKED} SELECT doc_id, string_agg('Project ' || rank || ': P' || project || chr(10) || 'Technologies: Various' || chr(10) || '- ' || b.text
  || chr(10) || '- none' || chr(10) || 'GitHub: u/' || project, chr(10) ORDER BY rank) AS projects_text
FROM ranked JOIN benchmark b ON b.item_id = project WHERE rank <= 2 GROUP BY 1""")
def project_texts(spark, d):
    ranked = relevance.rank_projects(spread(spark, d, "documents"), _projects(spark, d), 2)
    item = F.col("item_id").cast("string")
    about = table(spark, d, "benchmark").select(
        F.col("item_id").alias("project_ord"), F.concat(F.lit("P"), item).alias("title"), F.lit("Various").alias("technologies"),
        F.col("text").alias("description"), F.lit("none").alias("impact"), F.concat(F.lit("u/"), item).alias("url"),
    )
    return relevance.project_texts(ranked, about)


TEMPLATE = "TARGET\nTitle: {title}\nCompany: {company}\n\nTEXT:\n{description}\n"


@query("requests", f"""WITH {LISTINGS_SQL} SELECT ord, 'TARGET' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company || chr(10) || chr(10) || 'TEXT:' || chr(10) || description || chr(10) AS request FROM listings""")
def requests(spark, d):
    names = {n: n for n in ("title", "company", "description")}
    return relevance.requests(listings(spark, d), TEMPLATE, names).select("ord", "request")


# ---- responses -------------------------------------------------------------

_MIXED = """mixed AS (SELECT conv_id, turn, role, text,
  CASE WHEN turn % 3 = 2 THEN text ELSE 'intro===TAILORED_CV===' || chr(10) || text || chr(10) || '===COVER_LETTER===' ||
    CASE WHEN turn % 3 = 1 THEN chr(10) || 'letter ' || role || chr(10) ELSE chr(10) END || '===INTERVIEW_PREP===prep ' || turn || '===REVIEW===r'
    || '===ACCEPTANCE_CHANCE===' || CASE conv_id % 4 WHEN 0 THEN conv_id || ' %' WHEN 1 THEN 'about 1' || conv_id || '234' WHEN 2 THEN 'none' ELSE '' END END AS response
  FROM conversations)"""


def _mixed(spark, d):
    """Turns wrapped as landed responses: two of three with blocks, some without a letter."""
    c = table(spark, d, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    part = F.col("turn") % 3
    letter = F.when(part == 1, F.concat(F.lit("\nletter "), F.col("role"), F.lit("\n"))).otherwise(F.lit("\n"))
    kind = F.col("conv_id") % 4
    chance = (
        F.when(kind == 0, F.concat(conv, F.lit(" %"))).when(kind == 1, F.concat(F.lit("about 1"), conv, F.lit("234")))
        .when(kind == 2, F.lit("none")).otherwise(F.lit(""))
    )
    wrapped = F.concat(
        F.lit("intro===TAILORED_CV===\n"), F.col("text"), F.lit("\n===COVER_LETTER==="), letter,
        F.lit("===INTERVIEW_PREP===prep "), turn, F.lit("===REVIEW===r===ACCEPTANCE_CHANCE==="), chance,
    )
    return c.withColumn("response", F.when(part == 2, F.col("text")).otherwise(wrapped))


_CHANCE = "CASE WHEN turn % 3 = 2 OR conv_id % 4 >= 2 THEN 50 WHEN conv_id % 4 = 0 THEN least(100, CASE WHEN conv_id < 1000 THEN conv_id ELSE 100 END) ELSE 100 END"


@query("block_extract", f"""WITH {_MIXED} SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE {sql_strip('text')} END AS tailored,
  CASE WHEN turn % 3 = 1 THEN 'letter ' || role ELSE '' END AS cover_letter, CASE WHEN turn % 3 = 2 THEN '' ELSE 'prep ' || turn || '===REVIEW===r' END AS prep FROM mixed""")
def block_extract(spark, d):
    m = _mixed(spark, d)
    return m.select(
        "conv_id", "turn", R.block("response", "TAILORED_CV").alias("tailored"),
        R.block("response", "COVER_LETTER").alias("cover_letter"), R.block("response", "INTERVIEW_PREP").alias("prep"),
    )


@query("parsed_responses", f"""WITH {_MIXED}, lines AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY p) AS t FROM (
    SELECT conv_id, turn, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS p FROM (
      SELECT conv_id, turn, {sql_strip('text')} AS b FROM conversations)) WHERE NOT starts_with(lower({sql_strip('line')}), 'the ') GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 <> 2 THEN nullif({sql_strip("coalesce(t, '')")}, '') END, response) AS tailored,
  CASE WHEN turn % 3 = 1 THEN 'letter ' || role END AS cover_letter, CAST({_CHANCE} AS INTEGER) AS chance
FROM mixed LEFT JOIN lines USING (conv_id, turn)""")
def parsed_responses(spark, d):
    p = R.parsed_response("response", ("the ",), ())
    return _mixed(spark, d).select("conv_id", "turn", *[p[n].alias(n) for n in ("tailored", "cover_letter", "chance")])


_SCORE_TEXT = "CASE WHEN turn % 2 = 0 THEN text || ' chance ' || (conv_id * 7) || '%' ELSE text END"


@query("extract_score", f"""SELECT conv_id, turn, CAST(least(100, CASE WHEN a <> '' THEN a::INTEGER WHEN g = '' THEN 50 WHEN len(ltrim(g, '0')) > 3 THEN 100
    ELSE coalesce(try_cast(ltrim(g, '0') AS INTEGER), 0) END) AS INTEGER) AS score FROM (
  SELECT conv_id, turn, regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,3}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) AS a, regexp_replace(s, '[^0-9]', '', 'g') AS g
  FROM (SELECT conv_id, turn, {_SCORE_TEXT} AS s FROM conversations))""")
def extract_score(spark, d):
    c = table(spark, d, "conversations")
    text = F.when(
        F.col("turn") % 2 == 0, F.concat("text", F.lit(" chance "), (F.col("conv_id") * 7).cast("string"), F.lit("%"))
    ).otherwise(F.col("text"))
    return c.select("conv_id", "turn", R.percent_score(text).alias("score"))


@query("ats_decision", f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(least(100, conv_id % 130) AS INTEGER) END AS ats,
  CASE WHEN turn % 4 = 1 OR (turn % 3 <> 0 AND conv_id % 130 >= 90) THEN text ELSE 'better ' || role END AS final_text FROM conversations""")
def ats_decision(spark, d):
    c = table(spark, d, "conversations")
    score = F.concat(F.lit("Review. ATS  score : "), (F.col("conv_id") % 130).cast("string"), F.lit("/100\n"))
    improved = F.concat(F.lit("===IMPROVED_CV===\nbetter "), F.col("role"), F.lit(" "))
    review = F.concat(
        F.when(F.col("turn") % 3 == 0, F.lit("no number ")).otherwise(score),
        F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(improved),
    )
    rows = c.withColumn("review", review)
    return rows.select(
        "conv_id", "turn", R.review_score("review").alias("ats"), R.reviewed_text("text", "review").alias("final_text")
    )


RESPONSE_LABELS = ("The", "Une", "Der")


@query("response_label", f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(lower(text), '{v.lower()}') THEN '{v}'" for v in RESPONSE_LABELS)} ELSE role END AS label FROM conversations""")
def response_label(spark, d):
    c = table(spark, d, "conversations")
    return labels.response_label(c, "text", RESPONSE_LABELS, "role").select("conv_id", "turn", "label")


@query("application_rows", f"""WITH {_MIXED} SELECT role AS title, CAST(conv_id AS VARCHAR) AS company, (turn % 10)::DOUBLE * 10 AS match_pct,
  CASE WHEN turn % 3 = 2 THEN '' ELSE 'prep ' || turn || '===REVIEW===r' END AS prep,
  CAST(CASE WHEN {_CHANCE} = 0 THEN 50 ELSE {_CHANCE} END AS INTEGER) AS chance, 'Applied' AS status, '{AS_OF}' AS date FROM mixed""")
def application_rows(spark, d):
    rows = _mixed(spark, d).select(
        F.col("role").alias("title"), F.col("conv_id").cast("string").alias("company"),
        (F.col("turn") % 10).cast("double").alias("score"), "response",
    )
    return stores.application_rows(rows, "response", as_of())


# ---- profiles and repositories ---------------------------------------------


@query("profile_features", f"""SELECT item_id, {", ".join(
    f"CASE WHEN contains(lower(text), {sql_text(r)}) THEN 1.0::DOUBLE WHEN {sql_any('lower(text)', t)} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS role{i}"
    for i, (r, t) in enumerate(RULES.roles.items()))},
  {" + ".join(f"CASE WHEN contains(lower(text), {sql_text(t)}) THEN 1 ELSE 0 END" for t in RULES.terms)} AS known, '3' AS years FROM benchmark""")
def profile_features(spark, d):
    f = scoring.profile_table(table(spark, d, "benchmark"), RULES)
    known = F.size(F.array_distinct(F.flatten(F.col("features")["known"])))
    return f.select(
        "item_id", *[F.col("features")["role_values"][i].alias(f"role{i}") for i in range(len(RULES.roles))],
        known.alias("known"), F.col("features")["years"].alias("years"),
    )


@query("repo_projects", """SELECT source || '-' || doc_id AS title, CASE WHEN doc_id % 4 = 1 THEN 'about ' || lang ELSE coalesce(nullif(substr(text, 1, 200), ''), 'No description available') END AS description,
  CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_slice(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), 1, 5), ', ')
       WHEN doc_id % 3 = 1 THEN lang ELSE 'Various' END AS technologies, 'git/' || doc_id AS url
FROM (SELECT doc_id, source, lang, text FROM documents) WHERE doc_id % 5 <> 0""")
def repo_projects(spark, d):
    return repos.projects(repo_metadata(spark, d))


def repo_metadata(spark, d):
    """Repository metadata with encoded texts, made from the documents."""
    doc = spread(spark, d, "documents")
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")
    kind = F.col("doc_id") % 3
    return doc.select(
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("about "), F.col("lang"))).alias("description"),
        F.concat(F.lit("git/"), F.col("doc_id").cast("string")).alias("html_url"),
        F.when(kind == 1, F.col("lang")).otherwise(F.lit("")).alias("language"),
        (F.col("doc_id") % 5 == 0).alias("fork"), F.when(kind == 0, words).alias("languages"),
        F.base64(F.col("text").cast("binary")).alias("content"),
    )

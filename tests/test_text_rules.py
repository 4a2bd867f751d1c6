"""Text functions, rules and response parsing on hand-derived cases."""

import base64

from pyspark.sql import functions as F

from listingflow import defaults as D
from listingflow.functions import responses as R
from listingflow.functions import rules, text as X
from listingflow.operators import labels, sections
from listingflow.functions.rules import blacklist_hit
from listingflow.sources import repos


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("r")).first()["r"]


def test_normalisers(spark):
    n = lambda v: one(spark, X.normalize_match("c"), v)
    assert n("a - b") == "a  b"
    assert n("  Ünï  Code_1!  ") == "ünï code_1"
    assert n("é́x") == "éx" or n("é́x") == "éx"
    assert n(None) == ""
    assert one(spark, X.normalize_score("c"), " A\t\nB  - c ") == "a b - c"
    assert one(spark, X.url_fingerprint("c"), "a.com/b") == one(spark, X.url_fingerprint("c"), "acom/b")
    assert one(spark, X.url_fingerprint("c"), "") == ""
    assert len(one(spark, X.url_fingerprint("c"), "!")) == 64


def test_slug_html_and_ids(spark):
    assert one(spark, X.slug("c"), "  Data--Analyst (BI) & x ") == "data_analyst_bi_x"
    assert len(one(spark, X.slug("c"), "ab " * 60)) == 60
    assert one(spark, X.clean_html("c"), "<p>a&amp;lt;b</p>\n<b>c</b>&nbsp;") == "a<b c"
    assert one(spark, X.synthetic_id("s", F.col("c"), F.lit("B C")), "k w") == "s_k_w_B_C"
    assert one(spark, X.percent_encode("c"), "a b/ü*~") == "a%20b/%C3%BC%2A~"
    assert one(spark, X.form_encode("c"), "a b/*~") == "a+b%2F%2A~"


def test_lists_from_text(spark):
    assert one(spark, X.trimmed_lines("c"), " a \n\n\t\nb") == ["a", "b"]
    assert one(spark, X.relevance_tokens("c"), "C++ c++ node.js 3d") == ["c++", "node.js", "d"]
    assert one(spark, X.phrases("c"), "C++ and .NET core; ab (x)") == ["c++ and .net core"]
    assert one(spark, X.date_ranges("c"), "Jan 2020 – Mar 2021, May 2019 to Jun 2020, x") == ["Jan 2020 – Mar 2021", "May 2019 to Jun 2020"]
    note = one(spark, X.drop_note_lines("c", D.NOTE_PREFIXES, D.NOTE_PHRASES), "Note: x\nkeep\n I've done\n")
    assert note == "keep"
    preview = base64.b64encode("é".encode() * 400 + b"\xff").decode()
    assert one(spark, X.readme_preview("c"), preview) == "é" * 400 + "�"


def test_category_rules_keep_their_order(spark):
    c = lambda v: one(spark, rules.first_rule("c", D.CATEGORY_RULES, D.DEFAULT_CATEGORY), v)
    assert c("GenAI Engineer") == "agentic_ai"
    assert c("Finance Intern") == "finance_roles"
    assert c("AI Intern") == "fresher_ai_ml"
    assert c("Gardener") == "data_analyst"


def test_labels(spark):
    rows = [
        (0, "Senior LLM and GenAI lead", "", ""), (1, "Cook", "sql sql power bi tableau excel pandas", ""),
        (2, "Qwxyz", "zzz", ""), (3, "Machine Learning / Data Analyst", "", ""), (4, "dax", "power query", ""),
    ]
    df = spark.createDataFrame(rows, "ord long, title string, description string, category string")
    out = labels.detect_label(df, D.TITLE_PATTERNS, D.TITLE_PRECEDENCE, D.PROFILE_KEYWORDS, D.KEYWORD_PREFERENCE, D.DEFAULT_LABEL)
    got = {r["ord"]: r["label"] for r in out.collect()}
    assert got == {0: "genai", 1: "data analyst", 2: "data analyst", 3: "machine learning engineer", 4: "power bi"}
    resp = spark.createDataFrame([("I think: power bi.", "f"), ("none", "f")], "response string, fallback string")
    assert [r["label"] for r in labels.response_label(resp, "response", D.RESPONSE_LABELS, "fallback").collect()] == ["Power BI", "f"]


def test_blacklist_is_plain_substring(spark):
    hit = lambda v: one(spark, blacklist_hit(["c"], ["RCM", " BPO "]), v)
    assert hit("Farcm Ltd") and hit("x bpo") and not hit("rc m") and not hit(None)


def test_levels(spark):
    df = spark.createDataFrame([("LinkedIn", "Mid level"), ("x", "y")], "s string, l string")
    assert [r[0] for r in df.select(rules.lookup_code(D.EXPERIENCE_CODES, "s", "l")).collect()] == ["4", None]


def test_blocks_and_scores(spark):
    text = "x===TAILORED_CV===\n a ===REVIEW=== b\n===INTERVIEW_PREP===p===ACCEPTANCE_CHANCE=== 75% "
    assert one(spark, R.block("c", "TAILORED_CV"), text) == "a ===REVIEW=== b"
    assert one(spark, R.block("c", "REVIEW"), text) == "b"
    assert one(spark, R.block("c", "COVER_LETTER"), text) == ""
    s = lambda v: one(spark, R.percent_score("c"), v)
    assert [s("75%"), s("1500"), s(""), s("0"), s("about 40 or 60"), s("0000"), s("x12y")] == [75, 100, 50, 0, 40, 0, 12]
    a = lambda v: one(spark, R.review_score("c"), v)
    assert [a("ats score: 91"), a("ATS Score 400"), a("none")] == [91, 100, None]
    r = lambda v: one(spark, R.reviewed_text(F.lit("old"), "c"), v)
    assert r("ATS Score: 50 ===IMPROVED_CV=== new") == "new"
    assert r("ATS Score: 90 ===IMPROVED_CV=== new") == "old"
    assert r("===IMPROVED_CV=== new") == "new" and r("ATS Score: 1") == "old"
    assert one(spark, R.acceptance_chance("c"), "===ACCEPTANCE_CHANCE===0") == 50


def test_section_lines_and_kinds(spark):
    text = "Jo\nProfessional Summary:\n- s\nTECHNICAL SKILLS\nProgramming: x\n- py\nother\nWork Experience\nA — B\nC\n- d\nGithub Projects\nGitHub: u\nP\nEducation\n- e\nf"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "only")], "doc_id long, text string")
    rows = sections.line_kinds(sections.section_lines(df)).orderBy("doc_id", "pos").collect()
    kinds = [(r["line"], r["section"], r["kind"]) for r in rows if r["doc_id"] == 1]
    assert [k for _, _, k in kinds] == [
        "text", "header", "text", "header", "category", "bullet", "dropped", "header", "dated", "entry", "bullet",
        "header", "link", "entry", "header", "bullet", "text",
    ]
    assert kinds[9][1] == "work" and kinds[0][1] is None
    assert [r["pos"] for r in rows if r["doc_id"] == 1] == list(range(1, 18))
    assert [(r["line"], r["section"]) for r in rows if r["doc_id"] == 3] == [("only", None)]


def test_repo_projects(spark):
    content = base64.b64encode(("r" * 700).encode()).decode()
    rows = [
        ("a", None, "u1", "Go", False, ["A", "B", "C", "D", "E", "F"], content),
        ("b", "d", "u2", None, None, [], None), ("", "d", "u", "", False, None, None), ("f", "d", "u", "", True, None, None),
        ("c", "", "u3", "Go", False, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, description string, html_url string, language string, fork boolean, languages array<string>, content string")
    got = {r["title"]: (r["description"], r["technologies"]) for r in repos.projects(df).collect()}
    assert got == {
        "a": ("r" * 200, "A, B, C, D, E"), "b": ("d", "Various"), "c": ("No description available", "Go"),
    }


def test_a_blank_language_list_is_shown_as_it_is(spark):
    rows = [("a", "d", "u", "Go", False, [""], None)]
    df = spark.createDataFrame(rows, "name string, description string, html_url string, language string, fork boolean, languages array<string>, content string")
    assert repos.projects(df).first()["technologies"] == ""

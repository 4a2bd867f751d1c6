"""Text column functions: normalisers, fingerprints, slugs, tokenisers, HTML cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and word classes with the Unicode meaning of a text-processing
# script language; Java's own \s and \w are ASCII only.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_ ]"
# Runs of two or more whitespace characters, or one that is not a plain space.
# Single plain spaces are left alone, which saves most of the replacements.
_WS_TO_SPACE = WS + r"{2,}|[\s\x0B\x1C-\x1F\x85\p{Z}&&[^ ]]"
_EDGE_WS = f"^{WS}+|{WS}+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Missing text counts as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace at both ends (SQL ``trim`` knows the space only)."""
    return F.regexp_replace(col(c), _EDGE_WS, "")


def collapse(c: Column | str) -> Column:
    """Each whitespace run becomes one space."""
    return F.regexp_replace(col(c), _WS_TO_SPACE, " ")


def normalize_match(c: Column | str) -> Column:
    """Key form of a text: lower case, single spaces, then punctuation dropped.

    Whitespace is collapsed before punctuation goes, so ``a - b`` keeps two spaces.
    """
    spaced = F.trim(collapse(F.lower(text_or_empty(c))))
    return F.trim(F.regexp_replace(spaced, NON_WORD, ""))


def normalize_score(c: Column | str) -> Column:
    """Scoring form of a text: lower case, single spaces, punctuation kept."""
    return F.trim(collapse(F.lower(text_or_empty(c))))


def content_fingerprint(company, title, location) -> Column:
    """Digest of the normalised company, title and location, each cut to size."""
    parts = [(company, 50), (title, 80), (location, 50)]
    return F.sha2(
        F.concat_ws("|", *[F.substring(normalize_match(c), 1, n) for c, n in parts]), 256
    )


def url_fingerprint(url) -> Column:
    """Digest of the normalised URL; the empty string where there is no URL."""
    return F.when(text_or_empty(url) == "", F.lit("")).otherwise(
        F.sha2(normalize_match(url), 256)
    )


def exact_key(*columns: Column | str) -> Column:
    """One digest over several columns; lengths are included so that no two
    different tuples share the digested text."""
    parts = []
    for c in columns:
        value = text_or_empty(c)
        parts += [F.length(value).cast("string"), F.lit(":"), value]
    return F.sha2(F.concat(*parts), 256)


def short_digest(c: Column | str) -> Column:
    """The first 16 bytes of a text's digest; null for none."""
    return F.substring(F.unhex(F.sha2(col(c), 256)), 1, 16)


def slug(c: Column | str, length: int = 60) -> Column:
    """Lower-case name with runs of dashes and spaces turned into one underscore."""
    kept = F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}-]", "")
    joined = F.regexp_replace(F.lower(strip(kept)), r"[\s\x0B\x1C-\x1F\x85\p{Z}-]+", "_")
    return F.substring(joined, 1, length)


def clean_html(c: Column | str) -> Column:
    """Tags become spaces, six entities are decoded in a fixed order, spaces collapse."""
    out = F.regexp_replace(text_or_empty(c), "<[^>]+>", " ")
    # Entity, text; the order decides what "&amp;lt;" becomes.
    for entity, plain in [
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&nbsp;", " "),
    ]:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(collapse(out))


def synthetic_id(source: str, keyword, company) -> Column:
    """Id for a card that carries none."""
    joined = F.concat_ws("_", F.lit(source), text_or_empty(keyword), text_or_empty(company))
    return F.replace(joined, F.lit(" "), F.lit("_"))


def trimmed_lines(c: Column | str) -> Column:
    """Non-empty lines, each stripped."""
    lines = F.transform(F.split(text_or_empty(c), "\n"), strip)
    return F.filter(lines, lambda x: x != "")


def drop_note_lines(c: Column | str, prefixes: Sequence[str], phrases: Sequence[str]) -> Column:
    """Remove lines that only explain the text: by prefix or by contained phrase."""

    def keep(line: Column) -> Column:
        low = F.lower(strip(line))
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(low, F.lit(p))
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        return ~hit

    return strip(F.array_join(F.filter(F.split(text_or_empty(c), "\n"), keep), "\n"))


def relevance_tokens(c: Column | str) -> Column:
    """Distinct tokens that begin with a letter and may carry digits, +, # and dots."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-zA-Z][a-zA-Z0-9+#.]*"), F.lit(0))
    )


def distinct_runs(c: Column | str) -> Column:
    """The different runs of token characters of a text.

    A relevance token is part of the text exactly if it is part of one of its runs.
    """
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9+#.]+"), F.lit(0))
    )


def phrases(c: Column | str, longer_than: int = 2) -> Column:
    """Phrases longer than a few characters: words, +, # and dots joined by whitespace,
    from the first word character of the run to its last."""
    word = r"\p{L}\p{N}_"
    inside = rf"[{word}+#.\s\x0B\x1C-\x1F\x85\p{{Z}}]"
    found = F.regexp_extract_all(
        F.lower(text_or_empty(c)), F.lit(f"[{word}](?:{inside}*[{word}])?"), F.lit(0)
    )
    return F.filter(found, lambda x: F.length(x) > longer_than)


# Month names of a date range.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def date_ranges(c: Column | str) -> Column:
    """All ranges of the form ``Mon YYYY - Mon YYYY`` with any dash or the word "to"."""
    m = f"(?:{MONTHS})"
    pattern = f"{m}{WS}+[0-9]{{4}}{WS}*(?:[–—-]|to){WS}*{m}{WS}+[0-9]{{4}}"
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0))


def percent_encode(c: Column | str, safe_slash: bool = True) -> Column:
    """Percent-encoding for a URL path; spaces become ``%20``."""
    out = F.url_encode(text_or_empty(c))
    for found, wanted in [("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if safe_slash else out


def form_encode(c: Column | str) -> Column:
    """Encoding for a query string; spaces become ``+``."""
    out = F.url_encode(text_or_empty(c))
    for found, wanted in [("*", "%2A"), ("%7E", "~")]:
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def render(template: str, values: dict[str, Column | str]) -> Column:
    """Fill ``{name}`` places of a template with columns; the result is one text column."""
    pieces: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(text_or_empty(values[rest[start + 1 : end]]).cast("string"))
        rest = rest[end + 1 :]
    return F.concat(*pieces) if pieces else F.lit("")


def readme_preview(c: Column | str, length: int = 500) -> Column:
    """First characters of a base64-encoded text file."""
    return F.substring(F.make_valid_utf8(F.unbase64(text_or_empty(c))), 1, length)


def decode_response(raw: Column | str) -> Column:
    """Bytes to text; bytes that are not UTF-8 become replacement characters."""
    return F.make_valid_utf8(col(raw).cast("string"))

"""Column functions over landed model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.text import WS, col, drop_note_lines, strip, text_or_empty

# Labels that end a block.
BLOCK_LABELS = (
    "TAILORED_CV",
    "COVER_LETTER",
    "INTERVIEW_PREP",
    "ACCEPTANCE_CHANCE",
    "IMPROVED_CV",
)

_WORD = r"[\p{L}\p{N}_]"


def block(text: Column | str, label: str) -> Column:
    """Text between ``===label===`` and the next known label; empty if absent.

    A label outside the known list opens a block of its own but ends none.
    """
    c = text_or_empty(text)
    mark = f"==={label}==="
    body = F.substr(c, F.instr(c, mark) + F.lit(len(mark)))
    for other in BLOCK_LABELS:
        if other != label:
            body = F.substring_index(body, f"==={other}===", 1)
    return F.when(F.contains(c, F.lit(mark)), strip(body)).otherwise(F.lit(""))


def percent_score(text: Column | str, default: int = 50) -> Column:
    """First stand-alone number of up to three digits, else all digits joined; 0 to 100."""
    c = text_or_empty(text)
    alone = F.regexp_extract(c, rf"(?<!{_WORD})([0-9]{{1,3}})(?!{_WORD})", 1)
    digits = F.regexp_replace(c, "[^0-9]", "")
    significant = F.ltrim(digits, F.lit("0"))
    joined = (
        F.when(digits == "", F.lit(default))
        .when(F.length(significant) > 3, F.lit(100))
        .otherwise(F.coalesce(significant.try_cast("int"), F.lit(0)))
    )
    return F.least(F.lit(100), F.when(alone != "", alone.try_cast("int")).otherwise(joined))


def review_score(text: Column | str) -> Column:
    """Number after "ATS Score", at most 100; null where the text names none."""
    found = F.regexp_extract(text_or_empty(text), rf"(?i)ATS{WS}*Score{WS}*:?{WS}*([0-9]+)", 1)
    significant = F.ltrim(found, F.lit("0"))
    value = F.when(F.length(significant) > 3, F.lit(100)).otherwise(
        F.least(F.lit(100), F.coalesce(significant.try_cast("int"), F.lit(0)))
    )
    return F.when(found != "", value)


def reviewed_text(original: Column | str, review: Column | str, good_enough: int = 90) -> Column:
    """The improved text, unless it is missing or the original already scores well."""
    improved = block(review, "IMPROVED_CV")
    score = review_score(review)
    keep = (improved == "") | F.coalesce(score >= good_enough, F.lit(False))
    return F.when(keep, col(original)).otherwise(improved)


def acceptance_chance(text: Column | str) -> Column:
    """Chance from a response; zero and missing both count as 50 in the log."""
    chance = percent_score(block(text, "ACCEPTANCE_CHANCE"))
    return F.coalesce(F.nullif(chance, F.lit(0)), F.lit(50))


def parsed_response(response: Column | str, note_prefixes, note_phrases) -> dict[str, Column]:
    """The parts of a generation response. Without a block for the text, the whole
    response is the text; an empty cover letter is null and has to be requested."""
    tailored = drop_note_lines(block(response, "TAILORED_CV"), note_prefixes, note_phrases)
    chance = block(response, "ACCEPTANCE_CHANCE")
    return {
        "tailored": F.coalesce(F.nullif(tailored, F.lit("")), text_or_empty(response)),
        "cover_letter": F.nullif(block(response, "COVER_LETTER"), F.lit("")),
        "prep": block(response, "INTERVIEW_PREP"),
        "chance": F.when(chance == "", F.lit(50)).otherwise(percent_score(chance)),
    }

"""Rule tables compiled to ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.text import col, text_or_empty


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True where the text holds one of the terms as a plain substring."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(c, F.lit(t))
    return hit


def first_rule(c: Column | str, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule with a term in the text; rule order is meaningful."""
    low = F.lower(text_or_empty(c))
    out: Column | None = None
    for terms, label in rules:
        cond = contains_any(low, terms)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def first_pattern(c: Column | str, rules: Mapping[str, Sequence[str]], order: Sequence[str]) -> Column:
    """First label, in precedence order, with a pattern found in the text; else null."""
    low = F.lower(text_or_empty(c))
    out: Column | None = None
    for label in order:
        cond = F.lit(False)
        for pattern in rules[label]:
            cond = cond | low.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(None).cast("string") if out is None else out


def keyword_points(low_title: Column, text: Column, keyword: str) -> Column:
    """3 for a keyword in the title, else 2 for one anywhere in the text, else 0."""
    return (
        F.when(F.contains(low_title, F.lit(keyword)), 3)
        .when(F.contains(text, F.lit(keyword)), 2)
        .otherwise(0)
    )


def best_label(totals: Mapping[str, Column], preference: Sequence[str], default: str) -> Column:
    """Label with the highest total; ties go to the preference list, all zero to the default.

    The maximum is taken over structs inside the row, so nothing is shuffled.
    """
    scored = []
    for label, total in totals.items():
        rank = preference.index(label) if label in preference else len(preference)
        scored.append(
            F.struct(total.alias("score"), F.lit(-rank).alias("rank"), F.lit(label).alias("label"))
        )
    top = F.array_max(F.array(*scored))
    return F.when(top["score"] == 0, F.lit(default)).otherwise(top["label"])


def label_in_response(response: Column | str, labels: Sequence[str], fallback: Column) -> Column:
    """First valid label contained in a landed response; else the fallback column."""
    low = F.lower(text_or_empty(response))
    out: Column | None = None
    for label in labels:
        cond = F.contains(low, F.lit(label.lower()))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return fallback if out is None else out.otherwise(fallback)


def blacklist_hit(columns: Sequence[Column | str], terms: Sequence[str]) -> Column:
    """True where any term is part of any column, ignoring case and outer spaces."""
    cleaned = [t.lower().strip() for t in terms]
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_any(F.lower(text_or_empty(c)), cleaned)
    return hit


def lookup_code(table: Mapping[str, Mapping[str, str]], source: Column | str, level: Column | str) -> Column:
    """Two-step constant lookup, such as experience level to a source's own code."""
    pairs = []
    for src, codes in table.items():
        inner = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
        pairs += [F.lit(src), inner]
    return F.try_element_at(F.try_element_at(F.create_map(*pairs), F.lower(col(source))), col(level))


def starts_with_rule(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first heading the line begins with (a trailing colon is ignored)."""
    head = F.regexp_replace(F.upper(F.trim(c)), ":+$", "")
    out: Column | None = None
    for heading, label in rules:
        cond = F.startswith(head, F.lit(heading))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(None).cast("string") if out is None else out

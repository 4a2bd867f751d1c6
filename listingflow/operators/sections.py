"""Lines of a document, the section each belongs to, and what kind of line it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.defaults import LINK_PREFIXES, SECTION_HEADINGS, SKILL_HEADINGS
from listingflow.functions.rules import starts_with_rule
from listingflow.functions.text import trimmed_lines


def section_lines(
    docs: DataFrame,
    headings: Sequence[tuple[str, str]] = SECTION_HEADINGS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per line: (doc_id, pos, line, is_header, section).

    A section runs from its heading to the next one. The lines of a document are
    cut into sections inside the row, in time linear in its length, and then
    unfolded: no shuffle and no window over a document.
    """
    lines = docs.select(doc_id, trimmed_lines(text).alias("_lines"))
    heads = lines.withColumn(
        "_heads",
        F.filter(
            F.transform(
                "_lines",
                lambda line, i: F.struct(
                    (i + 1).alias("start"), starts_with_rule(line, headings).alias("label")
                ),
            ),
            lambda h: h["label"].isNotNull(),
        ),
    )
    no_head = F.struct(F.lit(1).alias("start"), F.lit(None).cast("string").alias("label"))
    starts = heads.withColumn("_starts", F.concat(F.array(no_head), F.col("_heads")))
    end = F.size("_lines") + 1
    pieces = F.transform(
        "_starts",
        lambda s, i: F.struct(
            s["label"].alias("label"),
            s["start"].alias("start"),
            (F.coalesce(F.get("_starts", i + 1)["start"], end) - s["start"]).alias("len"),
        ),
    )
    sections = starts.select(doc_id, "_lines", F.explode(pieces).alias("_s"))
    cut = sections.where(F.col("_s")["len"] > 0).select(
        doc_id,
        F.col("_s")["label"].alias("section"),
        F.col("_s")["start"].alias("_start"),
        F.slice("_lines", F.col("_s")["start"], F.col("_s")["len"]).alias("_part"),
    )
    return cut.select(
        doc_id, "section", "_start", F.posexplode("_part").alias("_at", "line")
    ).select(
        doc_id,
        (F.col("_start") + F.col("_at")).alias("pos"),
        "line",
        ((F.col("_at") == 0) & F.col("section").isNotNull()).alias("is_header"),
        "section",
    )


def line_kind(
    line: Column,
    section: Column,
    is_header: Column,
    skill_headings: Sequence[str] = SKILL_HEADINGS,
    link_prefixes: Sequence[str] = LINK_PREFIXES,
) -> Column:
    """header, text, category, bullet, dated, entry, link or dropped."""
    bullet = F.startswith(line, F.lit("-"))
    category = F.lit(False)
    for h in skill_headings:
        category = category | F.startswith(F.upper(line), F.lit(h))
    link = F.lit(False)
    for p in link_prefixes:
        link = link | F.startswith(line, F.lit(p))
    skills = F.when(category, "category").when(bullet, "bullet").otherwise("dropped")
    work = F.when(bullet, "bullet").when(F.contains(line, F.lit("—")), "dated").otherwise("entry")
    project = F.when(link, "link").when(bullet, "bullet").otherwise("entry")
    return (
        F.when(is_header, "header")
        .when(section == "summary", "text")
        .when(section == "skills", skills)
        .when(section == "work", work)
        .when(section.isin("projects", "dsa_projects"), project)
        .when(bullet, "bullet")
        .otherwise("text")
    )


def line_kinds(lines: DataFrame, **rules) -> DataFrame:
    """Add the kind of each line, and its text without the bullet mark."""
    kind = line_kind(F.col("line"), F.col("section"), F.col("is_header"), **rules)
    return lines.withColumn("kind", kind).withColumn(
        "content",
        F.when(F.col("kind") == "bullet", F.trim(F.ltrim(F.col("line"), F.lit("- ")))).otherwise(F.col("line")),
    )

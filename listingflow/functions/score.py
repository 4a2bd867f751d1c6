"""Weighted rule score of a listing against a profile, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.rules import contains_any
from listingflow.functions.text import WS, col, normalize_score, text_or_empty

_MASK_BITS = 62


@dataclass(frozen=True)
class ScoreRules:
    """Term lists, weights and thresholds of the score.

    ``roles`` maps a role to the terms that reveal it, ``lexicons`` a category to
    its skill terms; an unknown category uses ``default_category``.
    """

    roles: Mapping[str, tuple[str, ...]]
    lexicons: Mapping[str, tuple[str, ...]]
    default_category: str
    # Shipped weights, defaults and places of the score.
    role_weight: float = 0.35
    skills_weight: float = 0.25
    experience_weight: float = 0.15
    location_weight: float = 0.10
    recency_weight: float = 0.05
    partial_role: float = 0.6
    default_required_years: int = 2
    default_profile_years: int = 3
    remote_places: tuple[str, ...] = ("remote", "work from home", "all india")
    hybrid_word: str = "hybrid"
    shown_skills: int = 5
    terms: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        if self.default_category not in self.lexicons:
            raise ValueError(f"no lexicon for default category {self.default_category!r}")
        if any(", " in t for words in self.lexicons.values() for t in words):
            raise ValueError("skill terms must not contain ', '")
        every = sorted({t for words in self.lexicons.values() for t in words})
        object.__setattr__(self, "terms", tuple(every))


def number_text(digits: Column) -> Column:
    """Digits without leading zeros, as an integer would print."""
    return F.regexp_replace(digits, "^0+([0-9])", "$1")


def one_decimal(raw: Column) -> Column:
    """Round half up on the double itself, the same in every engine."""
    return F.floor(raw * 10 + 0.5).cast("double") / 10


def two_decimals(raw: Column) -> Column:
    return F.floor(raw * 100 + 0.5).cast("double") / 100


def profile_features(text: Column | str, rules: ScoreRules) -> Column:
    """What the score needs to know of one profile: role values, the terms of each
    lexicon it knows, and years."""
    low = F.lower(text_or_empty(text))
    role_values = F.array(
        *[
            F.when(F.contains(low, F.lit(role)), F.lit(1.0))
            .when(contains_any(low, terms), F.lit(rules.partial_role))
            .otherwise(F.lit(0.0))
            for role, terms in rules.roles.items()
        ]
    )
    known = F.array(
        *[
            F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))
            for terms in rules.lexicons.values()
        ]
    )
    digits = F.regexp_extract(
        low, rf"([0-9]+)\+?{WS}*(?:years|yrs){WS}+(?:of{WS}+)?experience", 1
    )
    years = F.when(digits == "", F.lit(str(rules.default_profile_years))).otherwise(number_text(digits))
    return F.struct(
        role_values.alias("role_values"), known.alias("known"), years.alias("years")
    )


def normalized_texts(title, description) -> tuple[Column, Column]:
    return normalize_score(title), normalize_score(description)


def term_lists(lists) -> Column:
    """Constant array of term arrays."""
    return F.array(*[F.array(*[F.lit(t) for t in terms]) for terms in lists])


def role_hits(both: Column, rules: ScoreRules) -> Column:
    """One flag per role: a term of the role occurs in title or description.

    Long texts are searched in a loop over constant arrays. One CASE branch per term
    would make a generated method too long for the JVM to compile.
    """
    return F.transform(
        term_lists(rules.roles.values()),
        lambda terms: F.exists(terms, lambda t: F.contains(both, t)),
    )


def lexicon_index(category, rules: ScoreRules) -> Column:
    """Position of the lexicon of the row's category; unknown ones use the default."""
    names = list(rules.lexicons)
    out = F.lit(None)
    for i, name in enumerate(names):
        out = F.when(col(category) == name, F.lit(i)) if i == 0 else out.when(col(category) == name, F.lit(i))
    return out.otherwise(F.lit(names.index(rules.default_category)))


def longest_term(rules: ScoreRules) -> int:
    """Characters of the longest term of a role or lexicon."""
    every = [t for terms in rules.roles.values() for t in terms] + list(rules.terms)
    return max((len(t) for t in every), default=1)


def _tagged_lexicons(rules: ScoreRules) -> Column:
    """The terms of each lexicon with their bit among the lexicon's and among all terms."""
    at = {t: i for i, t in enumerate(rules.terms)}

    def tag(i: int, t: str) -> Column:
        return F.struct(
            F.lit(t).alias("t"), F.lit(i // _MASK_BITS).alias("word"), F.lit(1 << (i % _MASK_BITS)).cast("long").alias("bit"),
            F.lit(at[t] // _MASK_BITS).alias("all_word"), F.lit(1 << (at[t] % _MASK_BITS)).cast("long").alias("all_bit"),
        )

    return F.array(*[F.array(*[tag(i, t) for i, t in enumerate(terms)]) for terms in rules.lexicons.values()])


def body_features(norm: Column, present: Column, rules: ScoreRules) -> Column:
    """What scores need to know of a text in scoring form that many descriptions begin with:
    the roles and terms in it, its first years, and its ends, over which a term may reach."""
    edge = longest_term(rules) - 1
    tagged = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.lit(i // _MASK_BITS).alias("word"), F.lit(1 << (i % _MASK_BITS)).cast("long").alias("bit"))
            for i, t in enumerate(rules.terms)
        ]
    )
    masks = _masks(F.filter(tagged, lambda s: F.contains(norm, s["t"])), max(1, -(-len(rules.terms) // _MASK_BITS)))
    return F.struct(
        present.alias("present"), role_hits(norm, rules).alias("roles"), masks.alias("terms"), first_years(norm).alias("years"),
        F.substring(norm, 1, edge).alias("head"), F.right(norm, F.lit(edge)).alias("tail"),
        F.substring_index(norm, " ", -1).alias("last"),
    )


def joined(*texts: Column) -> Column:
    """Texts in scoring form with a space between; empty ones add none."""
    return F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts])


def body_near(title: Column, body: Column, ends: Column, rules: ScoreRules) -> Column:
    """What a term of a role can be in, besides the inside of ``body``: the title with the
    head of the description, and its ``ends``, which is ``joined(body["tail"], note)``."""
    # The tail of a body shorter than an end is all of it, as its head is.
    short = F.length(body["head"]) < longest_term(rules) - 1
    lead = F.concat(title, F.lit(" "), F.when(short, ends).otherwise(body["head"]))
    # A control character is in no term that a text in scoring form could have.
    return F.concat(lead, F.lit("\x00"), ends)


def body_role_hits(roles: Column, near: Column, rules: ScoreRules) -> Column:
    """``role_hits`` of a title and a description of a body with these ``roles`` and its
    ``body_near``."""
    return F.zip_with(roles, role_hits(near, rules), lambda inside, at_ends: inside | at_ends)


def body_lexicon_hits(masks: Column, ends: Column, index: Column, rules: ScoreRules) -> Column:
    """The terms of the lexicon in a description of a body with these ``masks`` of terms and
    its ``ends``, with their bits."""
    return F.filter(
        F.get(_tagged_lexicons(rules), index),
        lambda s: (F.get(masks, s["all_word"]).bitwiseAND(s["all_bit"]) != 0) | F.contains(ends, s["t"]),
    )


def body_first_years(body: Column, note: Column) -> Column:
    """``first_years`` of a description of ``body`` and ``note``."""
    return F.coalesce(F.nullif(body["years"], F.lit("")), first_years(joined(body["last"], note)))


def lexicon_size(index: Column, rules: ScoreRules) -> Column:
    return F.get(F.array(*[F.lit(len(t)) for t in rules.lexicons.values()]), index)


def packed(hits: Column, rules: ScoreRules) -> Column:
    """Terms of a lexicon with their bits as whole numbers."""
    return _masks(hits, mask_words(rules))


def _masks(hits: Column, words: int) -> Column:
    zero = F.lit(0).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda w: F.aggregate(
            F.filter(hits, lambda s: s["word"] == w), zero, lambda total, s: total + s["bit"]
        ),
    )


def mask_words(rules: ScoreRules) -> int:
    """Whole numbers needed for the longest lexicon."""
    return max((len(t) + _MASK_BITS - 1) // _MASK_BITS for t in rules.lexicons.values()) or 1


def known_masks(known: Column, rules: ScoreRules) -> Column:
    """Known terms of a profile as masks, one list per lexicon."""
    lists = []
    for i, terms in enumerate(rules.lexicons.values()):
        words = []
        for w in range(mask_words(rules)):
            total = F.lit(0).cast("long")
            for bit, t in enumerate(terms[w * _MASK_BITS : (w + 1) * _MASK_BITS]):
                has = F.array_contains(known[i], F.lit(t))
                total = total + F.when(has, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
            words.append(total)
        lists.append(F.array(*words))
    return F.array(*lists)


def first_years(text: Column) -> Column:
    """Digits of the first "N years"; empty where there are none."""
    return F.regexp_extract(text, r"([0-9]+)\+?\s*(?:years|yrs)", 1)


def years_or_default(digits: Column, rules: ScoreRules) -> Column:
    """Years asked, as text, of the ``first_years``. In a range the later number counts."""
    return F.when(digits == "", F.lit(str(rules.default_required_years))).otherwise(number_text(digits))


def role_part(hits: list[Column], role_values: Column) -> Column:
    total = F.lit(0.0)
    for i, hit in enumerate(hits):
        total = total + F.when(hit, role_values[i]).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def role_detail(hits: list[Column], role_values: Column, rules: ScoreRules) -> Column:
    # The wording of reasons.
    notes = [
        F.when(hit & (role_values[i] == 1.0), F.lit(f"Role '{role}' matches CV")).when(
            hit & (role_values[i] > 0.0), F.lit(f"Role '{role}' partially matches CV")
        )
        for i, (role, hit) in enumerate(zip(rules.roles, hits))
    ]
    text = F.concat_ws("; ", *notes)
    return F.when(text == "", F.lit("No strong role match")).otherwise(text)


def experience_part(profile_years: Column, required: Column) -> Column:
    have, need = profile_years.cast("double"), required.cast("double")
    return F.when(have >= need, 1.0).when(have >= need * 0.7, 0.7).otherwise(0.3)


def location_part(place: Column, rules: ScoreRules) -> Column:
    """The part of a location in scoring form."""
    return (
        F.when((place == "") | place.isin(*rules.remote_places), 1.0)
        .when(F.contains(place, F.lit(rules.hybrid_word)), 0.8)
        .otherwise(0.5)
    )


def posted_date(posted, is_date: bool) -> Column:
    """Strictly ``YYYY-M-D``; anything else is unknown."""
    if is_date:
        return col(posted)
    c = text_or_empty(posted)
    return F.when(c.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), c.try_cast("date"))


def recency_part(posted: Column, as_of: Column) -> Column:
    """Freshness by whole days; dates after ``as_of`` count as yesterday."""
    days = F.datediff(as_of, posted)
    return (
        F.when(posted.isNull(), 0.5)
        .when(days == 0, 1.0)
        .when(days <= 1, 0.8)
        .when(days <= 3, 0.5)
        .otherwise(0.2)
    )


def weighted(part: Column, weight: float) -> Column:
    return part * 10 * F.lit(weight)


def total_score(role, skills, experience, location, recency) -> Column:
    raw = role + skills + experience + location + recency
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), one_decimal(raw)))

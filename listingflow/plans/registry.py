"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# SQL fragments of the checks.
SQL_WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SQL_WS}+', ' ', 'g')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_match(x: str) -> str:
    return (
        f"trim(regexp_replace(trim({sql_collapse(f'lower({x})')}),"
        " '[^\\p{L}\\p{N}_ ]', '', 'g'))"
    )


def sql_score_text(x: str) -> str:
    return f"trim({sql_collapse(f'lower({x})')})"


def sql_slug(x: str) -> str:
    kept = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}-]', '', 'g')"
    return (
        f"substr(regexp_replace(lower({sql_strip(kept)}), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}-]+', '_', 'g'), 1, 60)"
    )


def sql_fingerprint(company: str = "company", title: str = "title", location: str = "location") -> str:
    return (
        f"sha256(substr({sql_match(company)}, 1, 50) || '|' || substr({sql_match(title)}, 1, 80)"
        f" || '|' || substr({sql_match(location)}, 1, 50))"
    )


def sql_clean(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, plain in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")]:
        out = f"replace({out}, '{entity}', '{plain}')"
    return f"trim({sql_collapse(out)})"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(t)})" for t in terms) + ")"


def sql_greedy(src: str, rounds: int = 6) -> str:
    """CTEs that apply the first-seen rule to ``src(ord, k1, k2)``; a null k2 is exempt."""
    ctes = [f"und0 AS MATERIALIZED (SELECT ord, k1, coalesce(k2, 'ord:' || ord) AS k2 FROM {src})"]
    for i in range(rounds):
        ctes.append(
            f"win{i} AS MATERIALIZED (SELECT u.ord, u.k1, u.k2 FROM und{i} u"
            f" JOIN (SELECT k1, min(ord) AS m FROM und{i} GROUP BY k1) a ON a.m = u.ord"
            f" JOIN (SELECT k2, min(ord) AS m FROM und{i} GROUP BY k2) b ON b.m = u.ord)"
        )
        ctes.append(
            f"und{i + 1} AS MATERIALIZED (SELECT * FROM und{i} u"
            f" WHERE NOT EXISTS (SELECT 1 FROM win{i} w WHERE w.k1 = u.k1)"
            f" AND NOT EXISTS (SELECT 1 FROM win{i} w WHERE w.k2 = u.k2))"
        )
    union = " UNION ALL ".join(f"SELECT ord FROM win{i}" for i in range(rounds))
    # Rows that are still undecided would be missing from the check: it fails instead.
    union += f" UNION ALL SELECT CAST(error('undecided rows after {rounds} rounds') AS BIGINT) FROM und{rounds}"
    ctes.append(f"kept AS ({union})")
    return ", ".join(ctes)

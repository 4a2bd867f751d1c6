"""Main text of web pages by union-free wrappers (operator 10).

The pages of a host are made by few templates. A page is read as a sequence of tags and
text slots; runs of alike siblings become a repeated group. Pages of one host are then
aligned, two at a time: tags that agree are template, texts that differ become a slot,
and a mismatch makes the shorter skipped stretch optional. The result is one wrapper per
host, a regular expression without unions over tags, slots, ``?`` and ``+``.

The wrapper shows which of its parts is the article: an ``article`` element, else the main
region, else the part whose slots hold most text that changes from page to page and isn't
links. Copies of a page are one page there, and where nothing changes on a host its pages
are read as a single one is. Texts are then taken from each page at the wrapper's places.

Pages are reduced to distinct structures before alignment. A host's structures are
aligned in groups of ``FAN_IN`` over several rounds, so a host with a third of all pages
is no single task. The wrapper, not the page, is what is joined by host.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.html_tree import INLINE, SILENT, Node, tree
from listingflow.llm.words import slices, texts_of
from listingflow.scratch import discard, materialize

FAN_IN = 32
#: Longest group of siblings looked for as a repetition; others stay as they are.
LONGEST_GROUP = 8

# Names that web pages give to parts beside the main text.
DROP_TAGS = frozenset("nav footer aside form script style noscript iframe button select svg template dialog menu head textarea object canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROP_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored sponsors promo promotion sidebar side-bar "
    "aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar header site-header page-header masthead "
    "footer site-footer page-footer cookie cookies cookie-notice cookie-banner consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments comment-list commentlist comment-section respond disqus "
    "disqus_thread replies related related-posts recommended share sharing social social-share toolbar widget widgets skip-link hidden".split()
)
MAIN_MARKS = frozenset("role=main content main main-content article article-body post post-content entry entry-content story story-body page-content".split())
HEADER = "header"

SLOT = "#"


def _label(node: Node) -> str:
    return " ".join((node.name, *node.marks))


def dropped(label: str, inside: bool) -> bool:
    """A part beside the main text. A ``header`` element within the article holds its title."""
    name, *marks = label.split(" ")
    if name in DROP_TAGS or (name == HEADER and not inside):
        return True
    if name in ("html", "body", "article", "main", "root") and "hidden" not in marks:
        return any(m in ("comment", "comments", "related", "ad", "advert", "sponsored") for m in marks) and name in ("article", "main")
    return any(m in DROP_MARKS or (m.startswith("role=") and m[5:] in DROP_ROLES) for m in marks)


# A wrapper node is [label, kind, children]; kind is "1", "?" (optional), "+" (repeated) or
# "*" (both). A slot has the label "#", a repeated group of siblings "(label label ...)".


def _either(a: str, b: str, joined: bool = False) -> str:
    optional = a in "?*" or b in "?*"
    repeated = joined or a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def _optional(node: list) -> list:
    return [node[0], "*" if node[1] in "+*" else "?", node[2]]


def merge(a: list, b: list, joined: bool = False) -> list:
    """Align two nodes of one label."""
    return [a[0], _either(a[1], b[1], joined), align(a[2], b[2])]


def _group(node: list, items: list) -> list | None:
    """A repeated group with the plain items that it matches merged in, if it does."""
    if not node[0].startswith("(") or [x[0] for x in items[: len(node[2])]] != [x[0] for x in node[2]]:
        return None
    return [node[0], node[1], [merge(x, y) for x, y in zip(node[2], items)]]


def align(a: list, b: list) -> list:
    """Align two sequences; what only one has becomes optional."""
    out = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if once := _group(a[i], b[j:]):
            out.append(once)
            i, j = i + 1, j + len(once[2])
            continue
        if once := _group(b[j], a[i:]):
            out.append(once)
            i, j = i + len(once[2]), j + 1
            continue
        skip_b = next((k for k in range(j + 1, len(b)) if b[k][0] == a[i][0]), None)
        skip_a = next((k for k in range(i + 1, len(a)) if a[k][0] == b[j][0]), None)
        if skip_a is None and skip_b is None:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
        elif skip_b is None or (skip_a is not None and skip_a - i <= skip_b - j):
            out += [_optional(x) for x in a[i:skip_a]]
            i = skip_a
        else:
            out += [_optional(x) for x in b[j:skip_b]]
            j = skip_b
    out += [_optional(x) for x in a[i:]] + [_optional(x) for x in b[j:]]
    return repeated(out)


def repeated(items: list) -> list:
    """Neighbouring alike siblings, or groups of siblings, as one repetition; shortest
    groups first. A group of several is a node labelled with their labels in brackets."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merge(out[-1], item, joined=True)
        else:
            out.append(item)
    for width in range(2, min(LONGEST_GROUP, len(out) // 2) + 1):
        i = 0
        while i + 2 * width <= len(out):
            names = [x[0] for x in out[i : i + width]]
            end, group = i + width, out[i : i + width]
            while [x[0] for x in out[end : end + width]] == names:
                group = [merge(x, y) for x, y in zip(group, out[end : end + width])]
                end += width
            if end > i + width:
                out[i:end] = [[f"({' '.join(names)})", "+", group]]
            i += 1
    return out


def skeleton(node: Node) -> list:
    """The wrapper of one page: inline elements are part of the text slot they are in."""

    def children(items: list) -> list:
        out: list = []
        for item in items:
            if isinstance(item, str):
                got = [[SLOT, "1", []]] if item.strip() else []
            elif item.name in INLINE and not item.marks:
                got = children(item.items)
            elif item.name in ("br", "img", "meta", "link", "hr", "input"):
                got = []
            else:
                got = [skeleton(item)]
            for x in got:
                if not (x[0] == SLOT and out and out[-1][0] == SLOT):
                    out.append(x)
        return repeated(out)

    return [_label(node), "1", children(node.items)]


def places(node: Node) -> Iterator[tuple[str, str, bool]]:
    """``(path, text, in a link)`` of every text that isn't white space."""
    stack = [(node, _label(node), False)]
    while stack:
        here, path, link = stack.pop()
        for item in here.items:
            if isinstance(item, str):
                if item.strip():
                    yield path, item, link
            elif item.name in INLINE and not item.marks:
                stack.append((item, path, link or item.name == "a"))
            else:
                stack.append((item, f"{path}/{_label(item)}", link or item.name == "a"))


_STATS = "host string, skeleton string, page long, path string, texts long, chars long, linked long, low long, high long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each page with its structure, and one for each path with its texts."""
    import xxhash

    for batch in slices(batches, "html"):
        out: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), texts_of(batch, "html").to_pylist()):
            root = tree(page)
            shape = json.dumps(skeleton(root), ensure_ascii=False)
            out.append((host, shape, None, None, None, None, None, None, None))
            found: dict[str, list] = {}
            for path, text, link in places(root):
                got = found.setdefault(path, [0, 0, []])
                got[0] += len(text)
                got[1] += len(text) if link else 0
                got[2].append(text.strip())
            same = xxhash.xxh3_64_intdigest(json.dumps([shape, sorted(found.items())])) >> 1
            for path, (chars, linked, texts) in found.items():
                digest = xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1
                out.append((host, None, same, path, len(texts), chars, linked, digest, digest))
        names = [f.split()[0] for f in _STATS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of some wrappers of a host."""
    wrappers = [json.loads(w) for w in sorted(group["skeleton"])]
    whole = wrappers[0]
    for other in wrappers[1:]:
        whole = merge(whole, other)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "skeleton": [json.dumps(whole, ensure_ascii=False)]})


def regions(wrapper: list, stats: dict[str, tuple]) -> list[str]:
    """Paths of the article in the wrapper: the outermost article elements, else the main
    region, else the part with most text of its own that changes and isn't links."""
    articles, mains, bodies, texts_of_all = [], [], {}, {}

    def walk(node: list, path: str, inside: bool) -> None:
        name, *marks = node[0].split(" ")
        if dropped(node[0], inside):
            return
        if name == "article":
            articles.append(path)
            return
        if name == "main" or any(m in MAIN_MARKS for m in marks):
            mains.append(path)
        children = list(node[2])
        while children:
            child = children.pop(0)
            if child[0].startswith("("):
                children = [*child[2], *children]
            elif child[0] != SLOT:
                walk(child, f"{path}/{child[0]}", inside or path in mains)
        texts, chars, linked, low, high, pages = stats.get(path, (0, 0, 0, 0, 0, 0))
        if chars:
            texts_of_all[path] = max(0, chars - 2 * linked)
            if pages < 3 or low != high:
                bodies[path] = texts_of_all[path]

    walk(wrapper, wrapper[0], False)
    if articles:
        return list(dict.fromkeys(articles))
    # Where no text changes, that tells nothing.
    bodies = bodies or texts_of_all
    if mains:
        # The innermost region that holds nearly all text of the outermost.
        held = {m: sum(v for p, v in bodies.items() if p == m or p.startswith(m + "/")) for m in mains}
        best = max(held.values())
        return [max((m for m in held if held[m] >= 0.9 * best), key=len)]
    if not bodies:
        return [wrapper[0]]
    # Text counts for the part that holds it and half for the part around that.
    score: dict[str, float] = {}
    for path, v in bodies.items():
        parent = path.rpartition("/")[0] or path
        score[parent] = score.get(parent, 0) + v
        outer = parent.rpartition("/")[0]
        if outer:
            score[outer] = score.get(outer, 0) + v / 2
    return [max(score, key=lambda p: (score[p], -len(p)))]


_WRAPPERS = "host string, wrapper string, regions array<string>"


def _wrap(key: tuple, folded: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    if not len(folded):
        return pd.DataFrame({"host": [], "wrapper": [], "regions": []})
    wrapper = json.loads(folded["skeleton"].iloc[0])
    known = {r.path: (r.texts, r.chars, r.linked, r.low, r.high, r.pages) for r in stats.itertuples()}
    return pd.DataFrame({"host": [key[0]], "wrapper": [folded["skeleton"].iloc[0]], "regions": [regions(wrapper, known)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, regions)`` of ``pages(host, html)``, one row per host."""
    read = materialize(pages.select("host", "html").mapInArrow(_read, _STATS), "structures")
    current = materialize(read.where("skeleton is not null").select("host", "skeleton").distinct(), "wrappers")
    while True:
        most = current.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        parts = max(1, -(-most // FAN_IN))
        group = F.pmod(F.xxhash64("skeleton"), F.lit(parts)).alias("part")
        after = materialize(
            current.select("host", "skeleton", group).groupBy("host", "part").applyInPandas(_fold, "host string, skeleton string").distinct(),
            "wrappers",
        )
        discard(current)
        current = after
    stats = (
        read.where("path is not null")
        .dropDuplicates(["host", "page", "path"])
        .groupBy("host", "path")
        .agg(*[F.sum(c).alias(c) for c in ("texts", "chars", "linked")], F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("pages"))
    )
    wrappers = materialize(
        current.groupBy("host").cogroup(stats.groupBy("host")).applyInPandas(_wrap, _WRAPPERS), "hosts"
    )
    discard(read, current)
    return wrappers


def text_at(root: Node, paths: set[str]) -> str:
    """Texts below the paths without the parts beside the main text: block elements and
    line breaks part words, inline elements don't."""
    out: list[str] = []

    def walk(node: Node, path: str, inside: bool) -> None:
        for item in node.items:
            if isinstance(item, str):
                if inside:
                    out.append(item)
                continue
            label = _label(item)
            if item.name in INLINE:
                if not (item.marks and dropped(label, inside)):
                    walk(item, path if not item.marks else f"{path}/{label}", inside or f"{path}/{label}" in paths)
                continue
            gap = "" if item.name in SILENT else " "
            out.append(gap)
            if not dropped(label, inside):
                below = f"{path}/{label}"
                walk(item, below, inside or below in paths)
            out.append(gap)

    label = _label(root)
    walk(root, label, label in paths)
    return " ".join("".join(out).split())


def extract_page(page: str, paths: list[str] | None) -> str:
    root = tree(page)
    text = text_at(root, set(paths)) if paths else ""
    if not text:
        # The page isn't of its host's template: it is its own.
        stats: dict[str, tuple] = {}
        for path, value, link in places(root):
            t, c, n, *_ = stats.get(path, (0, 0, 0))
            stats[path] = (t + 1, c + len(value), n + (len(value) if link else 0), 0, 0, 1)
        text = text_at(root, set(regions(skeleton(root), stats)))
    return text


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        paths = batch.column("regions").to_pylist()
        texts = [extract_page(page, p) for page, p in zip(texts_of(batch, "html").to_pylist(), paths)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ...)``: page_id, url, text, n_chars.

    A null or empty html has an empty text, as has a page without a main part. A null url
    or one without a host counts as a host of its own kind. Repeated rows give equal texts;
    an empty table gives no rows; other columns are not looked at.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host)
    wrappers = infer_wrappers(rows)
    return (
        rows.join(wrappers.select("host", "regions"), "host", "left")
        .select("page_id", "url", "html", "regions")
        .mapInArrow(_extract, _TEXTS)
    )

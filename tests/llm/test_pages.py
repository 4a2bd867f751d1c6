"""The WARC archive's round trip and the main text of pages."""

import gzip
import hashlib
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listingflow.llm import html_text, html_tree, warc

PAGES = "page_id long, url string, html string, host string, text string"


def pages_frame(frame, rows):
    return frame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)


# Archive

LONG = "<p>" + "é" * 80 + "</p>"


def archived(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "archive"))
    return warc.read_archive(spark, str(tmp_path / "archive"))


def brute_archive(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and (h or "") in first and i != first[h or ""]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return out


ROWS = [
    (9, "http://a/1", LONG), (3, "http://a/2", LONG), (4, None, LONG), (5, "http://b/\r\nX: y", "short"), (6, "http://b", "short"),
    (7, "http://c", None), (8, "http://c", ""), (None, "http://d", LONG), (None, "http://d", LONG + "z"), (3, "http://a/2", LONG),
    (10, "http://e", "x" * 99), (11, "http://e", "x" * 99), (12, "http://e", "x" * 100), (13, "http://e", "x" * 100),
    (14, "http://f", "line\r\n\r\nWARC/1.1\r\n" * 20_000),
]


def test_archive_matches_brute_force(spark, frame, tmp_path):
    got = archived(spark, pages_frame(frame, ROWS), tmp_path)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, brute_archive(ROWS)))


def test_payloads_are_stored_once_and_come_back_whole(spark, frame, tmp_path):
    got = archived(spark, pages_frame(frame, ROWS), tmp_path).collect()
    stored = spark.read.parquet(str(tmp_path / "archive" / "payloads"))
    assert stored.count() == len({h or "" for *_, h in ROWS})
    assert sorted(r.payload.decode() for r in got) == sorted(h or "" for *_, h in ROWS)


def test_records_are_well_formed(spark, frame, tmp_path):
    got = archived(spark, pages_frame(frame, ROWS), tmp_path)
    for r in got.withColumn("whole", warc.record_bytes()).collect():
        whole = bytes(r.whole)
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r.record_type
        length = int(fields["Content-Length"])
        assert rest[length:] == b"\r\n\r\n" and length == (0 if r.record_type == "revisit" else r.payload_bytes)
        assert fields["WARC-Payload-Digest"] == "sha256:" + r.payload_digest
        assert ("WARC-Refers-To" in fields) == (r.record_type == "revisit")


def test_warc_files_hold_the_records_and_are_read_back(spark, frame, tmp_path):
    records = archived(spark, pages_frame(frame, ROWS), tmp_path)
    warc.write_warc(records, str(tmp_path / "files"), records_per_file=2)
    written = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "files").glob("part-*")))
    want = [bytes(r.whole) for r in records.select(warc.record_bytes().alias("whole")).collect()]
    assert len(written) == sum(map(len, want)) and all(w in written for w in want)
    read = warc.read_warc(spark, str(tmp_path / "files"))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, bytes(r.header)) for r in read.collect()]
    kept = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, bytes(r.header)) for r in records.collect()]
    assert sorted(got, key=str) == sorted(kept, key=str)
    full = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.full_payloads(read).collect()]
    assert sorted(map(str, full)) == sorted(map(str, brute_archive(ROWS)))


def test_every_byte_of_a_value_counts(spark, frame, tmp_path):
    """With one byte of a value changed, a record reads differently or not at all."""
    record = archived(spark, pages_frame(frame, [(41, "http://a", LONG)]), tmp_path).withColumn("whole", warc.record_bytes()).first()
    whole = bytes(record.whole)
    values = lambda f: tuple(f.get(n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "Content-Length"))
    [(_, fields, _)] = warc.parsed_records(io.BytesIO(whole))
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "Content-Length"):
        start = whole.index(f"\r\n{name}: ".encode()) + len(name) + 4
        for at in range(start, whole.index(b"\r\n", start)):
            spoiled = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
            try:
                [(_, got, _)] = warc.parsed_records(io.BytesIO(spoiled))
            except (ValueError, KeyError):
                continue
            assert values(got) != values(fields)


@pytest.mark.parametrize(("old", "new"), [(b"Length: 1", b"Length: 2"), (b"sha256:", b"sha257:"), (b"WARC-Type: res", b"WARC-Type: ref")])
def test_a_changed_header_is_found(spark, frame, tmp_path, old, new):
    archived(spark, pages_frame(frame, [(41, "http://a", LONG)]), tmp_path)
    stored = spark.read.parquet(str(tmp_path / "archive" / "headers"))
    changed = F.encode(F.replace(F.decode("header", "UTF-8"), F.lit(old.decode()), F.lit(new.decode())), "UTF-8")
    stored.withColumn("header", changed).write.parquet(str(tmp_path / "bad" / "headers"))
    spark.read.parquet(str(tmp_path / "archive" / "payloads")).write.parquet(str(tmp_path / "bad" / "payloads"))
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archive(spark, str(tmp_path / "bad")).collect()


def test_the_query_takes_its_columns_from_headers(spark, frame, tmp_path):
    archived(spark, pages_frame(frame, ROWS), tmp_path)
    assert spark.read.parquet(str(tmp_path / "archive" / "headers")).columns == ["header"]
    read = warc.read_archive(spark, str(tmp_path / "archive")).select("page_id", "record_type", "refers_to", "payload_digest")
    assert "header" in read._jdf.queryExecution().executedPlan().toString()


def test_a_changed_payload_is_found(spark, frame, tmp_path):
    archived(spark, pages_frame(frame, ROWS), tmp_path)
    stored = spark.read.parquet(str(tmp_path / "archive" / "payloads"))
    spoiled = stored.withColumn("payload", F.when(F.col("payload_bytes") == 5, F.lit(b"shorx")).otherwise(F.col("payload")))
    spoiled.write.parquet(str(tmp_path / "bad" / "payloads"))
    spark.read.parquet(str(tmp_path / "archive" / "headers")).write.parquet(str(tmp_path / "bad" / "headers"))
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archive(spark, str(tmp_path / "bad")).select("page_id", "payload_bytes").collect()


def test_empty_archive(spark, frame, tmp_path):
    assert archived(spark, pages_frame(frame, []), tmp_path).collect() == []


# HTML


def text_of(page):
    return html_text.extract_page(page, None)


CASES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T&amp;C</h1><p>One <b>two</b>three<br>four</p><p>five", "T&C One twothree four five"),
    ("<article><header><h1>Title</h1></header><p>a</p><aside>no</aside><form>no<input></form><p>b</p></article>", "Title a b"),
    ("<header>no</header><article>x<script>var a = '</p>';</script><style>p{}</style>y</article><footer>no</footer>", "xy"),
    ("<article><p>a</p><div class='ad'>no</div><div id=sidebar>no</div><div class='cookie-notice'>no</div></article>", "a"),
    ("<article><p>a</p></article><section class=comments><article class=comment>no</article></section>", "a"),
    ("<main><p>a</p><section id='comments'><p>no</p></section></main>", "a"),
    ("<body><div role=navigation>no</div><div class=content><p>a long enough text</p></div></body>", "a long enough text"),
    ("<article>a &#233; &#x1F600; &nbsp; &lt;b&gt; &unknown; &not &amp;amp;</article>", "a é 😀 <b> &unknown; ¬ &amp;"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "one two c1 c2 c3"),
    ("<article><!-- no --><p>a<!-- <p>no</p> --></p><![CDATA[no]]></article>", "a"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<article><img alt='no' src=x><p>tél\n\t x</p></article>", "tél x"),
    ("plain text", "plain text"),
    ("", ""),
    ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize("page, want", CASES)
def test_main_text_of_a_page(page, want):
    assert text_of(page) == want


def test_whole_operator_with_templates_and_edge_cases(frame):
    menu = "<div class='top0'><a href=/a>Start</a> <a href=/b>Help</a></div>"
    site = lambda i: f"<html><body>{menu}<div class='col'><div class='txt'><p>Story {i} begins.</p><p>It has text {i * 7} of its own.</p></div></div><div class='low'><p>All rights reserved by the site that wrote this.</p></div></body></html>"
    rows = [(i, f"http://plain.example/{i}", site(i)) for i in range(8)]
    rows += [(100 + i, "http://Art.example/x", f"<nav>n</nav><article><p>t{i}</p></article>") for i in range(3)]
    rows += [
        (200, None, "<article>null url</article>"), (201, "no url", None), (202, "http://art.example", ""), (None, "http://art.example", "<article>z</article>"),
        (100, "http://Art.example/x", "<nav>n</nav><article><p>t0</p></article>"), (203, "http://long.example", "<article>" + "<p>word</p>" * 50_000 + "</article>"),
        (204, "http://deep.example", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>"),
        (205, "http://art.example/other", "<p>No article here, only a paragraph.</p>"),
    ]
    got = html_text.main_text(pages_frame(frame, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    text = {r.page_id: r.text for r in out}
    assert all(text[i] == f"Story {i} begins. It has text {i * 7} of its own." for i in range(8))
    assert text[100] == "t0" and text[200] == "null url" and text[201] == text[202] == "" and text[None] == "z"
    assert text[203] == " ".join(["word"] * 50_000) and text[204] == "deep after"
    assert text[205] == "No article here, only a paragraph."
    assert html_text.main_text(pages_frame(frame, [])).collect() == []


def test_copies_of_a_page_are_one_page(frame):
    page = "<body><header>h</header><div class=top0><a href=/>Start</a></div><div class=txt><p>A story that is long.</p></div><div class=low><p>Rights.</p></div></body>"
    two = "<div class=content><h1>Title</h1></div><div class=content><div class=post>Some text in it.</div></div>"
    rows = [(n * 100 + i, f"http://h{n}.example/{i}", page) for n in (1, 2, 3, 7) for i in range(n)]
    rows += [(n * 10_000 + i, f"http://m{n}.example/{i}", two) for n in (1, 5) for i in range(n)]
    text = {r.page_id: r.text for r in html_text.main_text(pages_frame(frame, rows)).collect()}
    assert {text[i] for i, _, p in rows if p == page} == {text_of(page)} and "A story" in text_of(page) and "Start" not in text_of(page)
    assert {text[i] for i, _, p in rows if p == two} == {text_of(two)}


def test_pages_whose_texts_do_not_change_are_read_as_one(frame):
    page = "<body><header>h</header><div class=top0><a href=/>Start</a></div><div class=txt><p>A story that is long.</p></div><div class=nav>{}</div></body>"
    rows = [(i, f"http://same.example/{i}", page.format(i)) for i in range(5)]
    text = {r.text for r in html_text.main_text(pages_frame(frame, rows)).collect()}
    assert text == {text_of(page)} and "Start" not in text_of(page)


def test_small_table_matches_a_plain_reading(corpus):
    import html

    got = {r.page_id: r.text for r in html_text.main_text(corpus("pages")).collect()}
    for r in corpus("pages").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        plain = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner)))
        assert got[r.page_id] == " ".join(plain.split())


def wrapper_of(*pages):
    whole = html_text.skeleton(html_tree.tree(pages[0]))
    for page in pages[1:]:
        whole = html_text.merge(whole, html_text.skeleton(html_tree.tree(page)))
    return whole


def test_wrapper_has_repeats_and_optionals():
    whole = wrapper_of("<ul><li>a<li>b<li>c</ul><h1>t</h1><p>x</p>", "<ul><li>a</ul><h1>t</h1><div>new</div><p>x</p>")
    assert whole[2] == [
        ["ul", "1", [["li", "+", [["#", "1", []]]]]], ["h1", "1", [["#", "1", []]]], ["div", "?", [["#", "1", []]]], ["p", "1", [["#", "1", []]]],
    ]
    pairs = wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    slot = [["#", "1", []]]
    assert pairs[2] == [["dl", "1", [["(dt dd)", "+", [["dt", "1", slot], ["dd", "1", slot]]]]]]
    once = wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl><p>x</p>")
    assert once[2] == [*pairs[2], ["p", "?", slot]]


def accepts(wrapper, page):
    """Whether the wrapper, read as a regular expression, matches the page's skeleton."""

    def pattern(node):
        inner = "".join(map(pattern, node[2]))
        if node[0].startswith("("):
            return f"(?:{inner})" + {"1": "", "?": "?", "+": "+", "*": "*"}[node[1]]
        return f"(?:<{re.escape(node[0])}>{inner}</>)" + {"1": "", "?": "?", "+": "+", "*": "*"}[node[1]]

    def raw(node):
        got = []
        for item in node.items:
            if isinstance(item, str):
                got += ["<#></>"] if item.strip() else []
            elif item.name in html_tree.INLINE and not item.marks:
                got += ["<#></>"] if any(True for _ in html_text.places(item)) else []
            elif item.name not in html_tree.VOID:
                got.append(f"<{html_text._label(item)}>{raw(item)}</>")
        merged = [x for i, x in enumerate(got) if not (x == "<#></>" and i and got[i - 1] == x)]
        return "".join(merged)

    root = html_tree.tree(page)
    return re.fullmatch(pattern(wrapper), f"<root>{raw(root)}</>") is not None


_PARTS = st.recursive(
    st.sampled_from(["text", "<p>p</p>", "<h2>h</h2>"]),
    lambda inner: st.tuples(st.sampled_from(["div", "section", "ul"]), st.lists(inner, max_size=3)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"),
    max_leaves=6,
)


@settings(max_examples=60, deadline=None)
@given(st.lists(_PARTS, min_size=1, max_size=4))
def test_one_page_is_accepted_by_its_own_wrapper(parts):
    page = "".join(dict.fromkeys(parts))
    assert accepts(wrapper_of(page), page)


def test_aligned_pages_are_accepted_by_the_wrapper():
    pages = ["<h1>a</h1><p>x</p><p>y</p>", "<h1>a</h1><div>ad</div><p>x</p>", "<h1>a</h1>"]
    whole = wrapper_of(*pages)
    assert all(accepts(whole, p) for p in pages)

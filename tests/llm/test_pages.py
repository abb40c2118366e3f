"""Operators over pages: URL rules, WARC archives, HTML text."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import html_text, url_filter, warc
from tallymill.llm.queries import URL_RULES


def _place(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def _judge(url, rules):
    host, path = _place(url)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = ["http://a.example.net/en/1", "HTTP://EXAMPLE.NET/en", "https://example.net", "http://net/x?y=://z",
        "http://example.com/de/#f", "http://fr.org/fr/a", "http://xexample.com/de/", "ftp://b.c.example.com/de/x/y",
        None, "", "no scheme", "://", ":///p", "http://ÄB.org/fr/é?q", "http://a..net/", "http://net", "http://net/",
        "http://x.net/" + "p/" * 5000, "http://x.net/\n/a b", "http://user@x.org:80/fr/", "a://b://c.net/"]


def test_rules(spark):
    rules = [*URL_RULES, ("example.net", "/en", "block"), ("c.example.com", "", "allow"), ("", "/p", "block"),
             ("net", "/", "allow"), ("x.net", "/p/p/", "allow"), ("net", "/", "block")]
    rows = [(i % 17, u, "h", 1, "w") for i, u in enumerate([*URLS, URLS[0], URLS[0]])] + [
        (None, URLS[1], "h", 2, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int, verdict string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA))
    assert found.columns.count("rule") == found.columns.count("verdict") == 1
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=repr)
    assert got == sorted(((i, u, *_judge(u, rules)) for i, u, *_ in rows), key=repr)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).count() == 0
    none = url_filter.judge(pages, spark.createDataFrame([], url_filter.RULE_SCHEMA)).collect()
    assert len(none) == len(rows) and {(r.rule, r.verdict) for r in none} == {(None, "allow")}


# --- WARC ---


def test_archived_pages(spark):
    rng = random.Random(1)
    same = "<p>é same"
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else None if i % 7 == 0 else "x" * rng.randrange(50) + str(i))
            for i in range(5, 200)]
    rows += [(None, "u v\n", same), (None, None, "alone"), (6, "again", same), (900, "long", "y\r\n\r\n" * 300_000),
             (901, "trap", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\0\0"), (902, "empty", "")]
    pages = spark.createDataFrame([(*r, "id", 1) for r in rows],
                                  "page_id long, url string, html string, payload string, id int").repartition(3)
    found = warc.archived(pages).collect()
    first = {}
    for i, _, body in rows:
        if i is not None:
            first[body or ""] = min(i, first.get(body or "", i))
    wanted = []
    for i, _, body in rows:
        data = (body or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        least = first.get(body or "")
        later = least is not None and (i is None or i > least)
        wanted.append((i, len(data), digest, "revisit" if later else "response", least if later else None))
    key = lambda x: repr(x)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found),
                  key=key) == sorted(wanted, key=key)
    assert len({r.record_id for r in found}) == len(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_payloads_shorter_than_the_least_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")],
                                  "page_id long, url string, html string")
    assert {r.id: r.refers_to for r in warc.archived(pages, least=3).collect()} == {
        1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("version", [1, 2])
def test_conversion_of_both_versions(version):
    rows = [("http://a/x y", 4, b"one\n\ntwo"), ("", None, b""), ("http://b/", -2, b"x" * 70_000)]
    content = warc.arc_archive("some.arc", rows, "20200102030405", version)
    info, *found = warc.arc_records("some.arc", content)
    assert info["record_type"] == "warcinfo" and b"URL IP-address" in info["payload"]
    assert [r["payload"] for r in found] == [body for _, _, body in rows]
    assert [r["id"] for r in found] == [4, None, -2]
    assert found[0]["uri"] == "http://a/x%20y" and found[0]["date"] == "2020-01-02T03:04:05Z"
    assert found == list(warc.arc_records("some.arc", content))[1:]


@pytest.mark.parametrize("version", [1, 2])
def test_a_page_may_have_the_url_of_an_archive_head(version):
    rows = [("filedesc:x", 1, b"a\nURL b c"), ("filedesc://some.arc", 2, b"b"), ("http://c/", 3, b"c")]
    info, *found = warc.arc_records("some.arc", warc.arc_archive("some.arc", rows, "20200102030405", version))
    assert info["record_type"] == "warcinfo"
    assert [(r["record_type"], r["uri"], r["id"], r["payload"]) for r in found] == [
        ("response", *row) for row in rows]


def test_cut_and_broken_archives():
    content = warc.arc_archive("a", [("http://a/", 1, b"abcdef" * 9)], "20200101000000", 2)
    *_, last = warc.arc_records("a", content[:-20])
    assert last["truncated"] and last["payload"] == (b"abcdef" * 9)[:-19]
    *_, good, bad = warc.arc_records("a", content + b"this is no record\nmore")
    assert not good["truncated"] and bad["record_type"] == "unreadable"
    assert list(warc.arc_records("a", b"")) == []
    dns = b"dns:x.org 1.2.3.4 20200101000000 text/dns 5\nx A 1\n"
    assert [r["record_type"] for r in warc.arc_records("a", dns)] == ["resource"]


def test_archives_are_valid_gzip():
    row = {"record_id": "urn:uuid:1", "record_type": "response", "uri": "http://a/", "date": None, "id": 1,
           "head": b"HTTP/1.1 200 OK\r\n\r\n", "payload": b"hello", "payload_digest": warc.sha1_base32(b"hello"),
           "content_type": "text/html", "truncated": False}
    packed = warc.gzip_member(warc.warc_record(row)) + warc.gzip_member(b"")
    assert packed[-1] == 0
    whole = zlib.decompressobj(31).decompress(packed)
    assert whole.startswith(b"WARC/1.0\r\n") and whole.endswith(b"hello\r\n\r\n")
    first, empty = warc.members(packed)
    assert warc.warc_fields(first)["payload"] == b"hello" and warc.warc_fields(empty) is None
    with pytest.raises(ValueError):
        warc.warc_fields(first.replace(b"hello", b"hallo"))


# --- HTML ---

LAID_OUT = {
    "<p>a<p>b <b>c</b>d<ul><li>x<li>y<ol><li>1<li>2</ol><li>z</ul>tail":
        "a\n\nb cd\n\n- x\n- y\n  1. 1\n  2. 2\n- z\n\ntail",
    "<table><tr><td>a<td>bbbb<tr><td>cccc<td>d</table>after": "a     bbbb\ncccc  d\n\nafter",
    "<table><caption>t</caption><tr><th colspan=2>h<th>i</tr><tr><td>1<td>2<td>3": "t\nh     i\n1  2  3",
    "<table><tr><td>o<td><table><tr><td>i<td>j</table></table>": "o  i  j",
    "<pre>a\n  b\n\nc</pre>x": "a\n  b\n\nc\n\nx",
    "<head><title>t</title><style>p{}</style></head><body>yes<script>x<p></script> <!-- c -->ok &amp; &am":
        "yes ok & &am",
    "<div hidden>n</div><div style='display: none'>n</div><p style=visibility:hidden>n</p>y": "y",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "x</p>y</br>z": "xy\nz", "<ol start=3><li>a<li>b</ol>": "3. a\n4. b",
    "<dialog>n</dialog><dialog open>y</dialog>": "y", "<a href=\"x>y\">in</a>": "in",
    "<textarea>a\n &lt;b</textarea>": "a\n <b", "": "", "<": "<", "a < b": "a < b", "&#xe9;&eacute;&nbsp;.": "éé .",
}


LAID_OUT |= {
    "<html><head><title>T</title><p>Hello <b>you</b>": "Hello you",
    "<head><meta charset=utf-8>\n<link rel=x><script>s</script><style>c</style><h1>a</h1>b": "a\n\nb",
    "<html><head><title>T</title>\nplain <i>text</i>": "plain text",
    "<head><title>T</title> <template><p>n</p></template><noscript>n</noscript></head><body>y": "y",
    "<head><br>a": "a", "<head></p>a</head>b": "ab", "<head><head>a": "a", "<head><html><p>a": "a", "<head><title>T</title></br>a": "a",
}


LAID_OUT |= {
    "a <math><mi>x</mi><mo>+</mo><mi>y</mi></math> b": "a x+y b",
    "<math><semantics><mi>x</mi><annotation encoding=t>\\x</annotation><annotation-xml><mi>n</mi>"
    "</annotation-xml></semantics></math>": "x",
    "<svg viewBox='0 0 9 9'><title>n</title><desc>n</desc><metadata>n</metadata><defs><text>n</text></defs>"
    "<path d='M0 0'/><text x=1>A <tspan>b</tspan></text><text>C</text></svg> d": "A b C d",
    "<svg/>a": "a", "<svg><title/><defs /><text id=a/b/>x</text></svg>y": "xy",
    "<p>a<svg hidden><text>n</text></svg><desc>b</desc>": "ab",
    "<svg><style>n</style><script>n</script><foreignObject><p>a<p>b</foreignObject></svg>": "a\n\nb",
}


LAID_OUT |= {
    "<table><tr><td><h1>Title</h1><p>First para.</p><ul><li>one<li>two</ul></table>":
        "Title\n\nFirst para.\n\n- one\n- two",
    "<table><tr><td><p>a<p>b<td>c<br>d<tr><td>e<td>f</table>": "a  c\n   d\nb\ne  f",
    "<table><tr><td><pre>a  b\n  c</pre><td>d</table>": "a  b  d\n  c",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td>a<td rowspan=0>bb<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a  bb  c\nd      e\nf      g",
    "<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr><td colspan=2 rowspan=2>aaaaaaa<td>b<tr><td>c<tr><td>d<td>e<td>f</table>":
        "aaaaaaa  b\n         c\nd  e     f",
    "<li>x<table><tr><td>a<td>b<tr><td>c<td>d</table>": "- x\n\n  a  b\n  c  d",
    "<div style='visibility:hidden'>n<b style='visibility: visible'>y</b>n</div>": "y",
    "<table><tr><td style=visibility:hidden>nnn<td>b<tr><td>c<td>d</table>": "   b\nc  d",
    "<details>n<summary>s</summary><p>n</details>a": "s\na", "<details open><summary>s</summary>b</details>": "s\nb",
}


@pytest.mark.parametrize("page", LAID_OUT)
def test_layout(page):
    assert html_text.render(page) == LAID_OUT[page]


def test_depth_and_length_have_no_limit():
    assert html_text.render("<div><ul><li>" * 3000 + "deep").strip().endswith("deep")
    wide = "<table>" + "<tr><td>" + "w" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 200 + "</table>"
    assert {line.index("b") for line in html_text.render(wide).split("\n")} == {50_002}
    # Alignment that would take more than a bound is given up for the widest columns, no text is.
    wide = "<table>" + "<tr><td>" + "w" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 5_000 + "</table>"
    found = html_text.render(wide)
    assert len(found) < html_text.MAX_PADDING + 100_000 and found.split() == ["w" * 50_000, "b"] + ["a", "b"] * 5_000
    assert html_text.render(None) == ""


@pytest.mark.parametrize("page", [
    "<div>" * 200_000, "<div>x" * 200_000, "<div></p></b>" * 100_000, "<p><button>" + "<div>" * 200_000,
    "<ul><li>x" * 60_000, "<b><i>" * 100_000 + "</u>" * 100_000, "<table><tr>" + "<td>x" * 100_000])
def test_time_grows_with_the_length_of_the_page(page):
    began = time.monotonic()
    assert html_text.render(page).count("x") == page.count("x")
    assert time.monotonic() - began < 30  # a few seconds; minutes or hours if each tag met all open elements


LETTERS = st.text("abcdé&<", min_size=1, max_size=6)
TREES = st.recursive(LETTERS, lambda inner: st.tuples(
    st.sampled_from("div p b ul li table tr td span script h1 pre".split()), st.lists(inner, max_size=4)),
    max_leaves=25)


def _markup(tree, shown=True):
    """Markup of a tree, and its visible letters."""
    if isinstance(tree, str):
        if not shown:  # of a script: raw text
            return tree.replace("<", "").replace("&", ""), ""
        return tree.replace("&", "&amp;").replace("<", "&lt;"), tree
    name, children = tree
    parts = [_markup(c, shown and name != "script") for c in children if shown and name != "script" or isinstance(c, str)]
    return f"<{name}>{''.join(p[0] for p in parts)}</{name}>", "".join(p[1] for p in parts)


@settings(max_examples=300, deadline=None)
@given(st.lists(TREES, max_size=5))
def test_all_visible_letters_come_out_in_order(trees):
    parts = [_markup(t) for t in trees]
    text = html_text.render("".join(p[0] for p in parts))
    letters = "".join(c for c in text if c in "abcdé&<")
    assert sorted(letters) == sorted("".join(p[1] for p in parts))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_read(text):
    html_text.render(text)
    html_text.render("<table><tr>" + text + "<li>" + text)


def test_pages(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "t"), (2, "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = sorted(((r.page_id, r.text) for r in html_text.extract(pages).collect()), key=repr)
    assert found == sorted([(1, "a"), (1, "a"), (None, ""), (2, "")], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0

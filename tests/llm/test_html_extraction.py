"""Main text of pages with the usual furniture, and of broken ones."""

import pytest

from turnloom.llm import html_extraction, html_tree

LONG = "A sentence with some words, commas, and a full stop at its end. " * 3
TEXT = " ".join(LONG.split())

CASES = {
    "article among furniture": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><nav><a href=/>Menu</a></nav>"
        f"<header><h2>Site</h2></header><div class=ad>Buy, now, please.</div><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article>"
        f"<aside>{LONG}</aside><div id=comments><article class=comment><p>{LONG * 9}</p></article></div><form>{LONG}</form>"
        f"<footer>{LONG}</footer></body></html>", f"Head\n{TEXT}\nOf."),
    "no article element": (
        f"<body><div class='top menu'><ul><li><a href=a>a</a><li><a href=b>b</a></ul></div><div id=x><h1>Head</h1><p>{LONG}"
        f"<p>Short<p>{LONG}</div><div class='cookie-notice'>{LONG}</div>", f"Head\n{TEXT}\nShort\n{TEXT}"),
    "sections of different size": (
        f"<main><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>Tiny.</p></section></main>",
        f"{TEXT}\n{TEXT}\n{TEXT}\nTiny."),
    "siblings": (
        f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=1>{LONG}</a></div></body>", f"{TEXT}\n{TEXT}\n{TEXT}"),
    "lists, tables and quotes of the article": (
        f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><blockquote>q</blockquote><pre>x  y\n z</pre></article>",
        f"{TEXT}\none\ntwo\na\nb\nq\nx y z"),
    "menu inside the article": (
        f"<article><p>{LONG}</p><ul><li><a href=1>More one</a><li><a href=2>More two</a></ul><p>See <a href=3>this</a>.</p></article>",
        f"{TEXT}\nSee this."),
    "references and white space": (
        f"<article><p>a&nbsp;&amp;&lt;b&gt; &eacute;&#233;&#x41; &copy &am</p><p>\n {LONG}\t<b>bold</b><br>next</p><!-- <p>no</p> --></article>",
        f"a &<b> ééA © &am\n{TEXT} bold next"),
    "unclosed tags": (f"<div><p><b>One<br><p>{LONG}<p>Three</div>", f"One\n{TEXT}\nThree"),
    "ends inside a tag": (f"<article><p>{LONG}</p><p>last</p><div class='x", f"{TEXT}\nlast"),
    "hidden parts": (
        f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div><span aria-hidden=true>no</span></article>", TEXT),
    "wrapper named like a part": (f"<div class='page has-sidebar header-fixed-sidebar'><main><p>{LONG}</p></main></div>", TEXT),
    "article header keeps its headings": (f"<article><header><h1>Head</h1><p>By me</p></header><p>{LONG}</p></article>", f"Head\n{TEXT}"),
    "plain text": ("just some text", "just some text"),
    "only furniture": ("<nav><a href=1>a</a></nav><footer>f</footer>", ""),
    "empty": ("", ""), "no text": ("<p></p><br>", ""), "angle brackets": ("1 < 2 and </> 3 <> 4</ x>", "1 < 2 and 3 <> 4"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, want = CASES[name]
    assert html_extraction.main_text(source) == want


def test_long_and_hostile_pages():
    assert html_extraction.main_text("<p>" + "word, " * 300_000 + "</p>").count("word") == 300_000
    for piece in ("<div>", "</div>", "<a b=\"", "<a b='", "<!--", "<script>", "<p", "</p", "<li>", "<td>", "&#", "<b><p></b>", "<table><td>"):
        html_extraction.main_text(piece * 30_000 + "x")
    deep = html_tree.read("<div>" * 2000 + "x")
    assert deep.texts[0][2] == "x"


def test_table(spark):
    rows = [(1, "u", CASES["unclosed tags"][0], "a", 1), (2, None, None, None, None), (None, "v", "", "b", 2), (1, "u", CASES["unclosed tags"][0], "a", 1)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, TEXT STRING, `row x` INT")
    found = html_extraction.extract(pages)
    assert found.columns == ["page_id", "url", "row x", "text", "n_chars"]
    text = CASES["unclosed tags"][1]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "u", 1, text, len(text)), (1, "u", 1, text, len(text)), (2, None, None, "", 0), (None, "v", 2, "", 0)], key=repr)
    assert html_extraction.extract(pages.limit(0)).collect() == []

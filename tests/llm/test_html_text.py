import re
import time
from html import unescape

import pytest

from shoplens.llm.html_text import extract_text, main_text, page_lines, surges
from shoplens.llm.queries import op12_line_blocks

LONG = "Some paragraph of text that says quite a lot about many things, and then more of the same for a while."
OTHER = "Another paragraph of text, as long as the first one is, with a few words more about something else entirely."


def article(body):
    return f"<html><body><nav><a href=/>Home</a></nav><article>{body}</article><footer>(c) nobody, all rights reserved by everybody</footer></body></html>"


@pytest.mark.parametrize("body, text", [
    ("<h1>T</h1><p>One.</p><p>Two.</p>", "T\n\nOne.\n\nTwo."),
    ("<p><b>Open<br><p>Next  \n line", "Open\n\nNext line"),
    ("<p>a<br>b <i>c</i>d&amp;e &lt;x&gt; &#233;&eacute; &nbsp; f&copy</p>", "a b cd&e <x> éé f©"),
    ("<p>1 < 2 and &am</p><!-- <p>no</p> --><p>3</p>", "1 < 2 and &am\n\n3"),
    ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><p>yes</p>", "yes"),
    ("<p>yes</p><div class='ad-box'>no</div><div class=admiral>aye</div>", "yes\n\naye"),
    ("<p>yes</p><section id='comments'><article class=comment><p>no</p></article></section>", "yes"),
    ("<header><h1>Title</h1></header><p>yes</p><footer>no</footer><aside>no</aside><form><label>no</label></form>", "Title\n\nyes"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc d\n\ne"),
    ("<p>yes</p><p hidden>no</p><p style='display: none'>no</p><span class='cookieNotice'>no</span> <p>end</p>", "yes\n\nend"),
    ("<p>one</p><div class=share><a href=x>Share</a></div><p><a href=y>a link alone</a></p>", "one\n\na link alone"),
    ("<p>yes</p><a title='<p>no</p>' href=x>link</a><p>cut <a hre", "yes\n\nlink\n\ncut"),
    ("<p>yes</p><!-- never ends <p>no</p>", "yes"),
    ("<p>yes</p><script>never ends", "yes"),
])
def test_article_elements(body, text):
    assert main_text(article(body)) == text


def test_pages_without_article_element():
    menu = "<div id=header><a href=/>Home</a></div><table><tr><td><a href=/1>First</a><tr><td><a href=/2>Second</a></table>"
    body = f"<div id=content><h2>A title</h2><p>{LONG}<p>Short.<div><p>{OTHER}</div><p>End.</div>"
    end = "<div><p>Tiny</div><div class='reader-comments'><p>" + LONG + "</div>"
    expected = f"A title\n\n{LONG}\n\nShort.\n\n{OTHER}\n\nEnd."
    assert main_text(f"<body class='has-sidebar'>{menu}{body}<div></div>{end}") == expected
    assert main_text(f"<form id=all>{menu}{body}<div></div>{end}</form>") == expected


def test_a_teaser_does_not_hide_the_text():
    assert main_text(f"<div><article>Teaser</article></div><div><p>{LONG}<p>{OTHER}</div>".replace("Teaser", "T")).endswith(f"{LONG}\n\n{OTHER}")


def test_surge_and_dive_points():
    assert surges([0, 5, 0, 90, 3, 0, 0, 0, 2, 100, 0, 0, 0, 1], 86) == [(1, 5, 98), (8, 10, 102)]
    assert surges([], 1) == [] and surges([0, 0], 1) == [] and surges([1], 1) == [(0, 1, 1)]


def test_time_grows_with_length():
    for piece in ("<", "<b>", "<a href=\"", "&", "<!", "</div>", "<div>", "<li>", "<p class=ad>", "=' "):
        start = time.perf_counter()
        page_lines("<p>x" + piece * 100_000)
        assert time.perf_counter() - start < 8, piece


def test_columns_rows_and_nulls(spark):
    rows = [(1, None, "t"), (2, "", "t"), (None, "<p>x</p>", None), (3, "   ", "t"), (3, "plain words", "t"), (3, "plain words", "t"), (4, "<p>" + "word " * 200_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars string")
    got = {(r.page_id, r.text[:12], len(r.text)) for r in extract_text(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "x", 1), (3, "", 0), (3, "plain words", 11), (4, "word word wo", 999_999)}
    assert extract_text(df).count() == 7 and extract_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    """Against a reading of the given pages by patterns that fit them alone."""
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = op12_line_blocks(spark, folder).collect()
    assert len(found) == len(pages)
    for row in found:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)

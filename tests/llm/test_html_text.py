"""Main text of pages of several layouts."""

from __future__ import annotations

import html

import pytest
from llm_cases import ODD

from sift.llm import catalog
from sift.llm.html_text import extracted, main_text

LONG = "Many words stand in this paragraph, which goes on and on so that its line is long enough to surge."
CASES = {
    "article": (
        '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy</div><article><h1>Head</h1><p><b>One &amp; two<br>three<p>Short.<aside>See</aside><p>&lt;End&gt;</p>'
        '<section class="comments"><p>First!</p></section></article><footer>&copy; 2024</footer></body></html>',
        "Head\nOne & two three\nShort.\n<End>",
    ),
    "plain blocks": (
        f'<body><div id="menu"><a href=x>Home</a></div><ul><li><a href=a>Link one of many</a><li><a href=b>Link two</a></ul><div><h2>Head</h2><p>{LONG}</p>'
        f'<p>Yes.</p><form><input>Search</form><p>{LONG}</p></div><div class="footer">{LONG}</div><p style="display: none">{LONG}</p></body>',
        f"Head\n{LONG}\nYes.\n{LONG}",
    ),
    "only a short text": ("<p>Hello   \n world", "Hello world"),
    "text without markup": ("1 < 2 &amp 3", "1 < 2 & 3"),
    "cut in a tag": (f"<article><p>{LONG}</p><p>More <b", f"{LONG}\nMore"),
    "cut in a script": (f"<article><p>{LONG}<script>if (a < b) {{", LONG),
    "header inside": (f"<main><header><h1>Head</h1></header><p>{LONG}</p></main><header>Site</header>", f"Head\n{LONG}"),
    "broken quote": (f'<article><p class="x>{LONG}</p><p>Tail</p></article>', f"{LONG}\nTail"),
    "no text": ("<nav><a href=x>Home</a></nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_every_paragraph_of_a_long_article_is_kept():
    parts = [f"{n} & {'x' * (n % 7)}" for n in range(3000)]
    page = "<nav>n</nav><article>" + "".join(f"<p>{html.escape(p)}</p>" for p in parts) + "</article>"
    assert main_text(page) == "\n".join(" ".join(p.split()) for p in parts)


def test_tables(spark):
    rows = [(n, None, page, "x") for n, page in enumerate([*ODD, CASES["article"][0], CASES["article"][0]])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = {r.row.page_id: r.text for r in extracted(pages).collect()}
    assert found[0] == found[1] == found[2] == "" and found[len(ODD)] == found[len(ODD) + 1] == CASES["article"][1]
    assert extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_the_line_distribution_decides_where_article_or_main_is_not_the_story(tag):
    story = f"<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>"
    links = "<ul><li><a href=a>Link one of many</a><li><a href=b>Link two</a></ul>"
    assert main_text(f"<body><{tag}><p>A card.</p>{links}</{tag}>{story}</body>") == f"Head\n{LONG}\n{LONG}"
    assert main_text(f"<body><{tag}>{links}</{tag}>{story}</body>") == f"Head\n{LONG}\n{LONG}"


def test_the_query_joins_blocks_by_two_line_ends(spark, tmp_path):
    page, text = CASES["article"]
    spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    expected = text.replace("\n", "\n\n")
    assert [tuple(r) for r in catalog.op4_html_text(spark, str(tmp_path)).collect()] == [(1, "u", expected, len(expected))]


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-sidebar", "comments-open", "page-search", "menu-open", "sidebar"])
@pytest.mark.parametrize("page", ["<body class='{}'><p>{}</p></body>", "<div id=x class='a {}'><p>{}</p></div>", "<article class='{}'><p>{}</p></article>"])
def test_names_do_not_drop_what_holds_the_text(name, page):
    assert main_text(page.format(name, f"{LONG}<div class='box ad'>Buy</div>")) == LONG


def test_a_name_is_a_whole_token():
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='menu-open'><p>{LONG}</p></div>") == "\n".join([LONG] * 3)
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='big menu'><p>{LONG}</p></div>") == "\n".join([LONG] * 2)
    assert main_text(f"<article><p>A few words.</p><section class='comments'><p>{LONG}</p></section></article>") == "A few words."

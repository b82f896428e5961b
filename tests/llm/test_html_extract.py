import pytest

from tessera.llm.html_extract import extract_main_text, features, labelled_blocks, main_text, text_blocks, train_tree
from tessera.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tree(spark):
    return train_tree(spark)


def test_tree_fits_its_table(tree):
    import numpy as np
    rows = labelled_blocks()
    assert len(rows) > 80
    kept = tree.predict(np.array([f for f, _ in rows]))
    assert (kept == np.array([y > 0.5 for _, y in rows])).mean() >= 0.97


def test_blocks_and_features():
    blocks = text_blocks("<p>One <b>two</b>&nbsp;&amp; <a href=x>three\n four</a><p>five<br>six<div>&lt;b&gt;</div>")
    assert [b.text for b in blocks] == ["One two & three four", "five six", "<b>"]
    assert [b.linked for b in blocks] == [2, 0, 0]
    f = features(blocks)
    assert f[0, :6].tolist() == [5, 0.4, 0, 0, 2, 0] and f[1, :6].tolist() == [2, 0, 5, 0.4, 1, 0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var a="<p>no</p>";</script>
<header><p>Site head with a good many words in it</p></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site work for you and for us.</p></div>
<div class="ad">Buy one and get another for nothing today only.</div>
<article><h1>The  flood</h1><p>The river rose &amp; the road<br>was closed.<p>Yes.</p>
<ul><li>sand</li><li>ropes and <i>boats</i></li></ul><!-- <p>hidden</p> -->
<form><p>Your mail address please</p><input></form><p>It ended in spring &eacute;.</p></article>
<aside><p>Read also our long list of other floods in the region</p></aside>
<section id="comments"><p>First comment on this page by a reader of it.</p></section>
<footer>&copy; 2024 The paper, all rights kept by it</footer></body></html>"""


def test_article_without_its_surroundings(tree):
    assert main_text(PAGE, tree).split("\n\n") == [
        "The flood", "The river rose & the road was closed.", "Yes.", "sand", "ropes and boats", "It ended in spring é."]


def test_query_gives_the_articles(spark, sf):
    """The articles of the sample pages, cut out by a plain search."""
    import html
    import re
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op5_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split())
                 for p in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def test_edge_cases(frame, spark, tree):
    long = "<article>" + "<p>word and more</p>" * 30_000 + "</article>"
    odd = ["", None, "<", "<p", "a < b", "<article><p>cut &am", "</div></p><article><p>x</p>", "<a <b <c>", "&#0; &bogus;",
           "<script>never closed <p>x", "<p class=\"a>b\">q</p>", "<div class='menu'><p>no</p></div>", long,
           "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"]
    pages = frame([(i, None, t, 5) for i, t in enumerate(odd)] + [(None, "u", "<article><p>x</p></article>", 5)] * 2,
                  "page_id long, url string, html string, text int")
    got = extract_main_text(spark, pages, tree).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(odd) + 2 and by[0] == by[1] == by[9] == by[11] == ""
    assert by[5] == "cut &am" and by[6] == "x" and by[None] == "x" and by[13] == "deep"
    assert by[12].count("word and more") == 30_000
    assert extract_main_text(spark, pages.limit(0), tree).collect() == []


@pytest.mark.parametrize("page", [
    "<body class='page has-sidebar'><article>{}</article></body>", "<div class='content with-sidebar'><article>{}</article></div>",
    "<article class='post comment-open'>{}</article>", "<main id='search-main'>{}</main>",
    "<div class='sidebar'><main>{}</main></div>", "<body class=search><div id=page>{}<p>The end.</p></div>"])
def test_class_words_of_the_whole_page(tree, page):
    body = "<p>" + "The river rose after days of rain and the road was closed. " * 4 + "</p><p>" + "Crews moved sand to the bridge where the wall had given way. " * 3 + "</p>"
    assert len(main_text(page.format(body), tree).split("\n\n")) == 2
    off = page.format(body) + "<div class='cookie-banner box-2'><p>" + "We use cookies on this site for you. " * 4 + "</p></div>"
    assert "cookies" not in main_text(off, tree)


@pytest.mark.parametrize("before, inside", [
    ("<datalist><option value='a'></datalist>", ""), ("<svg class=i />", ""), ("<svg><path d='M0'/><g/></svg>", ""),
    ("<math/>", ""), ("<head><meta charset=utf-8><title>T</title>", ""), ("<div><svg><path></div>", ""),
    ("<select><option>no<option>none</select>", ""), ("<svg><path>", ""), ("", "<template><p>no</p></template>"),
    ("<object><p>no</p></object>", "<svg><text>no</text></svg>"), ("<head><svg/>", "<option>no")])
def test_elements_that_need_no_closing_tag(before, inside):
    blocks = text_blocks(f"{before}<article><p>The river rose.</p>{inside}<p>It fell.</p></article>")
    assert [b.text for b in blocks] == ["The river rose.", "It fell."]

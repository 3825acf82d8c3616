import html as entities
import re

import pytest

from millrace.llm import html
from millrace.llm.queries import op3_html_extraction

SF = "/root/testdata/sf0.01"


def brute(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


def test_whole_table_matches_the_labelled_region(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op3_html_extraction(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: brute(p) for i, p in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def text(page):
    return html.Page(page).text({**html.PRIOR, "other": html.OTHER})


def test_parts_that_are_no_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li>Home</li><li>News</li></ul></nav><div class="cookie-notice">We use cookies on this site to track you all day</div>
    <div id="main"><h2>Heading of it</h2><p>First &amp; foremost, a long paragraph&nbsp;with <i>some</i>&#8212;many words in it.</p>
    <div class="ad banner">Buy this thing now it is cheap</div><script>var x = "</p> words words words words words";</script>
    <p>Second paragraph<br>with a break, and a few more words.</p><form><label>Your name</label><button>Send</button></form>
    <p>End.</p><section id="comments"><p>Great article, I like it very much indeed, thanks to you.</p></section></div>
    <aside class="sidebar"><p>Related: more and more things to read here on the side.</p></aside><footer>Imprint 2020</footer></body></html>"""
    assert text(page) == "Heading of it First & foremost, a long paragraph with some—many words in it. Second paragraph with a break, and a few more words. End."


@pytest.mark.parametrize("tag", ["a", "span", "small", "label", "b"])
def test_inline_boilerplate_ends_at_its_own_tag(tag):
    assert text(f"<article>Alpha beta <{tag} class='advert'>x</{tag}> gamma delta epsilon. <p>Next para words.</p> tail</article>") == "Alpha beta gamma delta epsilon. Next para words. tail"
    assert text(f"<article><p>One two <{tag} class='share'>share <{tag}>it</{tag}> <i>now</i></{tag}> gamma delta.</p><p>More words here.</p></article>") == "One two gamma delta. More words here."
    assert text(f"<article><p>One two <{tag} class='share'>never closed</p><p>More words here.</p></article>") == "One two More words here."


def test_region_without_an_element_of_its_own():
    page = "<body><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><h1>Head line</h1><p>Some words that make a text, quite a few of them.</p><p>More.</p></body>"
    assert text(page).endswith("Head line Some words that make a text, quite a few of them. More.")


def test_broken_and_empty_pages():
    assert text("") == text("<div></div>") == text("<!-- only -->") == ""
    assert text("plain words without any tag") == "plain words without any tag"
    assert text("<p>open <b>and never closed, but words") == "open and never closed, but words"
    assert text("<article><p>a &lt;b&gt; c</article>") == "a <b> c"
    long = "<article>" + "<p>word and word</p>" * 20000 + "</article>"
    assert text(long) == " ".join(["word and word"] * 20000)
    assert text("<div>" * 3000 + "deep words in here" + "</div>" * 3000) == "deep words in here"


def test_tables(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article>some words</article>"), (3, "u", "<article>some words</article>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.main_text(df).na.fill("").collect())
    assert got == [(1, "", "", 0), (2, "u", "", 0), (3, "u", "some words", 10), (3, "u", "some words", 10)]
    assert html.main_text(df.limit(0)).count() == 0


def test_weights_follow_the_labelled_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html.fit_weights(pages)
    assert weights["word"] == 1.0 and all(w < 0 for t, w in weights.items() if t != "word")
    assert weights["nav"] < weights["p"] and weights == html.fit_weights(pages.repartition(7))

import html
import re

import pytest

from quarry.llm import extraction

TREE = extraction.default_tree()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article>x<!-- c --> y</article>", "x y"),
        ("<nav><a>m</a></nav><article><h1>T</h1><p>a &lt; b<p>c<br>d</article><footer>f</footer>", "T a < b c d"),
        ("<script>if(a<b){'<p>'}</script><main><p>only  this\n one</p></main>", "only this one"),
        ("<article><p>a few words</p><section id='comments'><p>first!</p></section><p>more</p></article>", "a few words more"),
        ("<div class='cookie-notice'>ok?</div><form>search</form><article><p>text <b>bo</b>ld</p></article><aside>side</aside>", "text bold"),
        ("<div class='with-sidebar'><h1>Title here</h1><p>" + "word " * 40 + "</p></div><div id=sidebar>x</div>", "Title here " + "word " * 39 + "word"),
        ("<style>p{}</style><p>unclosed <i>tag", "unclosed tag"),
        ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
    ],
)
def test_pages(page, want):
    assert extraction.main_text(page, TREE) == want


def test_tree_fits_its_table():
    rows, labels = extraction.labelled_table()
    assert sum(TREE.says(r) == y for r, y in zip(rows, labels)) / len(rows) > 0.98


def test_articles_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        body = re.sub(r"<!--.*?-->", "", body, flags=re.DOTALL)
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|h2|li|ul)>", " ", body))
        assert got[r.page_id].text == " ".join(html.unescape(body).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 6), (None, "u", "", 6)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in extraction.extract(df).collect()] == [("", 0)] * 3
    assert extraction.extract(df.filter("false")).count() == 0


def test_quotes_that_stay_open():
    assert extraction.main_text('<article><p class="x>some text of a page</p><p>and more words here</p></article>', TREE) == "some text of a page and more words here"
    assert extraction.main_text("<article><p title='a > b'>it's one whole text</p></article>", TREE) == "it's one whole text"


def test_unseen_layouts():
    neighbours = ("words before", "density before", "words after", "density after")
    names = ("furniture", "article")
    whole, bare, alone = (extraction.held_out_accuracy(x) for x in ((), names, names + neighbours))
    # Where names say nothing, the neighbours' words and links help.
    assert whole > 0.98 and bare > 0.9 and bare > alone + 0.01


def test_clashing_columns_and_repeats(spark):
    page = "<nav>menu</nav><article><p>some words of a text</p></article>"
    df = spark.createDataFrame([(1, "u", page, "x", 7), (1, "u", page, "x", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in extraction.extract(df).collect()] == [(1, "some words of a text", 20)] * 2

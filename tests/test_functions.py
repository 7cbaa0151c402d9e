"""Text, URL, HTML and answer functions on rows that the driver tables don't have."""

from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import answers, html, text, urls
from quarry.operators import chunking


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_normalisation(spark):
    assert one(spark, " a  b\t\tc﻿\n\n\n\nd ", text.normalize_ws) == "a b c\n\nd"
    assert one(spark, "o'z oʻz oʼz o‘z o’z o‛z o′z o´z o`z  x\n y", text.normalize_search) == "oz " * 9 + "x y"
    assert one(spark, "Ишчи modda-12 é", text.query_terms) == ["Ишчи", "modda", "12"]
    assert one(spark, " '' ", text.match_expression) is None
    assert one(spark, "AND or NOT", text.match_expression) == "AND OR or OR NOT"


def test_language(spark):
    assert [one(spark, t, text.detect_language) for t in ("Салом", "oʻzbek", "qonun nima", "law")] == ["ru", "uz", "uz", "en"]


def test_quality_gate(spark):
    ui = "Universal qidiruv\nMain page\n" + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    q = one(spark, ui, text.quality)
    assert q.looks_like_ui and not one(spark, ui, lambda c: text.acceptable(text.quality(c)))
    assert not one(spark, ui + " 12-modda", text.quality).looks_like_ui
    same = "\n".join(["same line"] * 15 + [f"other {chr(97 + i)}" for i in range(5)])
    assert one(spark, same, text.quality).common_line_ratio == 0.75
    assert one(spark, "a\na\na", text.quality).common_line_ratio == 0.0
    assert one(spark, None, text.quality).n_words == 0


def test_windows(spark):
    for n in (0, 1, 9, 10, 11, 20, 37):
        words = [f"w{i}" for i in range(n)]
        for size, overlap in ((10, 3), (10, 10), (10, 15)):
            step = size - (overlap if overlap < size else size // 4)
            want, at = [], 0
            while at < n:
                want.append(" ".join(words[at : at + size]))
                if at + size >= n:
                    break
                at += step
            assert one(spark, words, lambda c: chunking.windows(c, size, overlap), "array<string>") == want


def test_marked_blocks(spark):
    marker = r"\d+\s*-?\s*modda\b"
    rows = one(spark, "pre 1-modda. a b 2 - modda c 32-moddasi d", lambda c: chunking.marked_blocks(c, marker))
    assert [tuple(r) for r in rows] == [("1-modda", "1-modda . a b"), ("2 - modda", "2 - modda  c 32-moddasi d")]
    assert one(spark, "nothing", lambda c: chunking.marked_blocks(c, marker)) == []


def test_paragraphs(spark):
    long = " ".join(f"x{i}" for i in range(200))
    got = one(spark, f"short  one\n \n{long}", lambda c: chunking.paragraph_chunks(c, 150, 20))
    assert got[0] == "short  one" and len(got) == 3 and got[2].split()[0] == "x130"


def test_urls(spark):
    s = Settings()
    assert one(spark, "https://docs.example.org/uz/docs/-12?x=1#a", urls.doc_id) == "-12"
    assert one(spark, "https://docs.example.org/uz/docs/-12", urls.doc_key) == "12"
    assert one(spark, "/a/b/-77_page.html", urls.path_id) == "-77"
    assert one(spark, "/a/b/page.html", urls.path_id) == "page"
    assert one(spark, "docs.example.org/", urls.base_url) == "https://www.docs.example.org"
    got = one(spark, "https://docs.example.org/uz/docs/5#t", lambda c: urls.variants(c, s))
    assert got[:3] == ["https://docs.example.org/uz/docs/5", "https://www.docs.example.org/uz/docs/5", "https://docs.example.org/docs/5"]
    assert got[3:] == [x.replace("/5", "/-5") for x in got[:3]]
    assert one(spark, "https://e.org/a?x=1&lang=uz", lambda c: urls.with_query(c, lang="ru")) == "https://e.org/a?x=1&lang=ru"
    assert one(spark, "//s.org/l?uddg=https%3A%2F%2Fa.uz%2Fb&z=1", urls.redirect_target) == "https://a.uz/b"
    assert one(spark, "https://www.my.gov.uz/x", urls.label) == "gov"
    assert one(spark, "https://x.gov.uz/", lambda c: urls.bonus(c, s)) == 0.20
    base = F.lit("https://www.docs.example.org")
    assert one(spark, "/docs/3", lambda c: urls.canonical(base, c)) == "https://www.docs.example.org/docs/3"
    assert one(spark, "https://docs.example.org/docs/3", lambda c: urls.canonical(base, c)) == "https://www.docs.example.org/docs/3"
    found = one(spark, '<a href="/x/a.pdf">', lambda c: urls.pdf_candidates(c, F.lit("https://docs.example.org/docs/-9"), s))
    assert found[0] == "https://docs.example.org/x/a.pdf" and "https://docs.example.org/pdffile/-9" in found


def test_json_and_numbers(spark):
    assert one(spark, '```json\n{"a": "b"}\n```', text.json_fields) == {"a": "b"}
    assert one(spark, 'so: {"a": "b"} ok', text.json_fields) == {"a": "b"}
    assert one(spark, "none", text.json_fields) == {}
    assert one(spark, "x", lambda c: text.safe_int(c, 7)) == 7
    assert one(spark, "a b c d", lambda c: text.shorten(c, 4)) == "a b …"


def test_html_tree():
    page = "<html><head><title>T &amp; t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>one<p>two <b>bold</b></article><footer>f</footer></body></html>"
    assert html.index_text(page) == ("Head", "Head\none\ntwo\nbold")
    title, rows = html.page_lines(page)
    assert title == "T & t" and "menu" not in "".join(rows) and "two " in rows
    long = "x" * 900
    root = html.parse(f"<body><div class='nav'>{long}{long}</div><div id='b'>{long}</div><p>s</p></body>")
    assert html.best_container(root).attrs.get("id") == "b"
    assert html.crawl_delay("User-agent: a\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: 1.5") == 1.5
    assert html.crawl_delay("User-agent: *\nCrawl-delay: x") is None


def test_best_container_looks_at_every_block():
    page = "<body>" + "<div>menu</div>" * 5000 + "<div>" * 900 + f"<div id='x'>{'y ' * 900}</div>" + "</div>" * 900 + "<p>z</p></body>"
    root = html.parse(page)
    found = html.best_container(root)
    assert found.name == "div" and found.parent.name == "body" and len(found.text(" ")) == 1799
    assert all(html._sizes(root)[n] == len(n.text(" ")) for n in root.walk() if len(n.children) != 1)
    assert "z" not in html.page_lines(page)[1]


def test_html_tree_decodes_the_references_it_is_given():
    page = "<body><article><h1>a &amp</h1><p class='x&amp;y'>&amp;lt; &#39;&eacute; \ue000&nbsp;&gt</p></article></body>"
    assert html.index_text(page) == ("a &", "a &\n&lt; 'é \ue000\xa0>")
    assert html.index_text(page, html.REFERENCES) == ("a &amp", "a &amp\n&lt; '&eacute; \ue000 &gt")
    assert html.parse(page, html.REFERENCES).find("p").attrs == {"class": "x&y"}


def test_answers(spark):
    src = F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    a = "First paragraph cites [2] and [1] [2].\n\nSecond one cites nothing here.\n\nTiny\n\nSources: [3]"
    rows = one(spark, a, lambda c: answers.blocks(c, src))
    assert [(r.text, r.anchorSources) for r in rows] == [("First paragraph cites and .", ["2", "1"]), ("Second one cites nothing here.", ["2"])]
    assert one(spark, "short [9]", lambda c: answers.blocks(c, src))[0].anchorSources == ["1", "2", "3"]
    assert one(spark, "x\nRelated questions:\n1. **Why so?**\n- no\n* How come?", answers.related_questions) == ["Why so?", "How come?"]
    assert one(spark, "1. What is the law? indeed\nshort?", answers.generated_questions) == ["What is the law?"]
    assert one(spark, '"soliq kodeksi?"\nab\nmehnat', lambda c: answers.query_list(c, "site:a.b")) == ["site:a.b soliq kodeksi", "site:a.b mehnat"]
    r = one(spark, '{"clean_question": "Q", "answer_language": "xx"}', lambda c: answers.rewrite(c, F.lit("soliq")))
    assert (r.clean_question, r.search_query, r.answer_language) == ("Q", "Q", "uz")

import time

import pytest

from catchmark.llm import html_extract as he


def page(body, k=0):
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t='</p>{k}';</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav>"
        f"<!-- ad {k} --><div class='ad'>Buy {k}</div>{body}<div id=sidebar>Side</div><footer>&copy; me</footer></body></html>"
    )


CASES = [
    (None, ""), ("", ""), ("<", "<"), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("a<b>b</b>c <i>d</i>", "abc d"), ("x<br>y", "x y"), ("a &amp; b &#233; &lt;p&gt;", "a & b é <p>"),
    (page("<article><h1>Head</h1><p>One\n two<b>x</b></p><p>Three<br>four</p></article>"), "Head One twox Three four"),
    (page("<article><p><b>Open<br><p>Next</article>"), "Open Next"),
    (page("<main><form>F</form><p>Text</p><div class='comments'><p>c</p></div><aside>s</aside><div class='cookie-notice'>n</div></main>"), "Text"),
    (page("<div class='post content'><p>Body</p><section id='commentsList'>said</section></div>"), "Body"),
    ("<article><p>cut off <a hr", "cut off"), ("<article><p title=\"a>b\">q</p></article>", "q"), ("<article><textarea>z</textarea>k</article>", "k"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_one_page(html, want):
    assert he.main_text(html) == want


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "t", "m", "x") for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string, text string, main string, host string")


def test_whole_table(spark):
    pages = [(f"http://a.net/{k}", page(f"<article><p>Text {k} " + "w " * k + "</p></article>", k)) for k in range(40)]
    pages += [("http://b.net/1", CASES[9][0]), (None, None), ("http://b.net/2", ""), ("http://a.net/5", pages[5][1]), ("http://c.net/", page("<article><p>" + "long " * 30_000 + "</p></article>"))]
    out = he.extract(rows(spark, pages))
    got = {r["page_id"]: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(pages)
    for i, (url, html) in enumerate(pages):
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, he.main_text(html), len(he.main_text(html)))


def test_template_without_main_elements(spark):
    """No article anywhere: what stays the same on every page of the host is template."""
    pages = [(f"http://a.net/{k}", f"<html><body><div><h2>Our site</h2></div><table><tr><td>News {k} of day {k}</td></tr></table><p>All rights</p></body></html>") for k in range(12)]
    got = he.extract(rows(spark, pages)).collect()
    assert sorted(r["text"] for r in got) == sorted(f"News {k} of day {k}" for k in range(12))


def test_template_finds_the_slot_by_its_class(spark):
    pages = [(f"http://a.net/{k}", page(f"<div class='entry'><p>E {k}</p></div>", k)) for k in range(8)]
    own = he.templates(rows(spark, pages)).first()
    assert own["n_pages"] == 8 and own["main"] == ["/html/body/div.entry"]


def test_classes_that_do_not_nest_are_no_template():
    token = lambda path, vector, n=10: {"path": path, "n": n, "vector": vector, "least": 1, "most": 1, "low": 1, "high": 2}
    assert he.template_of([token("/html", 1), token("/html/article", 1)], 10)[0] == ["/html/article"]
    assert he.template_of([token("/html", 1), token("/html/x/article", 2), token("/html/x/y", 2)], 10)[0] == []
    assert he.template_of([token("/html", 1, 3), token("/html/article", 1, 3)], 10)[0] == []


def test_hot_host_is_salted_beyond_the_broadcast(spark, monkeypatch):
    pages = [(f"http://a.net/{k}", page(f"<article>{k}</article>", k)) for k in range(30)]
    monkeypatch.setattr(he, "BROADCAST_HOSTS", 0)
    assert sorted(r["text"] for r in he.extract(rows(spark, pages)).collect()) == sorted(map(str, range(30)))


def test_empty_table(spark):
    assert he.extract(rows(spark, [("u", "h")]).limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<html><body class='has-sidebar'><article><p>Kept</p></article></body></html>", "<body><main class='content with-sidebar'><p>Kept</p></main></body>",
        "<article class='post comments-open'><h2 id='search-methods'>Kept</h2></article>", "<div class='wrap has-sidebar'><article><p>Kept</p></article></div>", "<div class='promo'>Kept</div>",
        "<div class='wrap has-sidebar'><p>Kept</p></div><div class='widget'>w</div>",
    ],
)
def test_words_do_not_hide_what_holds_the_text(html):
    assert he.main_text(html) == "Kept"


def test_words_hide_only_what_the_template_shows(spark):
    """A section named by its own heading stays; the comments that stand on every page go."""
    body = lambda k: f"<article><p>Text {k}</p>" + ("<section id='related-work'>Work 3</section>" if k == 3 else "") + f"<div class='comments'>said {k}</div></article>"
    got = he.extract(rows(spark, [(f"http://a.net/{k}", page(body(k), k)) for k in range(8)])).collect()
    assert sorted(r["text"] for r in got) == sorted(f"Text {k}" + " Work 3" * (k == 3) for k in range(8))


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='entry'>{}</div>"])
def test_constant_places_inside_the_main_slot_are_template(spark, around):
    """A notice of a neutral class that stands the same on all pages of the host, inside the article."""
    pages = [(f"http://a.net/{k}", page(around.format(f"<div class='x1'><p>Read our terms</p></div><p>Text {k}</p>"), k)) for k in range(8)]
    assert sorted(r["text"] for r in he.extract(rows(spark, pages)).collect()) == sorted(f"Text {k}" for k in range(8))


def test_equal_pages_keep_their_text(spark):
    pages = [("http://a.net/", page("<article><p>Same</p></article>"))] * 8
    assert [r["text"] for r in he.extract(rows(spark, pages)).collect()] == ["Same"] * 8


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body><form id='aspnetForm'><nav>m</nav><article><p>Kept</p></article></form></body>", "Kept"),
        ("<body><form id='aspnetForm'><div><p>Kept text of the page</p></div></form><form>Search</form></body>", "Kept text of the page"),
        ("<article><form><p>All of the text</p><label>Name</label></form></article>", "All of the text Name"),
        ("<article><p>A text of some length</p><form><label>Name</label><p>Join</p></form></article>", "A text of some length"),
        ("<body><form>Search <label>here</label></form></body>", ""),
        ("<article><button>Share<p>Kept</p></article>", "Kept"),
        ("<article><svg><p>Kept</p></article>", "Kept"), ("<article>a</article><script>b", "a"),
        ("<article><p class='a>b</p><p>c</p></article>", "b c"),
    ],
)
def test_forms_and_broken_markup(html, want):
    assert he.main_text(html) == want


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<a '\" ", "<a '>'", "</p", "<!--", "<!", "<svg", "<script ", "<", "<div></b>", "<p class='", "<form>", "<div class=ad>"])
def test_a_megabyte_of_broken_markup(unit):
    start = time.perf_counter()
    he.main_text("<article>" + unit * (1_000_000 // len(unit)))
    he.main_text(unit * (1_000_000 // len(unit)) + ">")
    assert time.perf_counter() - start < 30

import pytest
from pyspark.sql import functions as F

from touchline.llm import html_template as H

PAGES = [
    ("<article><p>a&nbsp;&amp;&lt;b&gt; &#8212; &eacute;&#x41;</p><pre>x\n  y</pre></article>", "a &<b> — éA x y"),
    ("<article><p>one<b>two</b>three<br>four <span>five</span></p><li>six</article>", "onetwothree four five six"),
    ("<article><h1>T</h1><aside>promo</aside><p>Text</p><section class='comments'><p>c</p></section><form>x</form></article>", "T Text"),
    ("<nav>menu</nav><article><p>one<p>two<div>three", "one two three"),
    ("<article><p>a<!-- x > y -->b</p><script>if (a<b) {}</script><style>p{}</style><noscript>n</noscript>c</article>", "ab c"),
    ("<body><header>top</header><main><p>Body</p></main><footer>end</footer>", "Body"),
    ("<div class='ad'>buy</div><p>text</p><div hidden>no</div><div style='display: none'>no</div>", "text"),
    ("just text < 5 and > 3", "just text < 5 and > 3"),
    ("", ""),
    (None, ""),
    ("<article><p title='a > b'>kept</p><img alt=\"x>y\"> too</article>", "kept too"),
    ("<article><p data-x=it's>Text</p><p a='b\">c</p>' x>d</article>", "Text d"),
    ("<article><header><h1>Title</h1></header><p>Body</p><footer>tags</footer></article>", "Title Body"),
    ("<body class='has-sidebar'><article class='post hentry comment-open'>Whole</article>", "Whole"),
    ("<div id='search-results-page'><article>Found</article></div>", "Found"),
    ("<main><h1>Story</h1><p>a long main text</p></main><article>teaser</article>", "Story a long main text"),
    ("<main><p>x</p><article>the article is most of main</article></main>", "the article is most of main"),
    ("<ARTICLE>caps</ARTICLE>tail", "caps"),
    ("<article>a<!-- never closed", "a"),
    ("<article>a<span class='ad'>x</span>b<div class='ad'>y</div>c", "ab c"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert H.main_text(html) == text


OWN = "<h1>T</h1><p>Own</p>"


@pytest.mark.parametrize(
    "html",
    [
        f"<body class='no-sidebar'>{OWN}", f"<body class='has-sidebar menu-open'><article>{OWN}</article>", f"<article class='share-post'>{OWN}</article>", f"<main class='search'>{OWN}</main>", f"<article><div class='related-work'>{OWN}</div></article>", f"<form><nav>x</nav><article>{OWN}</article></form>",
        f"<div class='sidebar'><main>{OWN}</main></div>", f"<form><nav>x</nav>{OWN}</form>", f"<article>{OWN}<section class='comments'><article>a longer text than the article's</article></section></article>", f"<article>{OWN}</article><div class='sidebar'><article>teaser</article></div>",
        f"<article>{OWN}<div class='cookie-banner'>x</div><div hidden>x</div></article>",
    ],
)
def test_words_of_a_class_drop_no_main_text(html):
    assert H.main_text(html) == "T Own"


def test_the_template_confirms_parts_of_class_names(spark):
    page = lambda i: f"<article><p>Own {i}</p><div class='related-work'><p>Work {i}</p></div><div class='x-share-bar'><p>Share this</p></div></article>"
    df = spark.createDataFrame([(i, f"https://parts.example.org/{i}", page(i)) for i in range(6)] + [(9, "https://single.example.org/", page(9))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: f"Own {i} Work {i}" for i in range(6)} | {9: "Own 9 Work 9 Share this"}


def test_a_host_s_template_goes_where_nothing_is_marked(spark):
    page = lambda i: f"<html><body><div>The Daily Page</div><div><a>Home</a> <a>About</a></div><div><h2>Story {i}</h2><p>Text number {i} of its own.</p></div><div>All rights reserved</div></body></html>"
    df = spark.createDataFrame([(i, f"https://Plain.example.org/{i}", page(i)) for i in range(8)] + [(99, "https://alone.example.org/", page(99))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert {i: got[i] for i in range(8)} == {i: f"Story {i} Text number {i} of its own." for i in range(8)}
    assert got[99] == "The Daily Page Home About Story 99 Text number 99 of its own. All rights reserved"


def test_copies_of_a_page_are_no_template(spark):
    page = lambda i: f"<html><body><div>The Daily Page</div><div><h2>Story {i}</h2><p>Text number {i} of its own.</p></div></body></html>"
    rows = [(i, f"https://copied.example.org/{i}", page(max(i, 6))) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == {i: f"Story {max(i, 6)} Text number {max(i, 6)} of its own." for i in range(12)}
    pair = df.filter("page_id < 6").unionByName(df.filter("page_id = 11"))
    assert {r["page_id"]: r["text"] for r in H.extract(pair).collect()}[0] == "The Daily Page Story 6 Text number 6 of its own."


def test_orders_of_classes():
    one, two = {1: 5, 2: 5, 9: 7}, {5: 2, 7: 1}
    assert H.page_order([1, 2, 1, 2, 9], one, two) == {5: (1, 2), 7: (9,)}
    assert H.page_order([1, 1, 2, 2], one, two) == {5: None} and H.page_order([1, 2, 2, 1], one, two) == {5: None}
    # rounds of the smaller class cross those of the larger one
    crossed = {1: 5, 2: 5, 3: 5, 7: 6, 8: 6}
    assert H.page_order([1, 7, 2, 8, 3], crossed, {5: 3, 6: 2}) == {5: (1, 2, 3), 6: None}
    assert H.page_order([1, 7, 8, 2, 3], crossed, {5: 3, 6: 2}) == {5: (1, 2, 3), 6: (7, 8)}


def test_slots_are_the_innermost_places():
    places = {1: (5, 0, 3), 2: (5, 1, 3), 3: (5, 2, 3), 7: (6, 0, 2), 8: (6, 1, 2), 9: (4, 0, 1)}
    tokens = [0, 1, 11, 7, 13, 8, 15, 7, 17, 8, 2, 9, 19, 3, 21]
    assert H.slots(tokens, [i for i, t in enumerate(tokens) if t > 10], places) == [(5, 0), (6, 0), (5, 0), (6, 0), (5, 1), None]


def test_classes_and_template_equal_plain_counts(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    kept = H.parsed(pages).select(F.col("__host").alias("host"), "__p.*").dropDuplicates(["host", "page"]).cache()
    found = H.classes(kept)
    by_host = {}
    for r in {(r["url"], r["html"]) for r in pages.collect()}:
        by_host.setdefault(r[0].split("/")[2].lower(), {})[r[1]] = H.parse(r[1]).tokens
    want = {}
    for name, own in by_host.items():
        if len(own) < H.TEMPLATE_PAGES:
            continue
        vectors = {t: tuple(x.count(t) for x in own.values()) for t in {t for x in own.values() for t in x}}
        for t, v in vectors.items():
            support = sum(n > 0 for n in v)
            if support >= H.TEMPLATE_SUPPORT and support >= (H.TEXT_SHARE if t & 1 else H.TAG_SHARE) * len(own):
                want.setdefault((name, v), set()).add(t)
    got = {}
    for r in found.collect():
        got.setdefault((r["host"], r["class"]), set()).add(r["token"])
    assert sorted((k[0], sorted(v)) for k, v in got.items()) == sorted((k[0], sorted(v)) for k, v in want.items())
    # each valid class comes in its order on nearly all of the host's pages
    for r in H.template(kept, found).groupBy("host", "class").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t")).collect():
        order = [x["token"] for x in r["t"]]
        rows = [[t for t in x if t in order] for x in by_host[r["host"]].values()]
        rows = [x for x in rows if x]
        assert sum(x == order * (len(x) // len(order)) for x in rows) >= H.VALID_SHARE * len(rows)


def test_the_template_decides_the_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    want = {r["page_id"]: H.main_text(r["html"]) for r in pages.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    # the article is the one element that holds most of what a reader sees, which labels and template must agree on
    distinct = {}
    for r in pages.collect():
        distinct.setdefault(r["url"].split("/")[2].lower(), set()).add(r["html"])
    known = [i for i, r in got.items() if len(distinct[r["url"].split("/")[2].lower()]) >= H.TEMPLATE_PAGES]
    assert known and sum(got[i]["by_template"] for i in known) >= 0.95 * len(known)


def test_the_template_decides_without_labels(spark):
    """Slots tell what nothing on a page does: an unlabelled block of links, and one of the same text everywhere."""
    page = lambda i: f"<html><body><div><a>Topic {i}</a> <a>More {i}</a></div><div><h2>Story {i}</h2><p>Text number {i} of its own and more.</p><p>Again {i}.</p></div><div>Call us any time</div></body></html>"
    df = spark.createDataFrame([(i, f"https://links.example.org/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["by_template"]) for r in H.extract(df).collect()} == {i: (f"Story {i} Text number {i} of its own and more. Again {i}.", True) for i in range(8)}


@pytest.mark.parametrize("html", ["<a " * 300_000, "<div>" * 100_000 + "</p>" * 100_000, "<li><ul>" * 60_000, "<" * 1_000_000, "<!--" * 250_000, "<p x='" * 150_000, "<a><b>" * 60_000 + "x" + "</i>" * 60_000, "<a / " * 200_000])
def test_hostile_pages_take_linear_time(html):
    import time

    began = time.process_time()
    H.main_text(html)
    assert time.process_time() - began < 15


def test_text_repeated_inside_articles_stays(spark):
    df = spark.createDataFrame([(i, "https://a.example/x", f"<nav>n</nav><article><p>Same line.</p><p>Own {i}</p></article>") for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(df).collect()} == {f"Same line. Own {i}" for i in range(6)}


@pytest.mark.parametrize("html, want", [
    ("<article><p>A <svg viewBox='0 0 1 1'/> rest</p><p>more</p></article>", "A rest more"), ("<article><p>A <svg><path d='x'/><text>no</text></svg> rest</p></article>", "A rest"), ("<article><p>A <svg> rest</p><p>more</p></article>", "A rest more"),
    ("<article><title>t<p>body text</p></article>", "t body text"), ("<article><iframe src='x'><p>one</p><iframe><p>two</p></article>", "one two"), ("<article><p>one</p><script>var a = 1;", "one"), ("<article><svg/><svg></svg><p>x</p></article>", "x"),
])
def test_raw_elements_without_an_end_take_nothing_with_them(html, want):
    assert H.main_text(html) == want


def test_the_template_overrules_quiet_words_and_finds_unmarked_adverts(spark):
    """Labels alone are wrong here both ways: a paper's discussion is marked like furniture, an advert is not marked at all."""
    advert = "Buy two of our wonderful chairs today and get a third one for nothing"

    def page(i):
        return f"<html><body><div class='menu'><a>Home</a></div><article><h1>Paper {i}</h1><p>Result {i} of the study.</p><section id='discussion'><h2>Discussion</h2><p>We discuss finding {i} at length.</p></section><div><p>{advert}</p></div><div class='notice'>All rights of this site are reserved by us</div><div class='comments'><p>Reader {i} says hello</p></div></article><div class='footer'>The end</div></body></html>"

    df = spark.createDataFrame([(i, f"https://papers.example.org/{i}", page(i)) for i in range(10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: f"Paper {i} Result {i} of the study. Discussion We discuss finding {i} at length." for i in range(10)}
    alone = H.main_text(page(3))
    assert advert in alone and "discuss" not in alone


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "no url at all", "<article>x</article>"), (2, "no url at all", "<article>x</article>"), (None, "https://h/", ""), (3, "https://h/", long), (4, "https://h/", "<" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "host", "template")})
    got = H.extract(df).select("page_id", "text", "n_chars").collect()
    assert len(got) == 6 and sorted(r["text"] for r in got if r["page_id"] == 2) == ["x", "x"]
    assert [len(r["text"]) for r in got if r["page_id"] == 3] == [5 * 50_000 - 1] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(df.limit(0)).count() == 0


def test_query(spark, small):
    from touchline.llm.queries import op1_html_text

    df = op1_html_text(spark, small)
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"] and df.count() == spark.read.parquet(f"{small}/pages.parquet").count()
    assert df.filter("text rlike '<[a-z/]'").count() == 0

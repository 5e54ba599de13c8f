import html
import re

from llm_data import SF_MID
from tablewright.llm import html_text, queries
from tablewright.llm.html_text import main_text

LONG = "One plain sentence of the article, long enough to count as text. "


def test_query_matches_the_marked_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, SF_MID).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert r.text == want and r.n_chars == len(want)


def page(body):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_boilerplate_goes():
    article = "<article><header><h1>A &amp; B</h1></header>" + f"<p>{LONG * 2}<p>x<b>y</b>z&nbsp;&lt;tag&gt;<br>new</article>"
    around = [
        "<header>Site name and a long slogan that says nothing at all</header>", "<nav><a href=1>Home</a> <a href=2>News</a></nav>",
        f"<aside>{LONG}</aside>", f"<div class='side-bar sidebar'>{LONG}</div>", f"<form><label>Name</label><input>{LONG}</form>",
        f"<div id=cookie-notice>{LONG}</div>", f"<section class='comments'><p>{LONG}</p></section>", f"<div class=ad>{LONG}</div>",
        "<script>if (a < b) document.write('<p>no</p>')</script>", f"<noscript>{LONG}</noscript>", f"<footer>{LONG}</footer>",
        f"<div role=dialog>{LONG}</div>", "<!-- a comment -->",
    ]
    want = f"A & B {LONG * 2}xyz <tag> new".replace("text. x", "text. x")
    assert main_text(page("".join(around[:6]) + article + "".join(around[6:]))) == want
    assert main_text(page(article)) == want


def test_density_finds_unmarked_content():
    links = "<div>" + "".join(f"<a href={i}>link number {i}</a> " for i in range(40)) + "</div>"
    got = main_text(page(f"{links}<div><h2>Title</h2>{''.join(f'<p>{LONG * 3}</p>' for _ in range(4))}</div>{links}"))
    assert got == "Title " + " ".join([(LONG * 3).strip()] * 4)


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<nav>only</nav>") == ""
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text("<div>" * 5000 + LONG + "</div>" * 5000) == LONG.strip()
    assert main_text("</p></div><p>stray</i> tags</p>") == "stray tags"
    df = spark.createDataFrame([(1, None, None, 5), (1, "u", "<p>a</p>", 5), (None, "u", "", 5)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "", "a"]
    assert html_text.extract(df.limit(0)).count() == 0


def paragraphs(n, sentences, mark):
    return "".join(f"<p>{mark}{i} {LONG * sentences}</p>" for i in range(n))


def plain(body):
    return " ".join(re.sub("<[^>]*>", " ", body).split())


def test_content_around_the_densest_block_is_whole():
    menu = "<ul>" + "".join(f"<li><a href={i}>some menu entry {i}</a></li>" for i in range(30)) + "</ul>"
    sections = f"<section>{paragraphs(10, 5, 'a')}</section><section><h2>Next</h2><p>Yes.</p>{paragraphs(10, 3, 'b')}</section>"
    for body in (
        f"<h1>A headline of the page</h1>{sections}",  # sections beside one another
        f"<h1>A headline of the page</h1><div>{paragraphs(9, 4, 'c')}</div><p>No.</p>",  # an inner wrapper
        f"<div><div><h1><a href=x>A headline</a></h1><p>By someone</p></div><div><div>{sections}</div></div></div>",
        f"<h1>Head</h1><p>{LONG}</p><div><p>{LONG * 30}</p></div><p>Short end.</p>",
    ):
        for html in (f"<article>{body}</article>", f"<main><div>{body}</div></main>", f"<div id=a>{body}</div>", f"<div><div>{body}</div></div>"):
            assert main_text(page(f"<div>{menu}</div>{html}<div>{menu}</div>")) == plain(body)
    two = f"<article>{paragraphs(9, 5, 'a')}</article><article><h2>Second</h2>{paragraphs(2, 1, 'b')}</article>"
    assert main_text(page(f"<main><h1>Both</h1>{two}{menu}</main>")) == plain("<h1>Both</h1>" + two)


def test_wrappers_with_names_of_boilerplate_keep_the_content():
    body = "<h1>A headline of the page</h1>" + paragraphs(6, 3, "a")
    ad = f"<div class='ad ad-slot'>{LONG}</div><div id=main-sidebar><p>{LONG}</p></div>"
    names = (
        "id='page' class='has-sidebar'", "class='no-sidebar'", "class='with-social-nav'", "class='elementor-widget-text'",
        "class='elementor-widget'", "class='social-history'", "class='page--sidebar'", "class='notice-of-intent'", "class='ad_free_page'",
        "class='widget'", "class='content-sidebar-wrap'", "id='search'", "class='related-content'", "role='dialog'",
    )
    for name in names:
        for html in (f"<div {name}><article>{body}</article></div>", f"<article><section {name}>{body}</section></article>", f"<div {name}>{body}</div>"):
            assert main_text(page(ad + html + ad)) == plain(body), (name, html[:60])
    assert main_text(page(f"<form id=aspnet>{ad}<main>{body}</main></form>")) == plain(body)
    part = paragraphs(3, 2, "b")
    for name in names[:9]:  # by their names alone, also where each holds little of the page
        assert main_text(page(f"<div>{body}<div {name}>{part}</div>{body}</div>")) == plain(body + part + body)


def test_other_articles_and_comments_still_go():
    body = "<h1>A headline of the page</h1>" + paragraphs(6, 3, "a")
    card = "<article class='card'><h3><a href=1>Some other story</a></h3><p>Read this one as well, it is good.</p></article>"
    said = f"<div id='comments' class='comments-area'><article class=comment-body><p>{LONG * 3}</p></article></div>"
    for html in (f"<article>{body}</article>", f"<div>{body}</div>"):
        assert main_text(page(html + f"<section class='related'>{card * 3}</section>" + said + f"<aside>{card}</aside>")) == plain(body)
    assert main_text(page(f"<article>{body}<section class=comments><p>{LONG * 40}</p></section></article>")) == plain(body)


def test_no_page_ends_the_job(spark):
    """Broken declarations are comments, cut-off tags are no text, and what
    never closes is read in time that follows the page's length."""
    good = f"<article><p>{LONG}</p></article>"
    broken = ["<![foo[x]]>", "<![ x ]>", "<!foo>", "<!>", "<![CDATA[a]]>", "<!ELEMENT x [", "<?x", "<!-- x", "<div", "<a href='", "</", "<!", "&#x;", "a\0b"]
    pages = [(i, x + good) for i, x in enumerate(broken)] + [(i + 100, good + x) for i, x in enumerate(broken)]
    many = ["<div>", "<span>", "<p>", "<li>", "<!--", "<![x", "<a ", "<", "</", "&", "</b>", "<![x]>", "<div></i>"]
    pages += [(i + 200, good + x * 40_000) for i, x in enumerate(many)]
    pages += [(300, good), (300, good), (None, good)]  # repeated rows
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id is None or r.page_id >= 100:
            assert r.text.startswith(LONG.strip()), (r.page_id, r.text[:50])
    assert [main_text(x + good) for x in broken[:5]] == [LONG.strip()] * 5
    assert main_text(good + "<div class='x") == LONG.strip() == main_text(good + "<!-- x " + good)
    assert main_text(f"<p>{LONG} I <3 it and 1 < 2") == f"{LONG}I <3 it and 1 < 2"


def test_very_long_page():
    body = paragraphs(20_000, 2, "a")
    assert main_text(page(f"<nav>{LONG}</nav><article>{body}</article>")) == plain(body)

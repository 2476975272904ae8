import pytest
from tabsonde.llm.html_text import Tree, extract_text, main_text

SCHEMA = "page_id long, url string, html string, host string, template string, hash long"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((r.page_id or -1, r.text, r.n_chars) for r in extract_text(df, **options).collect())


def text(html, template=frozenset()):
    return main_text(Tree(html).root, template)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<p><b>Title.<br><p>next</p>", "Title.\nnext"),
        ("<p>one\n two\t three </p>", "one two three"),
        ("<p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &nbsp;&copy</p>", "a & b <c> ééé ©"),
        ("<p>x<script>var t='</p>';</script>y</p>", "xy"),
        ("<p>x<style>p{}</style>y<!-- no <p> --></p>", "xy"),
        ("<nav>menu</nav><p>text</p><footer>foot</footer>", "text"),
        ("<header>top</header><p>text</p><aside>side</aside>", "text"),
        ("<article><header><h1>Title</h1></header><p>a</p></article>", "Title\na"),
        ("<div class='ad'>buy</div><article><p>a</p></article><div>late</div>", "a"),
        ("<article><p>a</p></article><article><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><div class='comments'><article>c</article></div></article>", "a"),
        ("<article><p>a</p><div id='cookie-notice'>ok</div><form>f</form><p>b</p></article>", "a\nb"),
        ("<main><h2>T</h2><ul><li>x<li>y</ul></main><p>no</p>", "T\nx\ny"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article><p>a</b> b</i></p></div><p>c</article>", "a b\nc"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n3"),
        ("<p>a <a href='x'>link</a>, <em>b</em>.</p>", "a link, b."),
        ("<title>no</title><p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p class='shareholders'>kept</p><p class='share'>gone</p>", "kept"),
        ("<article><p>tail &am", "tail &am"),
    ],
)
def test_pages(html, expected):
    assert text(html) == expected


def test_deep_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert text(deep) == "x"


def page(k, body):
    return f"<html><body>{body}</body></html>"


def test_template_of_a_site(spark):
    rows = []
    for k in range(30):
        body = f"<div class='top'><p>Site name</p></div><div class='story'><p>Story {k}</p></div>"
        rows.append((k, f"http://a.example/{k}", page(k, body + "<p>Imprint</p>")))
    # Another host, few pages: the same subtrees are no template there.
    rows.append((40, "http://b.example/1", rows[0][2]))
    found = {i: t for i, t, _ in run(spark, rows)}
    assert all(found[k] == f"Story {k}" for k in range(30) if k)
    assert found[40] == "Site name\nStory 0\nImprint"


def test_paragraphs_of_articles_are_no_template(spark):
    rows = [
        (
            k,
            "https://c.example/x",
            f"<article><h1>T{k}</h1><p>All rights reserved.</p>"
            "<div class='box'><p>Read our other news</p></div></article>",
        )
        for k in range(20)
    ]
    assert {t for _, t, _ in run(spark, rows)} == {f"T{k}\nAll rights reserved." for k in range(20)}


def test_against_counting_by_hand(spark):
    """Templates are what recurs on five pages and a tenth of a host's pages."""
    rows = []
    for k in range(100):
        parts = [f"<p>own {k}</p>", f"<p>tenth {k % 10}</p>", f"<p>ninth {k % 12}</p>"]
        rows.append((k, f"http://HOST.example:80/{k}?q", page(k, "".join(parts))))
    found = {i: t for i, t, _ in run(spark, rows)}
    for k in range(1, 100):
        assert found[k] == f"own {k}\nninth {k % 12}"


def test_odd_rows(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [
        (1, None, "<p>x</p>"), (2, "no address", None), (None, "http://d.example", "<p>y</p>"),
        (3, "http://d.example", ""), (3, "http://d.example", ""), (4, "x", long), (5, "", "<<<>>"),
    ]
    found = run(spark, rows)
    assert len(found) == len(rows)
    by_id = {i: (t, n) for i, t, n in found}
    assert by_id[1] == ("x", 1) and by_id[2] == ("", 0) and by_id[-1] == ("y", 1)
    assert by_id[4][1] == 50_000 * 10 - 1
    empty = spark.createDataFrame([], SCHEMA)
    assert extract_text(empty).collect() == []


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<body class='has-sidebar'><article><p>a</p></article></body>", "a"),
        ("<body class='sidebar'><p>a</p></body>", "a"),
        ("<div class='content with-sidebar'><article><p>a</p></article></div>", "a"),
        ("<article class='post comments-open'><p>a</p></article>", "a"),
        ("<article class='related'><p>a</p></article>", "a"),
        ("<main class='widget'><p>a</p></main><p>no</p>", "a"),
        ("<form><nav>menu</nav><article><p>a</p></article></form>", "a"),
        ("<form><div><p>a long text</p></div></form><p>end</p>", "end"),
        ("<form><div><p>a long text</p></div></form>", "a long text"),
        ("<form><h1>T</h1><div><p>a long text</p></div></form><p>end</p>", "T\na long text\nend"),
        ("<div class='widget'><article><p>a</p></article></div><p>more text here</p>", "a\nmore text here"),
        ("<div class='sidebar'>side</div><p>a long text</p>", "a long text"),
        ("<form>name</form><p>a long text</p>", "a long text"),
    ],
)
def test_names_and_forms_around_the_text(html, expected):
    assert text(html) == expected


LONG = "<p>" + "many words of readers " * 20 + "</p>"


@pytest.mark.parametrize(
    "around",
    [
        f"<div id='comments'>{LONG}</div>",
        f"<section class='comments-section'>{LONG}</section>",
        f"<div class='comment-list'><article>{LONG}</article></div>",
        f"<div class='post-comments'>{LONG}</div>",
        f"<ol class='commentList'><li>{LONG}</ol>",
        f"<article class='comment even depth-1'>{LONG}</article>",
        f"<div id='disqus_thread'>{LONG}</div>",
        f"<div class='ad-slot ad-300x250'>{LONG}</div>",
        f"<div class='sticky-ad'>{LONG}</div>",
        f"<div class='related-posts'>{LONG}</div>",
        f"<form class='contact'>{LONG}<input></form>",
        f"<div class='cookie-banner'>{LONG}</div>",
    ],
)
def test_comments_adverts_and_forms_of_any_size(around):
    for html in (
        f"<article><p>a</p><p>b</p></article>{around}",
        f"<article><p>a</p>{around}<p>b</p></article>",
        f"<div><p>a</p></div>{around}<p>b</p>",
        f"{around}<main><p>a</p><p>b</p></main>",
    ):
        assert text(html) == "a\nb"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<div class='comments-open has-ads'><p>a</p></div><p>b</p>", "a\nb"),
        ("<div class='sidebar-layout'><p>a</p></div><p>b</p>", "a\nb"),
        ("<div class='content-sidebar'><p>a</p></div><p>b</p>", "a\nb"),
        ("<div class='comments-page-wrap'><main><p>a</p></main></div>", "a"),
        ("<div class='ad-wrapper'><article><p>a</p></article></div>", "a"),
        ("<div id='header'>top</div><div><p>a</p></div>", "a"),
        ("<article><div class='header'><h1>T</h1></div><p>a</p></article>", "T\na"),
        ("<article>a</article><article class='related'>b</article>", "a"),
        ("<div id='comments'><article>c</article></div><p>a</p>", "a"),
        ("<div class='commentary'><p>a</p></div><p class='addition'>b</p>", "a\nb"),
    ],
)
def test_names_by_first_and_last_word(html, expected):
    assert text(html) == expected

import pytest

from flowwarden.llm.html_extract import article, extract, style_tree

PAGES = [
    ("<p>a<p>b", "a\nb"),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    ("<article><h1>T &lt;x&gt;</h1><p>a  b\n c<br>d</p></article><footer>f</footer>", "T <x>\na b c d"),
    ("<nav>n</nav><div class='sidebar box'>s</div><main><p>m</p><aside>x</aside></main><p>outside</p>", "m"),
    ("<body><header>h</header><div id=comments><p>c</p></div><p>one</p><form>f<input value='v'></form></body>", "one"),
    ("<script>var t='</p><p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<article><header><h1>Title</h1></header><p>text</article><div class=ad>buy</div>", "Title\ntext"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one\ntwo\nthree\nfour"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p title='a>b'>y&eacute;s</p>", "yés"),
    ("<div class='add address'>kept</div><div class='ad-slot'>gone</div>", "kept"),
    ("<p>a</b></div></p>b<i>c</i>d", "a\nbcd"),
    ("<p>x < y & z</p>", "x < y & z"),
    ("<article><p>a</p></article><article class=comment><p>c</p></article><article><p>b</p></article>", "a\nb"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_article(page, text):
    assert article(page) == text


STORY = "the story of the page stands in a div and is longer than its teaser"


def test_a_teaser_does_not_stand_for_the_page():
    assert article(f"<div class=x><p>{STORY}</p></div><div class=y><article>a teaser card</article></div>") == f"{STORY}\na teaser card"


def test_a_form_around_the_page_stays():
    page = f"<form method=post><input type=hidden name=__VIEWSTATE><input name=q><div><h1>Title</h1><p>{STORY}</p></div></form>"
    assert article(page) == f"Title\n{STORY}"
    assert article(f"<p>{STORY}</p><form><p>Your mail</p><input name=mail></form>") == STORY
    assert article(f"<p>{STORY}</p><form><p>kept</p><input type=hidden></form>") == f"{STORY}\nkept"


def site(n, notice="Members get free delivery this week"):
    """Pages whose frame no name tells: the same box on each, other text in the other box."""
    return [(i, f"http://shop.example/{i}", f"<div class='x1'>{notice}</div><div class='x2'><p>story {i} of {i * 7}</p><p>tail {i}</p></div>"
                                            f"<div class='x3'><span>Call us</span> <a href='/{i}'>now</a></div>") for i in range(n)]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, host string")


def test_style_tree_removes_the_frame(spark):
    rows = site(30) + [(100, "http://other.example/", site(1)[0][2]), (101, None, None), (102, "no url", "<p>x</p>"), (103, "http://SHOP.example:80/", "<p>own</p>"),
                       (104, "http://other.example/", "")]
    got = {r.page_id: r for r in extract(rows_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"story {i} of {i * 7}\ntail {i}" for i in range(30))
    assert got[100].text == "Members get free delivery this week\nstory 0 of 0\ntail 0\nCall us now"  # too few pages to tell
    assert got[101].text == "" and got[101].url is None and got[102].text == "x" and got[103].text == "own" and got[104].text == ""


def test_every_block_is_a_node(spark):
    """A menu cell beside the article's, a constant item beside a varying one, and a
    notice in a paragraph go; copies of an article stay."""
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(20))
    page = lambda i, body: ("<table><tr><td><p>Home</p><p>Contact us</p></td><td><h1>Title {0}</h1><p>We use your data</p>{1}</td></tr></table>"  # noqa: E731
                            "<ul><li>About</li><li>You are on page {0}</li></ul>").format(i, body)
    rows = [(i, "http://t.example/", page(i, f"<p>{story(i)}</p>")) for i in range(40)]
    rows += [(100 + i, "http://t.example/", page("same", f"<p>{story('same')}</p>")) for i in range(60)]  # one page often
    rows += [(200 + i, "http://near.example/", f"<h1>Story</h1><p>{story('near')}</p><p>{story('near2')}</p><p>id{i}</p>") for i in range(30)]
    got = {r.page_id: r.text for r in extract(rows_of(spark, rows)).collect()}
    assert all(got[i] == f"Title {i}\n{story(i)}\nYou are on page {i}" for i in range(40))
    assert {got[100 + i] for i in range(60)} == {f"Title same\n{story('same')}\nYou are on page same"}
    assert all(got[200 + i] == f"Story\n{story('near')}\n{story('near2')}\nid{i}" for i in range(30))


def test_importances(spark):
    t = style_tree(rows_of(spark, site(16)).select("host", "html")).collect()
    assert len(t) == 3 and {r.pages for r in t} == {16}
    content = sorted(r.content for r in t)
    assert content[0] == content[1] == 0 and content[2] == 1 and all(r.presentation == 0 for r in t)


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://a.example/x", "<article><h1>Same</h1><p>the same story on every page</p></article>") for i in range(20)]
    assert {r.text for r in extract(rows_of(spark, rows)).collect()} == {"Same\nthe same story on every page"}


def test_empty_table(spark):
    assert extract(rows_of(spark, site(1)).limit(0)).count() == 0


LONG_STORY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page", [
    "<div class='post-content no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>", "<section class=has-share>{}</section>",
    "<div id=page class=header-fixed>{}</div>", "<table class=menu-left><tr><td>{}</table>", "<div class='layout-sidebar'>{}</div><p>end</p>"])
def test_a_class_word_does_not_take_the_story(page):
    assert article(page.format(LONG_STORY)).startswith(LONG_STORY)


def test_compounds_of_noise_words_go():
    noise = "<div class='site-header'>Site</div><div class='comment-list'>{}</div><div class='sidebar-left'><p>more</p></div>".format(LONG_STORY * 3)
    assert article(noise + f"<div>{LONG_STORY}</div>") == LONG_STORY
    assert article(f"<div class='page-widget'>{LONG_STORY * 3}</div><article>{LONG_STORY}</article>") == LONG_STORY


def test_long_blocks_beside_the_article_stay():
    second = " ".join(f"tail{i}" for i in range(55))
    assert article(f"<article><p>{LONG_STORY}</p></article><div>{second}</div><p>short</p>") == f"{LONG_STORY}\n{second}"


def test_inline_elements():
    assert article("<article><p>a <math><mi>x</mi></math> b <button>Share</button><span hidden>no</span> c</p></article>") == "a x b c"


@pytest.mark.parametrize("page", ["<a " * 333_333, '<a "' * 250_000, '<a b="' * 160_000, "<div>x" * 50_000, "<form><input>y" * 50_000, "<!--" * 250_000,
                                  "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 50_000 + "<p>z</p>" * 50_000, "<script " * 100_000])
def test_hostile_markup_takes_linear_time(page):
    from time import process_time

    def seconds(text):
        start = process_time()
        article(text)
        return process_time() - start

    assert seconds(page) < 20 * max(seconds(page[:len(page) // 8]), 0.05)  # a square would be 64


def test_depth_beyond_the_tree(spark):
    deep = "<div>" * 5_000
    rows = [(i, "http://deep.example/", f"{deep}<p>the frame</p><p>story {i}</p>") for i in range(12)]
    got = {r.page_id: r.text for r in extract(rows_of(spark, rows)).collect()}
    assert got == {i: f"story {i}" for i in range(12)}


def brute_tree(pages):
    """Pages, content and presentation by path, counted page by page."""
    import math

    from flowwarden.llm.html_extract import CONTAINER, parse
    seen, kept = set(), []
    for page in pages:
        found = {}
        for text, n in parse(page)[1]:
            while n:
                if n.tag in CONTAINER:
                    found.setdefault(n.path, (" ".join(n.kids), set()))[1].add(text)
                n = n.up
        key = repr(sorted((p, k, sorted(t)) for p, (k, t) in found.items()))
        if key not in seen:
            seen.add(key)
            kept.append(found)
    out = {}
    for path in {p for f in kept for p in f}:
        here = [f[path] for f in kept if path in f]
        m = len(here)
        log = lambda x: math.log(x) / math.log(m) if m > 1 else 0.0
        texts = {t for _, ts in here for t in ts}
        styles = [sum(k == s for k, _ in here) / m for s in {k for k, _ in here}]
        content = 1 - sum(log(sum(t in ts for _, ts in here)) for t in texts) / len(texts)
        out[path] = (m, round(content, 9), round(-sum(q * log(q) for q in styles), 9))
    return out


def test_importances_equal_brute_force(spark):
    rows = site(16) + [(50 + i, "http://shop.example/", f"<div class=x1><p>Members</p>{'<p>more</p>' * (i % 3)}</div><div><ul><li>a<li>b{i % 4}</ul></div>") for i in range(12)]
    got = {r.path: (r.pages, round(r.content, 9), round(r.presentation, 9) + 0.0) for r in style_tree(rows_of(spark, rows).select("host", "html")).collect()}
    assert got == {p: (m, c, s + 0.0) for p, (m, c, s) in brute_tree([r[2] for r in rows]).items()}


def test_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = rows_of(spark, site(30))
    want = sorted(map(tuple, extract(rows).collect()))
    monkeypatch.setattr("flowwarden.llm.html_extract.BROADCAST_PATHS", 0)
    assert sorted(map(tuple, extract(rows).collect())) == want

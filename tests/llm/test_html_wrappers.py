import html
import random
import re
from collections import Counter

import pytest

from panelcast.llm import html_wrappers as wrap
from panelcast.llm.queries import op8_html_extraction


def host_text(pages):
    """Main texts of the pages of one host."""
    wrapper = None
    for p in pages:
        own = wrap.expression(wrap.tree(p))
        wrapper = own if wrapper is None else wrap.aligned(wrapper, own)
    wrap.judged(wrapper)
    return [wrap.main_text(p, wrapper) for p in pages], wrapper


def labels(items):
    return [x[0] + ("?" if x[1] else "") + ("+" if x[2] else "") for x in items]


def test_alignment_finds_optional_and_repeated_items():
    _, w = host_text(["<h1>a</h1><p>x</p><p>y</p>", "<h1>b</h1><table><tr><td>1</td></tr></table><p>z</p>", "<p>only</p>"])
    assert labels(w) == ["h1?", "table?", "p+"]
    _, w = host_text(["<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p>"])
    assert labels(w) == ["(h2 p)+"] and labels(w[0][4]) == ["h2", "p+"]


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu {n}</a></li><li>More</li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies {n}.</div><aside><p>Sidebar {n}</p></aside><div id="ad-12">Buy {n}!</div>
<article><header><h1>Title&amp;{n}</h1></header><p>First <b>bold</b>
 text&nbsp;{n}<br>line<p>Second &lt;{n}&gt;<ul><li>one<li>two</ul><form><input name=q>Search {n}</form>{extra}</article>
<section class="comments"><p>A reader says {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def test_only_the_article_is_left():
    pages = [PAGE.format(n=n, extra="<blockquote>quoted</blockquote>" if n % 2 else "") for n in range(5)]
    texts, _ = host_text(pages)
    for n, t in enumerate(texts):
        assert t.split("\n") == [f"Title&{n}", f"First bold text {n} line", f"Second <{n}>", "one", "two"] + (["quoted"] if n % 2 else [])


def test_template_texts_go_where_there_is_no_article():
    pages = [f"<div><p>Same line</p></div><div class=body><p>News {n}</p><p>More {n}</p></div>" for n in range(4)]
    assert host_text(pages)[0] == [f"News {n}\nMore {n}" for n in range(4)]
    assert host_text(pages[:1] * 4)[0] == ["Same line\nNews 0\nMore 0"] * 4  # copies say nothing about a template


def test_broken_pages():
    for page in ("", "text only", "<", "<p", "<<<>>>", "</div></p>x", "<article>cut off <p>here", "<!-- open", "<script>never closed", "<a title='x>y'>t</a>", "&#x41;&bogus;", "<" * 3000):
        host_text([page, page])
    assert host_text(["<article>cut off <p>here"])[0] == ["cut off\nhere"]
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"
    assert host_text([deep])[0] == ["deep\nafter"]
    assert host_text(["<a title='x>y'>t</a>"])[0] == ["t"]


def plain(page):
    """The article of the made pages, by their known marks."""
    body = re.search("<article>(.*?)</article>", page or "", re.S)
    if not body:
        return ""
    parts = re.split(r"</?(?:p|h1)>", body[1])
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in parts]
    return "\n".join(b for b in blocks if b)


def test_made_pages(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text) for r in op8_html_extraction(spark, sf).collect()}
    assert len(got) == len(want)
    assert [k for k in want if got[k] != want[k]] == []


def bare(page):
    """A page that says nothing by its main elements, classes, ids and roles."""
    page = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page or "")
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_made_pages_without_marks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = {r.page_id: plain(r.html) for r in rows}
    pages = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrap.extracted(pages).collect()}

    def alike(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return (a & b).total() / max(1, (a | b).total())

    assert all(alike(want[k], got[k]) >= 0.95 for k in want)
    assert all(alike(want[r.page_id], wrap.main_text(bare(r.html), [])) < 1 for r in rows)


def test_core_is_the_innermost_container_with_most_of_the_text():
    side = "<div><p>Teaser {0}</p></div>"
    pages = [f"<div>{side.format(n)}<section><div><h1>Title {n}</h1><p>A long text {n}</p><p>and more of it {n}</p></div></section></div>" for n in range(5)]
    assert host_text(pages)[0] == [f"Title {n}\nA long text {n}\nand more of it {n}" for n in range(5)]
    other = "<table><tr><td>Another layout</td></tr></table>"
    assert host_text([*pages, other])[0][5] == "Another layout"  # no text in the core: what is no template


def test_partial_wrappers_are_merged_in_rounds(spark, monkeypatch):
    rows = [(i, f"http://h{0 if i % 3 else i}.org/{i}", f"<div>Brand</div><div><p>News {i}</p><p>More {i}</p></div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    whole = wrap.extracted(pages).collect()
    monkeypatch.setattr(wrap, "FAN", 2)
    assert sorted(wrap.extracted(pages).collect()) == sorted(whole)
    assert {r.page_id: r.text for r in whole if r.page_id % 3} == {i: f"News {i}\nMore {i}" for i in range(60) if i % 3}


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_edge_rows(spark, sent, monkeypatch):
    monkeypatch.setattr(wrap, "SENT", sent)
    monkeypatch.setattr(wrap, "HELD", 2)
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randrange(6)}.org/{i}", PAGE.format(n=i, extra=""), "x") for i in range(40)]
    rows += [(100, None, PAGE.format(n=1, extra=""), "x"), (101, "http://h1.org/", None, "x"), (None, "no scheme", "", "x"), (3, rows[3][1], rows[3][2], "x")]
    rows += [(102, "http://long.org/", "<article>" + "<p>word " * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in wrap.extracted(pages).collect()}
    assert wrap.extracted(pages).count() == len(rows)
    assert got[7][1].startswith("Title&7\nFirst bold text 7 line") and got[100][1].startswith("Title&1")
    assert got[101][1:] == ("", 0) and got[None][1] == ""
    assert got[102][1] == "\n".join(["word"] * 30_000)
    assert all(len(t) == n for _, t, n in got.values())
    assert wrap.extracted(pages.limit(0)).count() == 0


def test_groups_of_groups_keep_their_texts():
    children = "<h2>h{0}</h2><p>p{0}</p><ul><li>u{0}</li></ul><p>q{0}</p><ul><li>v{0}</li></ul><table><tr><td>t{0}</td></tr></table>"
    texts, w = host_text([f"<article>{children.format(1)}{children.format(2)}</article>"])
    assert labels(w[0][4]) == ["(h2 (p ul) table)+"]
    assert texts == ["\n".join(f"{x}{n}" for n in (1, 2) for x in "hpuqvt")]
    part = "<h2>h{0}</h2><p>p{0}</p><figure>f{0}</figure><p>q{0}</p><figure>g{0}</figure>"
    pages = [part.format(1) + part.format(2), part.format(3) + "<blockquote>b</blockquote>" + part.format(4)]
    texts, _ = host_text([f"<article>{x}</article>" for x in pages])
    assert texts[0] == "\n".join(f"{x}{n}" for n in (1, 2) for x in "hpfqg")
    assert texts[1] == "\n".join([*(f"{x}3" for x in "hpfqg"), "b", *(f"{x}4" for x in "hpfqg")])


def test_what_the_wrapper_does_not_know_is_read_by_the_plain_rules():
    wrapper = wrap.judged(wrap.expression(wrap.tree("<article><p>known</p></article>")))
    page = "<div>outside</div><article><header>title</header><p>a</p><section><dl><dt>b</dt></dl><nav>no</nav></section>c</article>"
    assert wrap.main_text(page, wrapper) == "title\na\nb\nc"


def test_pages_with_and_without_an_article_on_one_host():
    old = [f"<nav>menu</nav><div class=content><p>Old {n}</p></div><div class=about><p>Same line</p></div>" for n in range(4)]
    new = [f"<nav>menu</nav><div class=top>Brand</div><article><p>New {n}</p></article>" for n in range(4)]
    want = [f"Old {n}" for n in range(4)] + [f"New {n}" for n in range(4)]
    assert host_text(old + new)[0] == want
    assert host_text(new + old)[0] == want[4:] + want[:4]
    assert host_text(["<article></article><div>left</div>", "<article>right</article><div>beside</div>"])[0] == ["left", "right"]


def test_pages_without_a_host(spark):
    rows = [(1, None, "<article>one</article>"), (2, None, "<div><p>two</p></div>"), (3, "no scheme", "<p>three</p>")]
    got = wrap.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {1: "one", 2: "two", 3: "three"}


@pytest.mark.parametrize("around", ["<div class='has-sidebar'>{}</div>", "<div class=no-sidebar><div id=with-nav>{}</div></div>", "<form action=x>{}</form>", "<header>{}</header>"])
def test_hints_around_the_article(around):
    inside = "<article><p>News {0}</p><div class=share>Share</div></article><div class=sidebar><article>Teaser {0}</article></div>"
    pages = [f"<div>Brand</div>{around.format(inside.format(n))}<footer>end</footer>" for n in range(4)]
    assert host_text(pages)[0] == [f"News {n}" for n in range(4)]
    mixed = [inside.format(9), pages[0]]
    assert host_text(mixed)[0] == ["News 9", "News 0"]
    assert host_text(mixed[::-1])[0] == ["News 0", "News 9"]


def test_articles_in_skipped_elements_are_no_main_text_beside_a_longer_one():
    teasers = "<div class=related><article>One</article><article>Two</article></div><aside><article>Three</article></aside>"
    assert host_text([f"<div><p>A text that is longer than its teasers</p></div>{teasers}"])[0] == ["A text that is longer than its teasers"]
    assert host_text([f"<article>Text</article>{teasers}"])[0] == ["Text"]
    wrap.tree("<form class=nav>" * 5000 + "<article>deep")


def test_hints_among_many_words():
    for words in ("block col flex grid hidden margin sidebar", "a b c d e f g notice z"):
        assert host_text([f"<article><p>Text</p><div class='{words}'>Aside</div></article>"])[0] == ["Text"]
        assert host_text([f"<p>Text {n}</p><div class='{words}'>Aside {n}</div>" for n in range(2)])[0] == ["Text 0", "Text 1"]
    same = "<article><div class='block col flex grid hidden margin {}'>x</div><div class='block col flex grid hidden margin {}'>y</div></article>"
    assert host_text([same.format("sidebar", "wide"), same.format("wide", "sidebar")])[0] == ["y", "x"]

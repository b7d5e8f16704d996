from __future__ import annotations

import time

import pytest

from corpuscle.llm import extraction as X

N = X.named

SHELL = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<header class="site"><a href="/">Site</a></header><nav><ul>{links}</ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div class="ad">Buy {n}</div><main><article><h1>Title &amp; {n}</h1>{body}<form><input name=a><button>Send</button></form></article>
<aside>Side {n}</aside><section id="comments"><p>Nice {n}</p></section></main><footer>&copy; {n}</footer>{end}"""


def page(n, body, links=3, end="</body></html>"):
    return SHELL.format(n=n, body=body, links="".join(f"<li><a href='/{i}'>L{i}</a></li>" for i in range(links)), end=end)


def rows(spark, pages):
    return {r["page_id"]: r for r in X.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_article_of_a_template(spark):
    pages = [(i, f"http://h.example/{i}", page(i, f"<p>First\n {i} <b>bold</b>&nbsp;x<p>Second &lt;{i}&gt;<br>line", links=i % 4, end="" if i % 3 else "</body></html>")) for i in range(12)]
    got = rows(spark, pages)
    for i in range(12):
        assert got[i]["text"] == f"Title & {i}\n\nFirst {i} bold x\n\nSecond <{i}> line"
        assert got[i]["n_chars"] == len(got[i]["text"])
        assert got[i]["url"] == f"http://h.example/{i}"


def test_template_classes(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i, "<p>a</p>" * (i + 1))) for i in range(8)], "page_id long, url string, html string")
    seen = X.occurrences(pages.select("page_id", X.host_of(pages["url"]).alias("host"), "html"))
    found = X.templates(seen).collect()
    assert len(found) == 1
    root, slots = found[0]["classes"][0]["tokens"], {s["element"]: s["wanted"] for s in found[0]["slots"]}
    assert root.index(N("/html")) < root.index(N("/html/body/main/article")) < root.index(N("/html/body/footer")) < root.index("/" + N("/html/body/footer"))
    assert slots[N("/html/body/main/article")] and slots[N("/html/body/main/article/h1")]
    assert not any(slots[N(e)] for e in ("/html/body/nav/ul", "/html/body/footer", "/html/body/main/aside", "/html/body"))


def test_classes_nest():
    """A record with two fields on every other page, in the gap between the list's begin and end."""
    seen, n = {}, 10
    for i in range(n):
        page = X.Page(f"<html><body><p>{i}</p><div class='rr'>" + ("<div class='aa'><h2>x</h2><h3>y</h3></div>" * (2 if i % 2 else 1) if i else "") + "</div><div class='tt'>t</div></body></html>")
        for t, c in page.tokens.items():
            s = seen.setdefault(t, {"token": t, "text": None, "pages": 0, "total": 0, "high": 0, "low": 0, "place": 0.0, "chars": 0, "links": 0, "hard": False, "main": False, "parent": page.parent.get(t), "kind": page.kind.get(t)})
            s["pages"] += 1
            s["total"] += c
            s["high"] += X._hash(i, c) >> 32
            s["place"] += page.first[t] / len(page.first)
    for s in seen.values():
        s["place"] /= s["pages"]
    classes, _, _ = X.deduce([s for s in seen.values() if s["pages"] >= 0.8 * n], n)
    root, inner = classes[0], classes[1]
    assert root["parent"] == -1 and N("/html/body/div.rr") in root["tokens"] and N("/html/body/div.rr/div.aa") not in root["tokens"]
    assert inner["tokens"][:3] == [N("/html/body/div.rr/div.aa"), N("/html/body/div.rr/div.aa/h2"), "/" + N("/html/body/div.rr/div.aa/h2")]
    assert inner["parent"] == 0 and root["tokens"][inner["gap"]] == N("/html/body/div.rr")


MEANINGLESS = """<html><body><div class='q1'><ul>{links}</ul></div><div class='q2'>Today: {words}</div>
<div class='q3'><h1>Title {i}</h1>{body}<div class='q7'><ul>{more}</ul></div></div>
<div class='q4'><span>Made</span> by us, {i} {words}</div></body></html>"""


def meaningless(i):
    links = lambda n: "".join(f"<li><a href='/{k}'>Link {k * i} to {k}</a></li>" for k in range(1, n + 2))
    body = "".join(f"<p>Paragraph {k} of page {i} is a piece of running text with <a href='x'>a link</a> and more.</p>" for k in range(3 + i % 4))
    want = [f"Title {i}"] + [f"Paragraph {k} of page {i} is a piece of running text with a link and more." for k in range(3 + i % 4)]
    return MEANINGLESS.format(i=i, links=links(4), more=links(i % 3), body=body, words=f"word{i} thing{i * 7}"), "\n\n".join(want)


@pytest.mark.parametrize("copies", [1, 2])
def test_slots_are_chosen_by_what_varies(spark, copies):
    """Class names say nothing, and menus, notices and footers differ from page to page: names alone fail."""
    pages = [(i, f"http://h.example/{i}", meaningless(i)[0]) for i in range(1, 11) for _ in range(copies)]
    got = rows(spark, pages)
    assert {i: r["text"] for i, r in got.items()} == {i: meaningless(i)[1] for i in range(1, 11)}
    assert all("\n\n".join(X.main_blocks(X.Page(meaningless(i)[0]))) != meaningless(i)[1] for i in range(1, 11))


def test_repeated_rows_do_not_cancel(spark):
    """Tokens on different pages are in different classes, also where every page is there twice."""
    html = "<html><body><p>a{i}</p>{x}</body></html>"
    pages = [(i, "http://h.example", html.format(i=i, x="<pre>x</pre>" if i % 2 else "<blockquote>y</blockquote>")) for i in range(10)] * 2
    seen = X.occurrences(spark.createDataFrame(pages, "page_id long, host string, html string"))
    got = {r["token"]: (r["high"], r["low"], r["pages"], r["total"]) for r in seen.filter("text IS NULL").collect()}
    assert got[N("/html/body/pre")] == got["/" + N("/html/body/pre")] != got[N("/html/body/blockquote")]
    assert got[N("/html/body")][2] == 20 and got[N("/html/body/pre")][2] == 10


@pytest.mark.parametrize("n", [1, 2, 4, 5, 50])
def test_articles_keep_what_they_repeat(spark, n):
    """A heading and a paragraph that every article of the host holds; also where all pages are copies."""
    own = lambda i: [f"Own text {i} is longer than the rest", "Conclusion", "Read our terms"]
    html = lambda i: page(i, f"<p>{own(i)[0]}</p><h2>Conclusion</h2><p>Read our terms</p>")
    got = rows(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(n)])
    assert {i: r["text"] for i, r in got.items()} == {i: "\n\n".join([f"Title & {i}", *own(i)]) for i in range(n)}
    same = rows(spark, [(i, f"http://h.example/{i}", html(0)) for i in range(n)])
    assert all(r["text"] == got[0]["text"] for r in same.values())


@pytest.mark.parametrize("n", [2, 4, 5, 50])
def test_containers_keep_repeated_headings(spark, n):
    html = "<html><body><div class='xq'><div>Home</div><div>All our goods</div></div><div class='zz'><h1>Title {i}</h1><p>Own text {i}</p><h2>Conclusion</h2><p>At last {i}</p><div>Share this</div></div><div class='yk'>Made by us</div></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html.format(i=i)) for i in range(n)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Title {i}\n\nOwn text {i}\n\nConclusion\n\nAt last {i}" for i in range(n)}


WRAPPERS = ["layout has-sidebar", "content no-sidebar", "site with-menu", "page hasSidebar", "sidebar", "main-menu widget", "notice", "post social-history", "col-2 one-sidebar"]


@pytest.mark.parametrize("n", [1, 6])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_articles_survive_their_wrappers(spark, wrapper, n):
    html = lambda i: f"<html><body><nav>Home</nav><div class='{wrapper}'><article><h1>Title {i}</h1><div class='ad-hoc'>An ad-hoc group {i}</div><p id='social-history'>Social history {i}</p><div class='notice-board'>Pinned {i}</div><div class='ad-slot'>Buy {i}</div></article><div class='site-footer'>Foot {i}</div><div class='comments'><article class='comment'>Nice one {i}</article></div></div></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(n)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Title {i}\n\nAn ad-hoc group {i}\n\nSocial history {i}\n\nPinned {i}" for i in range(n)}


@pytest.mark.parametrize("wrapper", ["sidebar", "menu", "widget notice"])
def test_vectors_decide_against_names(spark, wrapper):
    """No article element, and a container that is named like a side: what varies tells."""
    html = lambda i: f"<html><body><div class='q1'>Our shop</div><div class='{wrapper}'><h1>Title {i}</h1><p>Much running text of page {i}, and more of it {i * 7}</p><div class='sidebar'>Side {i}</div></div><div class='q4'>Made by us</div></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(6)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Title {i}\n\nMuch running text of page {i}, and more of it {i * 7}" for i in range(6)}


def test_teasers_are_no_articles():
    html = "<main><article><p>Text of the page</p></article></main><div class='sidebar'><article><p>A teaser that is longer than the text of the page</p></article></div>"
    assert X.main_blocks(X.Page(html)) == ["Text of the page"]


@pytest.mark.parametrize(("name", "side"), [("sidebar", "side"), ("site-footer", "side"), ("sidebar-left", "side"), ("adSlot", "side"), ("cookie_banner", "side"), ("comments-area", "comment"), ("comment", "comment"), ("has-sidebar", ""), ("no-sidebar", ""), ("ad-hoc", ""), ("social-history", ""), ("notice-board", ""), ("shared-bread", ""), ("adhesive", ""), ("menuisier", ""), ("", ""), ("42", "")])
def test_side_names(name, side):
    assert X.side_name(name) == side


@pytest.mark.parametrize(
    "html",
    ["<div>x" * 20_000, "<x " * 40_000 + ">", "<" * 40_000, "<ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, "<p>" + "<x-y>" * 20_000 + "<div>" * 20_000, "</b></i></q-r>" * 20_000 + "<div>" * 20_000 + "</q-r>" * 20_000, "<!" * 20_000, "<a href='" * 20_000, "<div class='a'>" * 20_000 + "</div>" * 20_000],
)
def test_broken_pages_take_time_by_their_length(html):
    began = time.process_time()
    tags = X.Page(html)
    X.main_blocks(tags)
    assert time.process_time() - began < 4


def test_deep_pages_have_a_template(spark):
    html = lambda i: "<html><body>" + "<div>" * 6000 + f"<p>Deep {i}</p>" + "</div>" * 6000 + "<div>Made by us</div></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(4)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Deep {i}" for i in range(4)}


@pytest.mark.parametrize("n", [5, 6, 12])
def test_template_text_without_telling_names(spark, n):
    html = "<html><body><div class='xq'><div>Home</div><div>All our goods</div></div><div class='zz'><h1>Title {i}</h1><p>Own text {i}</p></div><div class='yk'>Made by us</div></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html.format(i=i)) for i in range(n)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Title {i}\n\nOwn text {i}" for i in range(n)}


def test_template_text_on_nearly_all_pages(spark):
    html = "<html><body>{notice}<p>Own text {i}</p></body></html>"
    got = rows(spark, [(i, f"http://h.example/{i}", html.format(i=i, notice="<div class='xq'>We are closed</div>" if i else "")) for i in range(10)])
    assert {i: r["text"] for i, r in got.items()} == {i: f"Own text {i}" for i in range(10)}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a <span>b</span> c</div><div>d</div>", "a b c\n\nd"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\n\nx"),
        ("<p>x</p><div class='sidebar left'><p>y</p></div>", "x"),
        ("<article><p>a < b & c</p></article>", "a < b & c"),
        ("<article><p title='x>y'>a</p><!-- <p>no</p> --><p>b</p></article><p>out", "a\n\nb"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><script>if (a</b/.test(x)) {}</script><p>a</p><style>x", "a"),
        ("<div class='shared-bread'>kept</div>", "kept"),
        ("<article><p>a &lt; <b", "a <"),
        ("<article><p>a</p><p class='x", "a"),
        ("<article><p>a < b", "a < b"),
    ],
)
def test_single_pages(html, want):
    assert "\n\n".join(X.main_blocks(X.Page(html))) == want


def test_very_long_page():
    html = "<article>" + "".join(f"<p>word {i}</p>" for i in range(50_000))
    assert len(X.main_blocks(X.Page(html))) == 50_000

"""Main text of pages: tree matching against trying every mapping, and hosts of several makes whose articles are known."""

from __future__ import annotations

import html
import random
import re

import pytest
from brieflake.llm import dom
from brieflake.llm import page_text as P

from .conftest import prose


def best_mapping(a: dom.Shape, b: dom.Shape) -> int:
    """The largest ordered mapping of children on children of one kind, by trying all."""
    ca, cb = dom._children(a), dom._children(b)

    def lay(xs, ys):
        if not xs or not ys:
            return 0
        here = lay(xs[1:], ys)
        for q, y in enumerate(ys):
            if a.kinds[xs[0]] == b.kinds[y]:
                here = max(here, size(xs[0], y) + lay(xs[1:], ys[q + 1 :]))
        return here

    def size(i, j):
        return 1 + lay(ca[i], cb[j])

    return size(0, 0)


def random_shape(r: random.Random, n: int) -> dom.Shape:
    parents = [-1] + [r.randrange(max(0, i - 4), i) for i in range(1, n)]
    return dom.Shape(tuple("#" if i == 0 else r.choice("ab") for i in range(n)), tuple(parents), (False,) * n)


@pytest.mark.parametrize("seed", range(30))
def test_tree_matching(seed):
    r = random.Random(seed)
    a, b = random_shape(r, r.randint(1, 9)), random_shape(r, r.randint(1, 9))
    n, at = dom.matched(a, b)
    assert n == best_mapping(a, b) == sum(x >= 0 for x in at)
    for i, j in enumerate(at):
        if i and j >= 0:
            assert a.kinds[i] == b.kinds[j] and at[a.parents[i]] == b.parents[j]


def test_large_trees_meet_by_kind(monkeypatch):
    monkeypatch.setattr(dom, "PAIRS", 10)
    s = random_shape(random.Random(3), 60)
    n, at = dom.matched(s, s)
    assert n == 60 and all(s.kinds[i] == s.kinds[j] for i, j in enumerate(at))


def texts(page: str) -> list[str]:
    return [b.text for b in dom.parsed(page)[1]]


def test_parsing():
    assert texts("<p>a&amp;b &lt;i&gt; &#233;&nbsp;c<p>d<br>e <b>f</b>g<div>h</div>i") == ["a&b <i> é c", "d e fg", "h", "i"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>") == ["a b", "c"]
    assert texts("x<!-- y <p>z</p> -->w<script>if (a<b) '</p>'</script>v<style>q") == ["xwv"]
    assert texts("<p title='a>b'>c</p>1 < 2 <p unclosed") == ["c", "1 < 2"]
    assert texts("<p a=\"x>y</p><p>z") == ["y", "z"]
    assert texts("") == [] and texts("&am &copy; <!-- open <p>x") == ["&am ©"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>"
    assert texts(deep) == ["x", "y"] and len(dom.folded(dom.parsed(deep)[0]).kinds) <= dom.DEEPEST + 2
    assert len(texts("<p>w</p>" * 20_000)) == 20_000


def article(r: random.Random, n: int = 6) -> list[str]:
    return [prose(r.randrange(1 << 30), r.randint(25, 70)) for _ in range(n)]


def _esc(xs):
    return [html.escape(x) for x in xs]


def named_page(r, body):
    """A page whose elements' names tell what they are."""
    said = "".join(f"<p>{x}</p>" for x in _esc(body[1:]))
    links = "".join(f'<li><a href="/{i}">{prose(r.randrange(99), 2)}</a></li>' for i in range(8))
    return f"""<html><head><title>{body[0]}</title></head><body><header><h1>The Daily Made-up</h1></header><div class="cookie-notice">We use cookies {r.random()}</div><nav><ul>{links}</ul></nav>
      <main><article><h1>{html.escape(body[0])}</h1>{said}<div class="adBox">{prose(r.randrange(1 << 30), 40)}</div></article><section id="comments"><h2>Comments</h2><p>{prose(r.randrange(1 << 30), 300)}</p></section></main>
      <aside>{prose(r.randrange(1 << 30), 60)}</aside><form><p>Sign up here</p><input></form><footer>&copy; 2024</footer></body></html>"""


def plain_page(r, body, pool):
    """A page without telling names: what is no article is the same everywhere or dealt from a pool."""
    said = "".join(f"<p>{x}</p>" for x in _esc(body[1:]))
    extra = "<div><p>Breaking: stay tuned</p></div>" if r.random() < 0.4 else ""
    return f"<html><body><div><p>Welcome to the site of many words and more words still</p></div>{extra}<div><p>{r.choice(pool)}</p></div><div><h1>{html.escape(body[0])}</h1>{said}<p>Share this with all your friends</p></div><div><p>All rights kept by us</p></div></body></html>"


@pytest.fixture(scope="module")
def hosts(spark):
    r = random.Random(7)
    pool = [prose(900 + i, 50) for i in range(3)]
    rows, want = [], {}

    def add(url, page, body):
        rows.append((len(rows), url, page, 1, "t"))
        want[len(rows) - 1] = "\n".join(" ".join(x.split()) for x in body)

    for i in range(20):
        body = article(r)
        add(f"https://named.example/{i}", named_page(r, body), body)
    for i in range(60):
        body = article(r)
        add(f"http://plain.example:80/{i}?x", plain_page(r, body, pool), body)
    body = article(r)
    for i in range(30):  # copies make no template
        add(f"http://copies.example/{i}", named_page(r, body), body)
    body = article(r)
    add("http://alone.example/", named_page(r, body), body)
    add(None, named_page(r, body), body)
    add("no url", f"<div>{body[0]}</div>", body[:1])
    for page in (None, "", "<nav>only a menu</nav>", "<script>x"):
        add("http://odd.example/", page, [])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slot int, text string").repartition(5)
    return df, want


def test_known_articles(hosts):
    df, want = hosts
    got = {r.page_id: r for r in P.main_text(df).collect()}
    assert len(got) == len(want) == df.count()
    assert [i for i in want if got[i].text != want[i]] == []
    assert all(got[i].n_chars == len(got[i].text) for i in want)


def test_shuffled_when_templates_are_large(hosts, monkeypatch):
    df, _ = hosts
    once = sorted(map(tuple, P.main_text(df).collect()), key=repr)
    monkeypatch.setattr(P, "SMALL", 0)
    assert sorted(map(tuple, P.main_text(df).collect()), key=repr) == once


def test_pages_of_the_driver(spark, sf):
    got = {r.page_id: r.text for r in P.op12_page_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"<br>", " ", b) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())))


def test_no_pages(spark):
    assert P.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

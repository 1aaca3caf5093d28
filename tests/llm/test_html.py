"""Text extraction: pages of known text, the alignment against a table of all prefixes, differencing within hosts."""

import random

import pytest

from tidegauge.llm import html

PAGES = [
    ("<article><h1>A &amp; B</h1><p>one\n  two</p></article>", "A & B\n\none two"),
    ("<nav><a>menu</a></nav><main><p>x<br>y</p><aside>ad</aside><p>z</p></main><footer>f</footer>", "x y\n\nz"),
    ("<article><header><h1>t</h1></header><p>a <script>if (a < b) {}</script>b</p><div class='comments'><p>c</p></div></article>", "t\n\na b"),
    ("<div id='cookie-banner'>ok?</div><article><ul><li>1<li>2</ul><p>&#233;&eacute;&#x4e2d;</article>", "1\n\n2\n\néé中"),
    ("<article><p>cut <b>off", "cut off"),
    ("<article><!-- <p>gone</p> --><p>kept</p><form><input value='v'><button>send</button></form></article>", "kept"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
]


def test_known_pages(spark):
    rows = [(i, f"https://h{i}.example/p", page) for i, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.id: r.text for r in html.extract(pages).collect()}
    want = {i: text for i, (_, text) in enumerate(PAGES)}
    assert got == want
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    draw = random.Random(seed)
    a, b = ([draw.choice("abcdef") for _ in range(draw.randrange(25))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = html.shared(a, b)
    assert found == sorted(set(found)) and len(found) == best[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in found)  # a subsequence of the other


def test_differencing(spark):
    frame = "<div>Home News Contact</div>{}<div>All rights reserved by the site</div>"
    own = [f"<p>{' '.join(f'w{i}x{k}' for k in range(30))}</p>" for i in range(6)]
    rows = [(i, f"https://one.example/news/{i}", frame.format(t)) for i, t in enumerate(own)] + [(9, None, "<p>a null url</p>"), (10, "https://two.example/", "<p>alone</p>"), (0, "https://one.example/news/0", frame.format(own[0]))]
    got = sorted((r.id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(i, t[3:-4]) for i, t in enumerate(own)] + [(9, "a null url"), (10, "alone"), (0, own[0][3:-4])]
    assert got == sorted(want)


def test_differencing_of_marked_articles(spark):
    """Lines that every article of a site repeats go; quoted ones and copies stay, and so does text that outweighs its article."""
    body = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(8)]
    lines = [[b, "Read more on our site", *(["quoted by two"] if i in (2, 3) else [])] for i, b in enumerate(body)]
    page = "<main>{}</main>".format
    rows = [(i, f"https://one.example/news/{i}", page("".join(f"<p>{t}</p>" for t in x))) for i, x in enumerate(lines)] + [(20, "https://one.example/news/0", page(f"<p>{body[0]}</p><p>Read more on our site</p>"))]
    rows += [(30, "https://two.example/a", f"<article><p>teaser</p></article><div>{body[0]}</div>"), (31, "https://three.example/a", f"<div>menu</div><article><p>{body[1]}</p></article>")]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "\n\n".join(t for t in x if t != "Read more on our site") for i, x in enumerate(lines)} | {20: body[0], 30: f"teaser\n\n{body[0]}", 31: body[1]}
    assert got == want


def test_cut_hosts(spark, monkeypatch):
    """A host of many groups gives the texts of an uncut one: each section's own notice goes, wherever the host is cut."""
    body = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(300)]
    rows = [(i, f"https://one.example/s{i // 3:03d}/{i}", f"<div>notice of section {i // 3}</div><p>{b}</p>") for i, b in enumerate(body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(html, "GROUP", 20)
    monkeypatch.setattr(html, "SAMPLE", 5, raising=False)
    got = {r.id: r.text for r in html.extract(pages).collect()}
    assert got == dict(enumerate(body))


def test_short_articles_and_many_copies(spark):
    """Menus longer than the article go, also between rows of one URL and copies side by side; edited copies keep their text."""
    menu = " ".join(f"menu{k}" for k in range(40))
    page = f"<div>{menu}</div>{{}}<div>All rights reserved</div>".format
    short = [(i, f"https://short.example/n/{i}", page(f"<p>s{i} few words</p>")) for i in range(5)]
    long = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(4)]
    many = [(100 + i, "https://many.example/n/0", page(f"<p>{long[0]}</p>")) for i in range(7)] + [(110, "https://many.example/n/9", page(f"<p>{long[1]}</p>"))]
    part = [" ".join(f"p{i}x{k}" for k in range(40)) for i in range(9)]
    edited = [[f"edit {i}" if k == i else p for k, p in enumerate(part)] for i in range(9)]
    copies = [(200 + i, f"https://copies.example/n/{i}", page("".join(f"<p>{t}</p>" for t in x))) for i, x in enumerate(edited)] + [(210, "https://copies.example/z", page(f"<p>{long[2]} {long[3]}</p>"))]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(short + many + copies, "page_id long, url string, html string")).collect()}
    want = {i: f"s{i} few words" for i in range(5)} | {100 + i: long[0] for i in range(7)} | {110: long[1]}
    want |= {200 + i: "\n\n".join(x) for i, x in enumerate(edited)} | {210: f"{long[2]} {long[3]}"}
    assert got == want

import random
import re
import time

import numpy as np
import pytest

from tarnflow.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="nav-open"><header class="site">Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <article>ad</article> -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><aside>Side</aside><article class="post"><header><h1>The <i>head</i>ing &amp; more</h1><span>By me</span></header>
<p><b>First  par.<br><p>Second&nbsp;p&eacute;r a < b &lt;ok&gt;</p><ul><li>one<li>two</ul><script>x()</script><form><input>Mail</form><img alt="a>b" src=x>
<div class='share-buttons'>Share</div><p title="a > b">Last</p><div class="comments"><p>I disagree</p></div></article><footer>&copy; foot</footer>"""


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (PAGE, (True, "The heading & more First par. Second pér a < b <ok> one two Last")),
        ("", (False, "")),
        ("plain  text &amp; no tags", (False, "plain text & no tags")),
        ("<body><div id=content>Kept <b>bo</b>ld</div><div class=sidebar>no</div>", (False, "Kept bold")),
        ("<main><p>a<nav>n</main>after", (True, "a")),
        ("<nav>menu<article>card</article></nav><p>body", (False, "body")),
        ("<article>x<script>never closed <p>y", (True, "x")),
        ("<article><p>open", (True, "open")),
        ("<ARTICLE><P>Up</P></ARTICLE>", (True, "Up")),
        ("<article><p class=\"x>y</p> z</article>", (True, "y z")),
    ],
)
def test_markup(page, expected):
    assert html.extract(page) == expected


def test_long_broken_pages_take_linear_time():
    began = time.time()
    for page in ("<p " + "a='" * 200000, "<" * 300000, "<p>" * 100000, "<div class=ad>" * 2000 + "x" + "</p>" * 2000, "<!--" * 100000):
        html.extract(page)
    assert time.time() - began < 8


def test_repeated_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        common = [[rng.choice("abcdef") for _ in range(rng.randint(3, 9))] for _ in range(2)]
        streams = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14))] + rng.choice(common) * rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
        for sides in (False, True):
            apart = np.array([k % 2 if sides else -1 for k in range(len(streams))])
            got = html.repeated(streams, apart, 4)
            at = {}
            for k, s in enumerate(streams):
                for i in range(len(s) - 3):
                    at.setdefault(tuple(s[i : i + 4]), set()).add(k % 2 if sides else k)
            for s, hit in zip(streams, got, strict=True):
                assert hit.tolist() == sorted({i + d for i in range(len(s) - 3) if len(at[tuple(s[i : i + 4])]) > 1 for d in range(4)})


@pytest.mark.parametrize("chunk", [256, 2])
def test_pages_without_marks_lose_what_their_host_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(html, "CHUNK", chunk)
    chrome = " ".join(f"menu{i}" for i in range(15))
    own = {k: " ".join(f"own{k}x{i}" for i in range(30)) for k in range(5)}
    pages = [(k, "https://A.example/p", f"<div>{chrome}</div><div>{own[k]}</div>", "x") for k in range(5)]
    copy = " ".join(f"copy{i}" for i in range(20))
    pages += [(5, "http://b.example/1", f"<p>{copy}", "x"), (6, "http://b.example/2", f"<p>{copy}", "x"), (6, "http://b.example/2", f"<p>{copy}", "x")]
    pages += [(7, None, None, "x"), (8, "nohost", "", "x"), (9, "http://a.example/", f"<article>{chrome}</article>", "x"), (10, "http://c.example", f"<div>{chrome}", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = html.main_text(df).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert got == own | {5: copy, 6: copy, 7: "", 8: "", 9: chrome, 10: chrome}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html.main_text(df.limit(0)).count() == 0


def test_query_on_the_pages(spark):
    import html as entities

    import duckdb

    from tarnflow.llm.queries import op2_html_text

    folder = "/root/testdata/sf0.01"
    rows = {r.page_id: r.text for r in op2_html_text(spark, folder).collect()}
    pages = duckdb.sql(f"select page_id, html from '{folder}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, page in pages:  # all pages of the table have one article
        body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        assert rows[page_id] == " ".join(entities.unescape(re.sub(r"</?(p|h1|br|ul|li)\b[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


@pytest.mark.parametrize("chunk", [256, 4])
def test_articles_lose_the_notice_that_their_host_puts_in_them(spark, monkeypatch, chunk):
    monkeypatch.setattr(html, "CHUNK", chunk)
    notice = " ".join(f"notice{i}" for i in range(14))
    shared = " ".join(f"shared{i}" for i in range(20))
    own = {k: " ".join(f"own{k}x{i}" for i in range(30)) for k in range(40)}
    rows, want = [], {}

    def page(host, text, expected):
        want[len(rows)] = expected
        rows.append((len(rows), f"https://{host}/p", f"<nav>menu</nav><article>{text}</article>"))

    for k in range(12):  # a template on 11 of 12 articles, a passage on 8 of them
        passage = f" {shared}" if k < 8 else ""
        page("a.example", f"<p>{own[k]}</p>" + (f"<p>{notice}</p>" if k else "") + f"<p>end{k}{passage}</p>", f"{own[k]} end{k}{passage}")
    page("a.example", notice, notice)  # nothing else: it stays
    for _ in range(20):  # copies are one text
        page("b.example", own[20], own[20])
    for k in range(7):  # too few texts
        page("c.example", f"{own[k]} {notice}", f"{own[k]} {notice}")
    for k in range(12):  # on 9 of 12, which isn't more than three quarters
        page("d.example", own[k] + (f" {notice}" if k < 9 else ""), own[k] + (f" {notice}" if k < 9 else ""))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.main_text(df).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)

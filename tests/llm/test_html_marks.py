import pytest

from tarnflow.llm import html


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<div class='layout with-sidebar'>menu<article>body<div class=share>no</div> text</article>after</div>", (True, "body text")),
        ("<form>field<main>body</main></form>", (True, "body")),
        ("<div class=sidebar><main>a<article>b</article></main>c</div><p>d", (True, "a b")),
        ("<div class=comments><article>comment</article></div><p>body", (False, "body")),
        ("<article>x<div class=related><article>card</article></div>y</article>", (True, "x y")),
    ],
)
def test_names_around_content_do_not_hide_it(page, expected):
    assert html.extract(page) == expected


def test_pages_that_mark_nothing_lose_what_their_host_repeats_whatever_tags_they_name(spark):
    chrome = " ".join(f"menu{i}" for i in range(15))
    own = [" ".join(f"own{k}x{i}" for i in range(20)) for k in range(4)]
    odd = ["", "<!-- <article> -->", "<script>'<main>'</script>", "<nav><article>card</article></nav>"]
    rows = [(k, "http://a.example/p", f"{odd[k]}<div>{chrome}</div><div>{own[k]}</div>") for k in range(4)] + [(4, "http://a.example/q", "<nav><article>card</article></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == dict(enumerate([*own, ""]))

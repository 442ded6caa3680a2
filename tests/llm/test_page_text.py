import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qanat.llm import page_text as P
from qanat.llm import queries

PAGE = (
    '<!DOCTYPE html><html><head><title>Menu</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    "<header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- ad <p>x</p> --><div class=\"ad box\"><div>Buy</div> now</div>"
    "<article><h1>Title &amp; more</h1><p>One <b>two</b>three\n  four<br>five<p>Six &lt;seven&gt; &copy;<aside>Side</aside></p>"
    "<form><input>Mail</form><section id=comments><p>Nice!</section><p>Shared line.</p></article><footer>&copy; foot</body></html>"
)
WANT = "Title & more One twothree four five Six <seven> © Shared line."


def text(page, other=None):
    return P.main_text(P.blocks(page), P.blocks(other) if other else None)


def test_article_without_furniture():
    assert text(PAGE) == WANT
    assert text(PAGE, PAGE) == WANT  # shared lines inside a marked article are restored


def test_differencing_deletes_shared_lines_where_no_article_is_marked():
    page = "<body><div>Top bar</div><p>{}</p><div>Imprint</div><p>{}</p><div>End</div></body>"
    a, b = page.format("Own one", "Own two"), page.format("Other", "Another")
    assert text(a, b) == "Own one Own two"
    assert text(a) == "Top bar Own one Imprint Own two End"
    assert text(a, a) == text(a)  # an exact copy keeps its lines


def test_unclosed_elements():
    assert text("<nav><a>x</a><article><p>body<p>more") == "body more"
    assert text("<article><p class=ad>buy<p>real</article>") == "real"
    assert text("<article>a < b and <3 <b") .startswith("a < b and <3")
    assert text("") == "" and text("just words\n here") == "just words here" and text("<script>x") == ""


@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    found = sorted(P.shared_lines(a, b))
    assert len(found) == table[-1][-1]
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in found)


SCHEMA = "page_id long, url string, html string, text string"


def test_edges_of_the_input(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (3, "http://h/a/1", PAGE, "x"), (3, "http://h/a/1", PAGE, "x"), (None, "http://h/a/2", PAGE, None), (2**60, "http://h/b", "<p>" + "w " * 50_000 + "</p>", None)]
    found = P.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.page_id, r.url) for r in found), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    by = {r.page_id: r.text for r in found}
    assert by[1] == by[2] == "" and by[3] == by[None] == WANT and by[2**60] == ("w " * 50_000).strip()
    assert P.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partners_are_nearest_by_path_and_same_host(spark):
    page = "<body><div>{}</div><p>own {}</p></body>"
    rows = [(1, "http://h/a/1", page.format("bar a", 1)), (2, "http://h/a/2", page.format("bar a", 2)), (3, "http://h/b/1", page.format("bar b", 3)), (4, "http://h/b/2", page.format("bar b", 4)), (5, "http://i/b/2", page.format("bar b", 5))]
    found = P.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts=1).collect()
    assert {r.page_id: r.text for r in found} == {1: "own 1", 2: "own 2", 3: "own 3", 4: "own 4", 5: "bar b own 5"}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_whole_pages(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    found = queries.op3_page_text(spark, f"/root/testdata/{sf}").collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", "", re.sub("</?(?:p|h1)>|<br>", " ", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_partners_do_not_depend_on_the_partitions(spark):
    page = "<body><div>bar {}</div><p>own {}</p></body>"
    rows = [(i, f"http://h{i // 20}/a/{i:03}", page.format(i // 20, i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7, 60, 200):
        found = P.extract(frame, parts=parts).collect()
        assert {r.page_id: r.text for r in found} == {i: f"own {i}" for i in range(100)}


def test_copies_are_no_partners(spark):
    page = "<body><div>bar</div><p>own {}</p></body>"
    rows = [(i, f"http://h/a?{i:03}", page.format(1)) for i in range(30)] + [(i, f"http://h/b?{i:03}", page.format(2)) for i in range(30, 60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3, 40):
        found = P.extract(frame, parts=parts).collect()
        assert {r.page_id: r.text for r in found} == {i: f"own {1 + i // 30}" for i in range(60)}

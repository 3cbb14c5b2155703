import random
from functools import lru_cache

import numpy as np

from millrace.llm import html_extract
from tests.llm.helpers import pairs


def text(page, template=frozenset()):
    return html_extract.main_text(page, template)


def test_article_without_chrome():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</li></ul></nav><div class="ad big">Buy</div>
    <article><h1>Title &amp; more</h1><p><b>One<br>two<p>Three &lt;x&gt; 4 < 5</p><div class="comments"><p>Reader</p></div><form><input value="a>b">Ask</form><script>var t="</p>";</script><ul><li>a<li>b</ul></article>
    <aside>Side</aside><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title & more\n\nOne two\n\nThree <x> 4 < 5\n\na\n\nb"


def test_odd_pages():
    assert text("") == "" and text("just text") == "just text" and text("<p>a<!-- <p>no</p>") == "a" and text("</p></div><p>x") == "x"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<p title='a>b' class=\"x\">ok</p>") == "ok" and text("<table><tr><td>1<td>2</table>") == "1\n\n2"
    assert text("<script>never closed <p>x") == "" and len(text("<p>" + "long " * 200_000)) == 999_999


def _tree(shapes, *nodes):
    depth, label, key = zip(*nodes)
    return html_extract.Tree(np.array(depth, np.int32), np.array([hash(x) for x in label], np.int64), np.array(key, np.int64), shapes)


def _best(a, i, b, j):
    """The most nodes that two subtrees match, by trying all."""
    if a.label[i] != b.label[j]:
        return 0

    @lru_cache(None)
    def lists(p, q):
        left, right = a.kids[i], b.kids[j]
        if p == len(left) or q == len(right):
            return 0
        return max(lists(p + 1, q), lists(p, q + 1), _best(a, left[p], b, right[q]) + lists(p + 1, q + 1))

    return 1 + lists(0, 0)


def test_alignment_is_a_largest_ordered_matching(monkeypatch):
    shapes = html_extract.Shapes()
    a = _tree(shapes, (0, "", 0), (1, "p", 1), (1, "p", 2), (1, "q", 3))
    b = _tree(shapes, (0, "", 0), (1, "p", 2), (1, "q", 3), (1, "q", 4))
    assert html_extract.align(a, b, shapes) == {0: 0, 2: 1, 3: 2}
    rng = random.Random(1)
    for cells in (1 << 20, 4):  # in linear space, too
        monkeypatch.setattr(html_extract, "TABLE_CELLS", cells)
        for _ in range(150):
            trees = []
            for _ in range(2):
                nodes, depth = [(0, "", 0)], 0
                for _ in range(rng.randrange(14)):
                    depth = rng.randrange(1, min(depth + 2, 4) + 1) if nodes[1:] else 1
                    depth = min(depth, nodes[-1][0] + 1)
                    nodes.append((depth, rng.choice("abc"), rng.randrange(3)))
                trees.append(_tree(shapes, *nodes))
            got = html_extract.align(*trees, shapes)
            assert shapes.matched(trees[0].shape[0], trees[1].shape[0]) == _best(trees[0], 0, trees[1], 0)
            assert all(trees[0].label[i] == trees[1].label[j] for i, j in got.items()) and [j for _, j in sorted(got.items())] == sorted(set(got.values()))


def test_deep_and_wide_pages_align(spark):
    deep = "<div>" * 5000 + "<p>deep {v}</p>" + "</div>" * 5000
    wide = "<ul>" + "".join(f"<li>{{v}} line {i}</li>" for i in range(1500)) + "</ul><p>Same end of all</p>"
    rows = [(i, f"https://a.example.com/{i}", deep.format(v=i)) for i in range(4)] + [(10 + i, f"https://b.example.com/{i}", wide.format(v=i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep 1" and got[12].startswith("2 line 0\n\n") and got[12].endswith("2 line 1499")


def test_each_common_layout_has_its_own_template(spark):
    front = "<body><div class='front'><div>Front banner</div><section>News {v}</section></div></body>"
    page = "<body><div>Same banner</div><p>Text {v} first</p></body>"
    rows = [(i, f"https://a.example.com/{i}", front.format(v=i)) for i in range(5)] + [(10 + i, f"https://a.example.com/x{i}", page.format(v=i)) for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "News 0" and got[10] == "Text 0 first"


def _site(n, host):
    page = "<body><div>Same banner of {h}</div><div>{k} varies {v}</div><div><p>Story {v} first</p><p>Story {v} second</p></div><div>Same end of {h}</div></body>"
    return [(f"https://{host}/en/{i}", page.format(h=host, k="this", v=f"{host}{i}")) for i in range(n)]


def test_template_of_a_host_is_left_out(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(_site(6, "a.example.com") + _site(1, "b.example.com"))] + [(90, None, "<p>no url</p>"), (91, "https://c.example.com/", None), (None, "https://a.example.com/en/9", "")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[0].text == "this varies a.example.com0\n\nStory a.example.com0 first\n\nStory a.example.com0 second"
    assert got[6].text.startswith("Same banner of b.example.com\n\n")  # one page shows no template
    assert got[90].text == "no url" and got[91].text == "" and got[None].text == "" and all(r.n_chars == len(r.text) for r in got.values())


def test_repeated_articles_are_not_template(spark):
    page = "<body><div>Top line</div><article><p>The same story</p></article></body>"
    pages = spark.createDataFrame([(i, f"https://a.example.com/{i}", page) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(pages).collect()} == {"The same story"}


def test_template_inside_articles_is_left_out(spark):
    page = "<body><article><h1>{v}</h1><p>Story {v} first, told at some length</p><div>Read more of us every day</div><p>Story {v} second</p></article></body>"
    same = "<body><article><p>One story that many pages tell again</p><p>Its second paragraph stays too</p><p>Seen {v}</p></article></body>"
    rows = [(i, f"https://a.example.com/{i}", page.format(v=i)) for i in range(6)] + [(10 + i, f"https://b.example.com/{i}", same.format(v=i)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for i in range(6):
        assert got[i] == f"{i}\n\nStory {i} first, told at some length\n\nStory {i} second"
        assert got[10 + i] == f"One story that many pages tell again\n\nIts second paragraph stays too\n\nSeen {i}"


def test_empty_table(spark):
    assert pairs(html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")), "page_id") == []

import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brindle.llm import pages
from brindle.llm.queries import table


def plain(source):
    """The article of a generated page by its marks alone."""
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h\d)[^>]*>", body)
    return "\n".join(b for x in blocks if (b := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x) if "<br>" in x else re.sub(r"<[^>]*>", "", x)).split())))


@pytest.mark.parametrize("group", [200, 3])
def test_table(spark, group):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in pages.extract_pages(df, group).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["page_id"]]
        assert g["text"] == plain(r["html"]) and g["n_chars"] == len(g["text"]) and g["url"] == r["url"], r["page_id"]


def test_template_is_what_does_not_vary():
    page = "<html><body><div>Site name</div><div><p>About {0}</p><p>text {0} &lt;b&gt;</p></div><div>All rights reserved</div></body></html>"
    assert pages.extract([page.format(k) for k in range(4)]) == [f"About {k}\ntext {k} <b>" for k in range(4)]
    assert pages.extract([page.format(0)] * 4) == ["Site name\nAbout 0\ntext 0 <b>\nAll rights reserved"] * 4  # copies tell nothing


def test_constant_inside_article():
    page = "<article><h1>T{0}</h1><div>Read more of us</div><p>a long text {0} of words</p></article>"
    # an article's text is not dropped for being the same elsewhere
    for n in (20, 4, 1):
        assert pages.extract([page.format(k) for k in range(n)]) == [f"T{k}\nRead more of us\na long text {k} of words" for k in range(n)]


def test_parts_that_go():
    source = """<body><header>top</header><nav>menu</nav><div class="cookie-notice">ok?</div><main><h1>T&eacute;</h1><p>one
      <b>two</b>   three<p>four<br>five<script>if (a < b) "</p>"</script><aside>side</aside><form>f<input></form>
      <ul><li>x<li>y</ul><section id="comments"><p>me too</p></section></main><div class="ad">buy</div><footer>end</footer>"""
    assert pages.extract([source]) == ["Té\none two three\nfour five\nx\ny"]


def test_matching():
    names = pages.Interned()
    a, b = (pages.shape(pages.parse(s), names) for s in ("<div><h1>a</h1><p>b</p><p>c</p></div><nav></nav>", "<section></section><div><p>x</p></div><nav></nav>"))
    size, pairs = pages.match(a, b, names)
    assert size == 3 and sorted(x.tag for x, _ in pairs) == ["div", "nav", "p"]


@pytest.mark.parametrize("source", ["", "just text", "<", "<p", "a < b & c", "</div></p>", "<p>a<!-- x", "<script>never ends", "<div " * 50, "<b>" * 5000 + "deep"])
def test_broken_pages(source):
    assert isinstance(pages.extract([source])[0], str)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>", "x"), (None, "http://h/1", None, "x"), (2, "not a url", "", "x"), (2, "http://h/1", "<article><p>" + "long " * 50000 + "</article>", "x"), (2, "http://h/1", "<p>b", "x"), (2, "http://h/1", "<p>b", "x")]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), 2).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 1, 1, 249999]
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_pages():
    deep = "<div id=page><article>" + "<div>" * 200 + "{}" + "</div>" * 200 + "<p>tail</p></article></div>"
    assert pages.extract([deep.format("")]) == ["tail"]
    assert pages.extract([deep.format("<nav>menu</nav><p>text</p><div class=ad>buy</div>")]) == ["text\ntail"]
    assert pages.extract(["<i>" * 50000 + "<p>a" + "</u>" * 50000 + "</i>" * 50000 + "<p>b"] * 3) == ["a\nb"] * 3


@pytest.mark.parametrize("odd", ["", "just text", "<table><tr><td>x</table>"])
def test_an_odd_first_page_does_not_switch_induction_off(odd):
    page = "<div>Site name</div><div><p>About {0}</p></div><div>All rights reserved</div>"
    assert pages.extract([odd] + [page.format(k) for k in range(4)])[1:] == [f"About {k}" for k in range(4)]


def test_slots_missing_from_the_reference():
    page = "<div><p>About {0}</p></div>{1}"
    parts = ["<section>Our prizes</section>", "<table><tr><td>Our shops</table>", "<blockquote>Our words</blockquote>"]
    assert pages.extract([page.format(k, parts[k % 3]) for k in range(12)]) == [f"About {k}" for k in range(12)]


def test_alignment_decides():
    """Without marks, what is constant goes and what varies stays; with an article, what varies beside it stays too."""
    page = "<div>Site name</div><div><div>Menu of us</div><h1>T{0}</h1><div>text {0} of words</div></div><div><span>Call us</span> now</div>"
    whole = [page.format(k) for k in range(5)]
    assert pages.extract(whole) == [f"T{k}\ntext {k} of words" for k in range(5)]
    assert pages.extract(whole, align=False) == [f"Site name\nMenu of us\nT{k}\ntext {k} of words\nCall us now" for k in range(5)]
    beside = "<div>Site name</div><article>story {0}</article><div>more of story {0}</div><ul><li><a href=x>Link {0}</a></li><li><a href=y>Two {0}</a></li></ul>"
    assert pages.extract([beside.format(k) for k in range(5)]) == [f"story {k}\nmore of story {k}" for k in range(5)]
    assert pages.extract([beside.format(k) for k in range(2)]) == [f"story {k}" for k in range(2)]  # too few pages to tell


def test_inline_elements_are_part_of_their_text():
    page = "<div>Site</div><div><p>By <b>the editors</b> of day {0}</p>loose <i>always</i> {0}<div>x {0}</div>All rights</div>"
    assert pages.extract([page.format(k) for k in range(4)]) == [f"By the editors of day {k}\nloose always {k}\nx {k}" for k in range(4)]


def brute(a, b):
    """Simple tree matching, plainly: nodes matched in two lists of (tag, children)."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (s, x) in enumerate(a):
        for j, (t, y) in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (1 + brute(x, y)) * (s == t))
    return best[-1][-1]


def random_tree(r, depth):
    return [(r.choice(["div", "section", "ul"]), random_tree(r, depth - 1)) for _ in range(r.randint(0, 5))] if depth else []


def written(tree, r):
    return "".join(f"<{t}>{written(x, r) or r.choice('uvw')}</{t}>" for t, x in tree)


@pytest.mark.parametrize("cells", [1, 4096])
def test_matching_like_brute_force(monkeypatch, cells):
    monkeypatch.setattr(pages, "CELLS", cells)
    r = random.Random(5)
    for _ in range(150):
        a, b = random_tree(r, 3), random_tree(r, 3)
        names = pages.Interned()
        x, y = (pages.shape(pages.parse(written(t, r)), names) for t in (a, b))
        size, pairs = pages.match(x, y, names)
        assert size == brute(a, b) and len({id(p) for p, _ in pairs}) == size == len({id(q) for _, q in pairs})
        assert all(p.tag == q.tag for p, q in pairs)


@pytest.mark.parametrize("weights", [1, 7, 1 << 20])
def test_weights_by_rows_like_brute_force(monkeypatch, weights):
    monkeypatch.setattr(pages, "PAIRS", 0)
    monkeypatch.setattr(pages, "WEIGHTS", weights)
    test_matching_like_brute_force(monkeypatch, 4096)
    test_matching_like_brute_force(monkeypatch, 1)


def test_few_weights_are_kept(monkeypatch):
    monkeypatch.setattr(pages, "KEPT", 3)
    test_matching_like_brute_force(monkeypatch, 4096)


def test_many_unequal_shapes_match_like_brute_force():
    r = random.Random(8)
    kinds = [*itertools.product(["div", "section", "ul", "blockquote", "table"], repeat=4)]
    a, b = ([("div", [(t, []) for t in x]) for x in r.sample(kinds, 330)] for _ in range(2))
    names = pages.Interned()
    x, y = (pages.shape(pages.parse(written(t, r)), names) for t in (a, b))
    assert len({s.shape for s in x} - {s.shape for s in y}) * len(y) > 50_000
    size, pairs = pages.match(x, y, names)
    assert size == brute(a, b) and len(names.weights) <= pages.KEPT


def test_deep_trees_by_rows():
    names = pages.Interned()
    x, y = (pages.shape(pages.parse("<div>" * 3000 + k + "</div>" * 3000), names)[0].shape for k in ("<ul><li>a</ul><section><p>b</section>", "<section><p>c</section><dl><dt>d</dl>"))
    assert names.dense([x], [y]).tolist() == [[names.weight(x, y)]] == [[3002]]


def test_many_siblings():
    r = random.Random(6)
    rows = [[f"<div>row {k} of {p}</div>" if r.random() < 0.5 else f"<div><p>row {k} of {p}</p><section>x</section></div>" for k in range(20_000 - 100 * p)] for p in range(3)]
    began = time.time()
    got = pages.extract(["<div>Site</div>" + "".join(x) for x in rows])
    assert time.time() - began < 60
    for p, (g, x) in enumerate(zip(got, rows, strict=True)):
        assert [int(k) for k in re.findall(rf"row (\d+) of {p}", g)] == list(range(len(x)))


def test_copies_of_a_row_are_cut(spark):
    df = spark.createDataFrame([(None, None, "<p>a")] * 500, "page_id long, url string, html string")
    assert [(r["n"], r["text"]) for r in pages.extract_pages(df, 20).groupBy("text").agg(F.count("*").alias("n")).collect()] == [(500, "a")]

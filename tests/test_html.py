"""Small pages of our own, from tidy to soup."""

import re

import pytest

from sitegauge.operators import audit as A
from sitegauge.operators import consent as C
from sitegauge.operators import elements as E
from sitegauge.operators import html as H
from sitegauge.operators import structured as J
from sitegauge.operators.evidence import element_selectors
from sitegauge.sources.html import html_nodes

PRODUCT = """<html><head><title>Blue &amp; warm</title><script type="application/ld+json">{"@type":"Product","name":"Blue coat",
"offers":[{"price":"59.90","priceCurrency":"EUR","availability":"https://schema.org/InStock"},{"price":"1"}],"brand":{"name":"Nord"}}</script></head>
<body><header><nav><ul><li><a href="/">Home</a><li><a href="/sale">Sale</a></ul></nav></header>
<main><h1>Blue coat</h1><span class="product-price">€59.90</span><img src="a.jpg" alt="Front"><img src="b.jpg"><img src="c.jpg">
<form name="buy"><label>Size</label><select name="option-size"><option>S<option>M</select><button id="add" type="submit">Add to cart</button></form></main>
<footer><a href="/imprint">Imprint</a></footer></body></html>"""
FORM = "<body><form id=f>" + "".join(f'<input name="n{i}">' for i in range(15)) + '<input type="hidden" name="h"><input required></form></body>'
ABOUT = "<body><h1>About us</h1><p>We are a company.</p></body>"
CONSENT = """<body><div id="onetrust-banner-sdk" class="cookies"><button>Accept all</button><button>Sign in with Google</button></div>
<iframe src="https://widget.intercom.io/x"></iframe><p>text</p></body>"""
SOUP = """<p>one<p><b>two<script>var t="</p><div>";</script><div hidden><span>deep</span></div><!-- <p>no</p> --><ul><li>a<ul><li>b</ul><li>c</ul>
<table><tr><td>1<td>2<tr><td>3</table><input value="x"><br>caf&eacute;"""
PAGES = [(1, PRODUCT), (2, FORM), (3, ABOUT), (4, CONSENT), (5, SOUP), (6, ""), (7, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id BIGINT, html STRING")


@pytest.fixture(scope="module")
def nodes(pages):
    return html_nodes(pages).cache()


def of(nodes, page):
    return sorted((r for r in nodes.collect() if r.page_id == page), key=lambda r: r.doc_pos)


def test_soup(nodes):
    rows = of(nodes, 5)
    paths = {r.xpath: r for r in rows}
    assert paths["/html/body/p"].text == "one"
    assert paths["/html/body/p[2]/b"].text == "two"
    assert "/html/body/ul/li/ul/li" in paths and "/html/body/ul/li[2]" in paths
    assert [r.text for r in rows if r.tag == "td"] == ["1", "2", "3"]
    assert not any(r.tag in ("script", "br") for r in rows)
    assert not paths["/html/body/div/span"].is_visible
    assert next(r for r in rows if r.tag == "input").text == "x"
    assert next(r for r in rows if r.tag == "ul").list_depth == 2


def test_empty_and_missing(nodes):
    assert [r.tag for r in of(nodes, 6)] == ["body"]
    assert of(nodes, 7) == []


def test_positions_nest(nodes):
    rows = {(r.page_id, r.doc_pos): r for r in nodes.collect()}
    for r in rows.values():
        if r.parent_pos is not None:
            parent = rows[(r.page_id, r.parent_pos)]
            assert parent.doc_pos < r.doc_pos <= r.last_pos <= parent.last_pos
            assert r.depth == parent.depth + 1 and r.xpath.startswith(parent.xpath + "/")


def test_regions_and_outline(nodes):
    got = {(r.page_id, r.xpath): r.region for r in H.content_regions(nodes).collect()}
    assert got[(1, "/html/body/header/nav/ul/li/a")] == "header"
    assert got[(1, "/html/body/main/form/button")] == "main"
    assert got[(1, "/html/body/footer/a")] == "footer"
    lines = [r.line.strip() for r in E.outline(nodes).filter("page_id = 1").orderBy("doc_pos").collect()]
    assert '- heading "Blue coat" [level=1]' in lines and '- button "Add to cart"' in lines


def test_product_data(pages):
    row = J.product_fields(J.products(pages)).collect()
    assert [(r.page_id, r.name, r.price, r.currency, r.availability, r.brand) for r in row] == [
        (1, "Blue coat", 59.9, "EUR", "InStock", "Nord")]


def test_selectors(nodes):
    got = {r.xpath: r.selector for r in element_selectors(nodes).filter("page_id = 1").collect()}
    assert got["/html/body/main/form/button"] == "#add"


def test_consent(nodes):
    assert [tuple(r) for r in C.consent_platforms(nodes).collect()] == [(4, "onetrust")]
    from pyspark.sql import functions as F
    assert [r.text for r in nodes.filter(C.is_accept_button(F.col("text"))).collect()] == ["Accept all"]
    noise = {(r.page_id, r.family): r.nodes for r in C.ui_noise(nodes).collect()}
    assert noise == {(4, "cookie-banners"): 1, (4, "chat-widgets"): 1}
    kept = C.without_noise(nodes).filter("page_id = 4").count()
    assert kept == len(of(nodes, 4)) - 2


def test_rules_on_real_markup(spark, pages, nodes):
    urls = spark.createDataFrame([(p, f"https://x.example.com/p{p}") for p, _ in PAGES], "page_id BIGINT, url STRING")
    typed = E.with_type(nodes)
    got = {}
    for r in A.audit(urls, typed).collect():
        got.setdefault(r.page_id, []).append((r.type, r.issue))
    names = {p: {t for t, _ in v} for p, v in got.items()}
    assert ("form_field_overload", "Form has 16 fields") in got[2]
    assert "no_submit_button" in names[2] and "no_submit_button" not in names[1]
    assert [t for t, _ in got[2]].count("missing_field_label") == 16
    assert "no_required_indicator" in names[2]
    assert {"generic_headline", "no_main_nav", "no_home_link"} <= names[3]
    assert "no_home_link" not in names[1] and "no_main_nav" not in names[1]
    # A page without any element still lacks what it lacks.
    assert {"missing_cta", "missing_h1", "no_search"} <= names[7]
    # Static markup has no boxes, so nothing counts as above the fold.
    assert "missing_cta" in names[1]


def test_rule_book(spark, nodes):
    book = A.RuleBook()
    book.register("shout", "text = upper(text) AND length(text) > 3", issue="Shouting", recommendation="Calm down")
    with pytest.raises(ValueError, match="already registered"):
        book.register("shout", "true")
    with pytest.raises(ValueError, match="unknown rules"):
        A.audit(nodes, nodes, ["nope"])
    urls = spark.createDataFrame([(1, "https://x/")], "page_id BIGINT, url STRING")
    assert [r.issue for r in book.run(["nope"], urls, nodes).collect()] == ["unknown rule: nope"]


GIVEN = "page_group STRING, rule STRING, name STRING, value STRING"


def own_rules():
    book = A.RuleBook()
    book.register("wordy", "length(text) > p.chars AND tag <> p.but", issue="wordy", parameters={
        "chars": A.Parameter("int", 3, 1, 50), "but": A.Parameter("string", "p", choices=("p", "q"))})
    book.register("shout", "text = upper(text) AND text <> lower(text)", issue="shout")
    return book


@pytest.fixture(scope="module")
def words(spark):
    rows = [(page, f"/{page}/{i}", tag, text) for page in (1, 2, 3) for i, (tag, text) in enumerate(
        [("a", "four"), ("a", "LETTERS"), ("p", "LETTERS"), ("q", "tenletters")])]
    return spark.createDataFrame(rows, "page_id BIGINT, xpath STRING, tag STRING, text STRING")


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([(1, "a", "u"), (2, "b", "v"), (3, None, "w")], "page_id BIGINT, page_group STRING, url STRING")


@pytest.mark.parametrize(("given", "hits", "problems"), [
    ([], {1: 3, 2: 3, 3: 3}, []),
    ([(None, "wordy", "chars", "5")], {1: 2, 2: 2, 3: 2}, []),
    ([(None, "wordy", "chars", "5"), ("a", "wordy", "chars", "9"), ("b", "wordy", "but", "q")], {1: 1, 2: 2, 3: 2}, []),
    ([("a", "wordy", "chars", "0"), ("b", "wordy", "chars", "51"), ("b", "wordy", "but", "z")], {3: 3},
     ["wordy.chars of group a: below 1.0", "wordy.chars of group b: above 50.0", "wordy.but of group b: not one of p, q"]),
    ([(None, "wordy", "chars", "x")], {}, ["wordy.chars: not of type int"]),
    ([(None, "wordy", "chars", "5"), (None, "wordy", "chars", "6")], {}, ["wordy.chars: given more than once"]),
    ([("a", "wordy", "chars", "5"), ("a", "wordy", "chars", "5")], {1: 2, 2: 3, 3: 3}, []),
    ([("a", "wordy", "chars", None), ("b", "wordy", "size", "5"), (None, "no", "n", "1"), (None, "shout", "x", "1"), (None, None, None, None)],
     {3: 3}, ["wordy.chars of group a: no value", "wordy.size of group b: no such parameter", "no.n: no such rule",
              "shout.x: no such parameter", ".: no such rule"]),
])
def test_rule_parameters(spark, words, grouped, given, hits, problems):
    rows = own_rules().run(["wordy", "shout"], grouped, words, spark.createDataFrame(given, GIVEN)).collect()
    found = [r.page_id for r in rows if r.type == "wordy"]
    assert {p: found.count(p) for p in set(found)} == hits
    assert sorted(r.issue for r in rows if r.type == "error") == sorted(f"invalid parameter {p}" for p in problems)
    assert sum(r.type == "shout" for r in rows) == (0 if any("shout" in p for p in problems) else 6)


def test_rules_share_one_scan(spark, words, grouped, tmp_path):
    words.write.parquet(f"{tmp_path}/nodes")
    nodes, book = spark.read.parquet(f"{tmp_path}/nodes"), own_rules()
    for i in range(10):
        book.register(f"more{i}", "length(text) = p.n", parameters={"n": A.Parameter("int", i)})
    given = spark.createDataFrame([("a", "wordy", "chars", "5")], GIVEN)
    df = book.run(["wordy", "shout", *[f"more{i}" for i in range(10)]], grouped, nodes, given)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet[^\n]*/nodes", plan)) == 1
    with pytest.raises(ValueError, match="takes no parameters"):
        book.register("f", lambda pages, typed: typed, parameters={"n": A.Parameter("int", 1)})


def test_deep_nesting_is_bounded():
    """Unclosed elements by the ten thousand: time stays linear, and paths as short as in a browser."""
    import time

    from sitegauge.sources import html as source
    start = time.process_time()
    rows = source._Elements().finish("<header>" + "<div>" * 50_000 + "x")
    rows += source._Elements().finish("<b>" * 30_000 + "<p>a" * 2_000 + "</i>" * 30_000)
    assert time.process_time() - start < 30 and len(rows) > 80_000
    assert max(r["depth"] for r in rows) == 512 and max(len(r["xpath"]) for r in rows) < 5_000
    assert rows[40_000]["region"] == "header"


def test_text_in_many_pieces_takes_linear_time():
    import time

    from sitegauge.sources import html as source

    def seconds(n):
        start = time.process_time()
        rows = source._Elements().finish("some words<br>" * n)
        assert rows[0]["raw_text"] == "some words" * n
        return time.process_time() - start
    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 0.2


def test_category_words_are_not_pasted_into_sql(spark):
    from sitegauge.operators.evaluations import filter_categories
    rows = spark.createDataFrame([("Shopper's trust",), ("Forms",), ("CTA",)], "category STRING")
    assert [r.category for r in filter_categories(rows, ["shopper's", "cta"], ["form"]).collect()] == ["Shopper's trust", "CTA"]

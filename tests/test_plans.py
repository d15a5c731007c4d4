"""What plans must not do: broadcast rows that grow with the input, or shuffle the same value more than once."""

from pyspark.sql import functions as F

from sitegauge.operators import evaluations as EV
from sitegauge.operators import reports as O
from sitegauge.plans import output_queries as OQ
from sitegauge.rules import heuristics as H
from sitegauge.sources.knowledge import builtin_heuristics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, folder, pages=40, shots=3):
    """A small lineitem table of as many pages and viewports."""
    rows = spark.range(pages * shots).select(
        (F.col("id") % pages).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") * 7).alias("l_suppkey"),
        (F.floor(F.col("id") / pages) + 1).cast("int").alias("l_linenumber"), (F.col("id") % 9).cast("double").alias("l_quantity"))
    rows.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    return OQ, folder


def plain_selected(numbers):
    """Viewports of a page by the definition, one category after the other."""
    out = []
    order = lambda i: (i is not None, i)
    for category, (wanted, most) in H.VIEWPORT_NEEDS.items():
        fits = [i for i in numbers if not wanted or i in wanted]
        rest = [i for i in numbers if i is not None] or numbers
        chosen = sorted(fits, key=order)[:most] if fits else sorted(rest, key=order)[:1]
        out += [(category, i, n) for n, i in enumerate(chosen, 1)]
    return sorted(out, key=str)


def test_selected_viewports_of_odd_pages(spark):
    pages = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [9, 8, 7], [None], [None, 12], [2, 2, 2, 2, 2, 2, 2, 2, 0], [None, None, 3, 1], [-1, -2, 5], [*range(-9, 4)]]
    rows = [(p, i) for p, numbers in enumerate(pages) for i in numbers]
    frame = EV.select_viewports(spark.createDataFrame(rows, "page_id LONG, viewport_index INT"))
    found = [tuple(r) for r in frame.select("page_id", "category", "viewport_index", "place").collect()]
    for p, numbers in enumerate(pages):
        assert sorted((r[1:] for r in found if r[0] == p), key=str) == plain_selected(numbers), numbers


def test_selection_shuffles_viewports_and_not_categories(spark):
    """The rows that are sorted and shuffled are viewports; categories come after."""
    text = plan(EV.select_viewports(spark.createDataFrame([(1, 0)], "page_id LONG, viewport_index INT")))
    assert text.index("Generate explode") < text.index("Exchange")
    assert "Generate explode" not in text[text.index("Exchange"):]


def test_prompts_broadcast_rules_only(spark, tmp_path):
    from sitegauge.sources.tables import Tables
    lines(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    assert plan(OQ.build_prompt(t)).count("BroadcastExchange") == 1
    assert "BroadcastExchange" not in plan(OQ.filter_dom_sections(t))


def test_prompts_hold_each_section_that_a_category_needs(spark):
    sections = spark.createDataFrame([(1, 0, "a [3]"), (1, 1, "b"), (2, 0, "c")], "page_id LONG, viewport_index INT, section STRING")
    wanted = spark.createDataFrame([(1, "x", 1), (1, "x", 0), (1, "y", 1), (2, "y", 7), (2, "z", 0), (1, None, 0)],
                                   "page_id LONG, category STRING, viewport_index INT")
    rules = spark.createDataFrame([("x", "r1", "high", "p"), ("y", "r2", "low", "q")],
                                  "category STRING, heuristic_id STRING, severity STRING, principle STRING")
    found = {(r.page_id, r.category): r.prompt.split("\n") for r in O.prompts(sections, wanted, rules).collect()}
    assert sorted(found) == [(1, "x"), (1, "y")]
    assert found[1, "x"] == ["Category: x", "Page:", "a [v0-3]", "", "b", "Rules:", "[r1] (high) p", "Judge every rule and answer in JSON."]
    assert found[1, "y"][2:4] == ["b", "Rules:"]


def test_prompts_are_written_without_a_sort(spark, tmp_path):
    from sitegauge.sources import sinks
    rows = spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 10).alias("category"), F.col("id").cast("string").alias("prompt"))
    sinks.write_prompts(rows.coalesce(1), f"{tmp_path}/prompts")
    assert spark.read.parquet(f"{tmp_path}/prompts").groupBy("category").count().count() == 10
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= len(H.VIEWPORT_NEEDS)
    assert builtin_heuristics(spark).select("category").distinct().count() <= 24


def node_rows(spark):
    rows = [(1, 5, "button", "Add to cart", {"id": "add", "title": "Basket"}, 3, True, 0), (1, 4, "button", "Add", {"id": "add", "disabled": "disabled"}, None, True, 1),
            (2, 1, "a", "Sign  in", {"class": "nav-link btn", "href": "/cart", "id": "menu_nav"}, None, True, 2), (3, 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "page_id LONG, doc_pos LONG, tag STRING, text STRING, attrs MAP<STRING, STRING>, form_id INT, is_visible BOOLEAN, y LONG").withColumns({"w": F.lit(50), "h": F.lit(50)})


def test_intents_are_matched_in_one_pass(spark):
    from sitegauge.operators import elements as E
    from sitegauge.plans.element_queries import INTENTS
    nodes = node_rows(spark)
    every = E.match_intents(nodes, INTENTS)
    assert plan(every).count("Scan") == 1
    keys = ["page_id", "doc_pos", "match_type", "signals", "confidence"]
    for intent in INTENTS:
        one = sorted(map(str, E.match_intent(nodes, intent).select(*keys).collect()))
        assert sorted(map(str, every.filter(F.col("intent") == intent).select(*keys).collect())) == one
    found = {(r.doc_pos, r.intent): (r.match_type, r.signals, round(r.confidence, 2)) for r in every.filter("page_id < 3").collect()}
    assert found[5, "cart"] == ("aria", 2, 0.9) and found[1, "nav"] == ("word_boundary", 2, 0.9) and found[4, "login"] == ("none", 0, 0.0)


def test_wide_rows_of_nodes_are_not_sorted(spark):
    """Aggregates that hold text sort their rows: these get buttons or headings only."""
    from sitegauge.operators import pagetype as P
    found = {r.page_id: (r.cta_text, r.cta_score, r.adds_to_cart) for r in P.primary_cta(node_rows(spark)).collect()}
    assert found == {1: ("Add to cart", 35, True)}
    text = plan(P.product_signals(node_rows(spark)))
    wide = [line for line in text.split("\n") if "SortAggregate" in line and ("subtotal" in line or "cards" in line)]
    assert "SortAggregate" in text and not wide
    rows = P.product_signals(node_rows(spark)).collect()
    assert {r.page_id: r.cta_text for r in rows} == {1: "Add to cart", 2: None, 3: None}

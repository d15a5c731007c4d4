"""Values that follow from the semantics, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import numbers as N
from sitegauge.functions import replies as RP
from sitegauge.functions import text as S
from sitegauge.functions import urls as U
from sitegauge.operators import elements as E
from sitegauge.operators import evaluations as EV
from sitegauge.operators import insights as I
from sitegauge.operators import quality as Q
from sitegauge.operators import steps as ST


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i INT, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, S.title_case, ["no_trust_above_fold", "weak-cta_x"]) == ["No Trust Above Fold", "Weak-Cta X"]
    assert values(spark, lambda x: S.truncate_text(x, 10), ["a  b", "abcdefghijk"]) == ["a b", "abcdefg..."]
    assert values(spark, S.count_words, ["", "  ", " a  b\nc ", None]) == [0, 0, 3, 0]
    assert values(spark, S.plain_refs, ["see [5], [2] and [5], [v1-3]"]) == [[2, 5]]
    assert values(spark, lambda x: S.relabel_refs(x, F.lit(3)), ["[1] and [20]"]) == ["[v3-1] and [v3-20]"]
    assert values(spark, S.insight_category, ["PDP-CTA-001", "PLP-GRID-001"]) == ["cta", "heuristic"]
    assert values(spark, lambda x: S.normalize_status(x, True), [" Passed", "not applicable", "odd"]) == ["pass", "not_applicable", None]
    assert values(spark, lambda x: S.normalize_status(x, False), ["N/A", "odd"]) == ["not_applicable", "not_applicable"]


def test_urls(spark):
    assert values(spark, U.domain_of, ["https://WWW.Shop.com/a", "http://m.x.de", "nonsense"]) == ["shop.com", "m.x.de", ""]
    assert values(spark, U.normalize_url, ["https://X.com/A/#top", "https://x.com/A"]) == ["https://x.com/a", "https://x.com/a"]
    assert values(spark, U.is_homepage, ["https://x.com", "https://x.com/", "https://x.com/home", "https://x.com/p", "bad"]) == [
        True, True, True, False, False]
    assert values(spark, U.url_error, ["", "x.com", "ftp://x.com", "https://x.com"]) == ["empty", "invalid format", "bad protocol", None]


def test_numbers(spark):
    assert values(spark, N.parse_price, ["$1,299.50", "EUR 5", "12 500 kr", None]) == [1299.5, None, 12500.0, None]
    assert values(spark, N.first_price, ["from EUR 1,234.50"]) == [1234.5]
    assert values(spark, N.normalize_confidence, [85.0, 0.4, -1.0, 500.0, None], "DOUBLE") == [0.85, 0.4, 0.0, 1.0, 0.5]
    assert values(spark, N.noisy_or, [[0.9, 0.8, 0.3], [], [1.5]], "ARRAY<DOUBLE>") == [pytest.approx(0.986), 0.0, 1.0]
    assert values(spark, lambda w: N.image_tokens(w, F.lit(800)), [0, 512, 1280], "INT") == [85, 255, 595]
    assert values(spark, N.half_up, [2.5, -0.5, 1.4], "DOUBLE") == [3, 0, 1]


def test_json_of_replies(spark):
    replies = ['x ```json\n{"a":1}\n``` y', 'so {"a":{"b":2}} done', "none"]
    assert values(spark, RP.extract_json_object, replies) == ['{"a":1}', '{"a":{"b":2}}', None]
    assert values(spark, RP.extract_json, replies)[1:] == ['{"a":{"b":2}}', "none"]


def node(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)],
                                 "page_id BIGINT, doc_pos BIGINT, tag STRING, text STRING, attrs MAP<STRING,STRING>")


def test_types(spark):
    rows = node(spark, [("button", "Buy", {}), ("a", "x", {}), ("div", "x", {"class": "Btn-Primary"}), ("h1", "Hi", {}),
                        ("span", "x", {"itemprop": "price"})])
    got = [(r.element_type, r.type_confidence) for r in E.classify_max(rows).orderBy("doc_pos").collect()]
    assert got == [("cta", 0.8), (None, None), ("cta", 0.85), ("value_prop", 0.7), ("price", 0.95)]
    noisy = E.classify_noisy_or(rows).orderBy("doc_pos").first()
    assert noisy.element_type == "cta" and noisy.type_confidence == pytest.approx(1 - 0.4 * 0.2)
    strict = E.match_intent(node(spark, [("button", "", {"class": "x button", "type": "submit"}), ("p", "", {"class": "main-button"}),
                                         ("p", "", {"class": "buttons"})]), "button").orderBy("doc_pos").collect()
    assert [(r.match_type, r.confidence) for r in strict] == [("exact", 0.99), ("word_boundary", 0.85), ("none", 0.0)]


INSIGHT = ("page_id BIGINT, seq BIGINT, severity STRING, category STRING, type STRING, element STRING, issue STRING, recommendation STRING,"
           " heuristic_id STRING, confidence DOUBLE, source STRING, evidence_text STRING, evidence_selector STRING, evidence_screenshot STRING")


def insights(spark, rows):
    base = dict(page_id=1, severity="high", category="cta", type="t", element="/e", issue="Long enough issue", recommendation="Long enough",
                heuristic_id=None, confidence=None, source="tool", evidence_text=None, evidence_selector=None, evidence_screenshot=None)
    names = [c.split()[0] for c in INSIGHT.split(",")]
    return spark.createDataFrame([tuple({**base, "seq": i, **r}[n] for n in names) for i, r in enumerate(rows)], INSIGHT)


def fold(texts):
    out = None
    for t in texts:
        if t and out is None:
            out = t
        elif t and t != out:
            out = f"{out} | {t}"
    return out


@pytest.mark.parametrize("texts", [["a"], ["a", "a"], ["a", "b", "a"], ["a", "a", "b", "b", "a"], [None, "x", None, "x", "y"], [None],
                                   ["a", "b", "a | b", "b"]])
def test_evidence_is_folded_in_order(spark, texts):
    rows = insights(spark, [{"evidence_text": t} for t in texts])
    got = I.dedupe_insights(rows).collect()
    assert len(got) == 1 and got[0].merged == len(texts)
    assert (" | ".join(r.text for r in I.evidence_texts(rows).orderBy("seq").collect()) or None) == fold(texts)


def test_dedupe_is_idempotent(spark):
    rows = insights(spark, [{"type": "A "}, {"type": "a"}, {"heuristic_id": "PDP-CTA-001"}, {"heuristic_id": "PDP-CTA-001", "element": "/x"}])
    once = I.dedupe_insights(rows)
    assert once.count() == 2 and I.dedupe_insights(once.drop("dedupe_key", "merged")).count() == 2


def test_styles_later_wins(spark):
    df = spark.createDataFrame([(1, 1, {"c": "r", "w": "1"}), (1, 2, {"c": "b"})], "page_id BIGINT, seq BIGINT, styles MAP<STRING,STRING>")
    assert {r.style: r.value for r in I.merge_styles(df, ["page_id"]).collect()} == {"c": "b", "w": "1"}


def test_scores(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id BIGINT")
    rows = insights(spark, [{"severity": "critical"}, {"severity": "low", "category": "form"}, {"page_id": 2, "category": "trust"}])
    got = {r.page_id: r.overall for r in I.score_overall(pages, rows).collect()}
    # 25 * 1.2 + 2 * 1.1 = 32.2 weighted, 27 plain: 0.7 * 32.2 + 0.3 * 27 = 30.64, rounded 31.
    assert got == {1: 69, 2: 85, 3: 100}


def test_hypothesis_numbers_follow_input(spark):
    rows = I.hypotheses(insights(spark, [{"severity": "high"}, {"severity": "low"}, {"severity": "critical"}])).orderBy("place").collect()
    assert [(r.id, r.priority) for r in rows] == [("H-002", 10), ("H-001", 8)]


def test_runs_are_compared_by_last_evaluation(spark):
    rows = [("baseline", 1, "fail"), ("baseline", 2, "pass"), ("optimized", 3, "fail")]
    df = spark.createDataFrame([(1, "H", r, s, st, 0.5) for r, s, st in rows],
                               "page_id BIGINT, heuristic_id STRING, run STRING, seq BIGINT, status STRING, confidence DOUBLE")
    compared = EV.compare_runs(df)
    graded = EV.classify_discrepancies(compared).first()
    assert (graded.discrepancy, graded.cause) == ("critical", "the optimized run reports an issue the baseline does not")
    verdict = EV.quality_match(compared).first()
    assert not verdict.passed and verdict.effective_rate == 0.0


def test_plans(spark):
    pages = spark.createDataFrame([(1, 2000, 800), (2, 300, 800), (3, 9000, 800)], "page_id BIGINT, page_height INT, viewport_h INT")
    seg = Q.plan_segments(pages).filter("page_id = 1").orderBy("segment").collect()
    assert [(r.start, r.stop) for r in seg] == [(0, 800), (700, 1500), (1400, 2000)]
    tiles = {p: [(r.start, r.stop) for r in Q.plan_tiles(pages).filter(f"page_id = {p}").orderBy("tile").collect()] for p in (1, 2, 3)}
    assert tiles[1] == [(0, 1800), (1700, 2000)] and tiles[2] == [(0, 300)] and len(tiles[3]) == 5
    steps = [r.s for r in pages.select("page_id", Q.plan_steps(F.col("page_height"), F.col("viewport_h")).alias("s")).orderBy("page_id").collect()]
    assert steps == [9, 5, 35]


def test_streak_ends_on_success(spark):
    ok = [True, False, False, True, False]
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(ok)], "run_id BIGINT, step BIGINT, success BOOLEAN")
    got = ST.streaks(df, ~F.col("success"), "n", "total").orderBy("step").collect()
    assert [(r.n, r.total) for r in got] == [(0, 0), (1, 1), (2, 2), (0, 2), (1, 3)]


def test_budgets(spark):
    df = spark.createDataFrame([(1, i, "x" * 7) for i in range(10)], "k BIGINT, i BIGINT, line STRING")
    assert ST.token_budget_cut(df, "k", "i", 10, 3).filter("kept").count() == 5
    assert ST.token_budget_cut(df, "k", "i", 20, 3).filter("kept").count() == 10
    kept = ST.serialize_budget(df, "k", "i", 10, 3).orderBy("i").collect()
    assert len(kept) == 5 and kept[-1].stops and not kept[-2].stops


def test_noisy_or_in_sql(spark):
    """The function that the session offers to SQL equals the column function, grouped and alone."""
    from sitegauge.functions import numbers as N
    from sitegauge.session import tuned
    tuned(spark)
    rows = spark.createDataFrame([(k, w) for k, ws in enumerate([[0.5, 0.25], [0.9], [0.1, 0.2, 0.3], [1.5, -1.0]]) for w in ws],
                                 "k INT, w DOUBLE")
    got = spark.sql("SELECT k, noisy_or(array_agg(w)) AS c FROM {rows} GROUP BY k", rows=rows)
    want = rows.groupBy("k").agg(N.noisy_or(F.collect_list("w")).alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT noisy_or(array(0.5D, 0.5D)) AS c, noisy_or(CAST(array() AS ARRAY<DOUBLE>)) AS z").first() == (0.75, 0.0)

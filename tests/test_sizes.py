"""Results that must not change with the size of a key, and plans that must not read their input many times."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegauge.operators import insights as I
from sitegauge.operators import reports as O
from sitegauge.operators import steps as T
from sitegauge.plans import chunks
from sitegauge.plans.catalog import QUERIES
from sitegauge.plans import everything  # noqa: F401
from sitegauge.sources.tables import Tables

FIELDS = "severity category type element issue recommendation heuristic_id source evidence_selector evidence_screenshot".split()


def insights(spark, texts, step=1):
    rows = [(1, i * step, t, 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id BIGINT, seq BIGINT, evidence_text STRING, confidence DOUBLE")
    fixed = {"severity": "high", "category": "cta", "type": "t", "element": "e", "issue": "i", "recommendation": "r",
             "heuristic_id": "H-1", "source": "tool", "evidence_selector": "", "evidence_screenshot": None}
    return df.select("*", *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()])


def joined(texts):
    kept, out = [], None
    for t in texts:
        if not t or t == out:
            continue
        kept.append(t)
        out = t if out is None else f"{out} | {t}"
    return kept


@pytest.mark.parametrize("n", [0, 1, 999, 1001, 5000])
@pytest.mark.parametrize("start", [["a", "b", "a | b"], ["a", "a", "", "a", "b", "a | b", "a | b", "c", "a | b | c"], ["x | y"], ["a", "a | a"]])
def test_one_evidence_rule_at_every_size(spark, n, start):
    texts = start + [f"t{i}" for i in range(n)] + start
    for step in (1, 400_000):  # in one chunk, and over many
        rows = insights(spark, texts, step)
        got = I.evidence_texts(rows).orderBy("seq").collect()
        assert [r.text for r in got] == joined(texts)
        assert [(r.merged, r.seq) for r in I.dedupe_insights(rows).collect()] == [(len(texts), 0)]


@pytest.mark.parametrize("step", [1, 300_000])
def test_evidence_that_holds_separators(spark, step):
    """Every text holds the separator, so none is kept for lack of one; copies in runs, chains that are left out time and again."""
    rng = random.Random(3)
    chain, so_far = ["a | b"], "a | b"
    for i in range(12):
        chain += [f"c | {i}"] * (1 + i % 3)
        so_far += f" | c | {i}" * (1 + i % 3)
        chain += [so_far] * (i % 4)
    mixed = [rng.choice(["p | q", "p", "q", "p | q | p", "p | p", "é | 😀", "p | q | p | q"]) for _ in range(400)]
    for texts in (chain, mixed, ["x | y"] * 3000, ["x | y", "z"] + ["x | y | z"] * 2000 + ["w | w"] * 700,
                  [f"{i} | {i % 7}" for i in range(4000)], ["x | y", "u | v", "x | y | u | v"] * 900):
        got = I.evidence_texts(insights(spark, texts, step)).orderBy("seq").collect()
        assert [r.text for r in got] == joined(texts)


def test_a_hot_key_of_separators_is_folded_as_few_numbers(spark, monkeypatch):
    """Of 20,000 long texts only the first few runs can still equal what is joined; the rest never meets in a group."""
    folded = []
    fold = I._left_out
    monkeypatch.setattr(I, "_left_out", lambda runs, keys: folded.append(runs.count()) or fold(runs, keys))
    texts = [f"{i:05d} | {'word ' * 20}" for i in range(20_000)]
    assert I.evidence_texts(insights(spark, texts)).count() == len(joined(texts))
    assert folded[0] <= 4


def test_hashes_of_joined_texts(spark):
    rows = spark.createDataFrame([("a | b", "c", 1), ("z", "x", 5), ("é😀", " | ", 1000)], "a STRING, b STRING, n INT")
    a, b = I._rolled(F.col("a")), I._rolled(F.col("b"))
    assert rows.filter(I._then(a, I._times(b, F.col("n"))) != I._rolled(F.concat("a", F.expr("repeat(b, n)")))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 999, 1001, 5000])
def test_report_totals_are_the_pages(spark, n):
    rows = insights(spark, [f"t{i}" for i in range(n)])
    pages = spark.createDataFrame([(1, "u"), (2, "v")], "page_id BIGINT, url STRING")
    report = O.report_json(pages, rows, I.score_overall(pages, rows), I.hypotheses(rows))
    head = {r.page_id: r.json for r in report.filter("section = 0").collect()}
    assert f'"insights":{{"total":{n},' in head[1] and f'"hypotheses":{{"total":{n}}}' in head[1] and '"total":0' in head[2]
    assert report.filter("section = 1").count() == n and report.filter("section = 2").count() == n
    lines = O.report_markdown(rows, I.score_overall(pages, rows), I.hypotheses(rows))
    assert lines.filter("position = -1 AND page_id = 1").count() == (3 if n else 1)


def test_order_on_a_hot_page(spark):
    """One page holds most rows, with continuous and with equal scores; the carry table stays small."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0).alias("page_id"), F.col("id").alias("seq"),
        F.lit("high").alias("severity"), F.lit("t").alias("type"), F.lit("b").alias("business_type"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.rand(1)).otherwise(F.lit(0.57)).alias("confidence"))
    rows = rows.cache()
    got = {(r.page_id, r.seq): r.place for r in I.prioritize(rows).collect()}
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(
        F.coalesce(F.col("confidence") * 10, F.lit(0.0))), "seq")))
    assert got == {(r.page_id, r.seq): r.place for r in plain.collect()}
    dense = spark.range(200_000).select(F.rand(2).alias("v"), F.col("id").alias("seq"))
    cuts = dense.select(*[c.alias(f"c{i}") for i, c in enumerate(I.value_cut(F.col("v"), 1000))]).distinct().count()
    assert cuts < 2100


@pytest.mark.parametrize("value", [0.57, 0.1 + 0.2, 1 / 3, -4.005, 100.0, 569.9999999999999 / 1000])
def test_cuts_follow_the_order(spark, value):
    near = [value + k * 1e-16 * max(1, abs(value)) * 4 for k in range(-40, 41)] + [value + k / 1000 for k in range(-5, 6)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(near)], "v DOUBLE, seq BIGINT")
    cut = [c.alias(f"c{i}") for i, c in enumerate(I.value_cut(F.col("v"), 1000, 5))]
    found = [tuple(r)[2:] for r in rows.select("v", "seq", *cut).orderBy("v", "seq").collect()]
    assert found == sorted(found)


def test_evidence_package_of_a_hot_page(spark, tmp_path):
    """Parts are bounded, in document order, and hold every element once; the files one after the other are the document."""
    import json

    from sitegauge.sources import sinks
    boxes = spark.range(7000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 2).otherwise(1).alias("page_id"), (F.col("id") % 2900).alias("element_index"), F.col("id").alias("x"),
        F.lit(5).cast("long").alias("y"), F.lit("cta").alias("element_type"), F.lit(0.5).alias("confidence"), (F.col("id") % 4).alias("viewport_index"),
        F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("h"), F.array(F.col("id") % 4).alias("viewports"))
    pages = spark.range(1, 53).select(F.col("id").alias("page_id"), F.lit("u").alias("url"))
    shots = spark.range(52 * 5).select((F.col("id") % 52 + 1).alias("page_id"), (F.col("id") % 5).alias("viewport_index"), F.col("id").alias("scroll_y"))
    metrics = pages.select("page_id", F.lit(1 / 3).alias("coverage"), F.array(F.lit("w")).alias("warnings"))
    rows = O.evidence_package(pages, boxes, shots, metrics, band=1000, most=500)
    sinks.write_in_order(rows, ["page_id", "section", "place", "part"], "json", f"{tmp_path}/out")
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    parsed = [(*map(int, line.split("\t")[:4]), json.loads(line.split("\t", 4)[4])) for line in lines]
    assert [p[:4] for p in parsed] == sorted(p[:4] for p in parsed) and len({p[:4] for p in parsed}) == len(parsed)
    want = {}
    for r in boxes.collect():
        want.setdefault(r.page_id, []).append((r.element_index, r.x))
    for page, own in want.items():
        parts = [p[4] for p in parsed if p[:2] == (page, 1)]
        assert [(e["element_index"], e["x"]) for part in parts for e in part] == sorted(own) and max(map(len, parts)) <= 500
    assert sum(p[1] == 0 for p in parsed) == 52 and all(p[4]["metrics"] == {"coverage": 0.3333} for p in parsed if p[1] == 0)
    assert all(len(p[4]["elements"]) <= 1000 for p in parsed if p[1] == 2)


def test_evidence_package_is_dealt_once_as_values(spark, tmp_path):
    """Nothing is shuffled after the ranges, no JSON before them, and files of ``dealt`` rows are the document; nulls, places without a
    viewport, viewports without elements, two rows of one viewport."""
    import json

    from sitegauge.sources import sinks
    found = [(p, v, e, x) for p in (1, 2, 3, None) for v in (0, 1, 5, None) for e in (0, 3, 9, 25, None) for x in (7, 4) if (p, v, e) != (2, 1, 3)]
    boxes = spark.createDataFrame(found, "page_id LONG, viewport_index INT, element_index LONG, x LONG").selectExpr(
        "page_id", "element_index", "x", "0L AS y", "'cta' AS element_type", "0.5D AS confidence", "viewport_index", "1L AS w", "1L AS h",
        "CASE WHEN viewport_index IS NULL THEN array() WHEN page_id = 3 THEN array(viewport_index, 6) ELSE array(viewport_index) END AS viewports")
    seen = [(1, 0, 0), (1, 0, 9), (1, 7, 7), (2, 1, 1), (3, 6, 6), (4, 0, 0), (None, 0, 0), (2, None, 5)]
    shots = spark.createDataFrame(seen + seen[:2], "page_id LONG, viewport_index INT, scroll_y INT")
    pages = spark.createDataFrame([(1, "u"), (3, "w"), (9, "z")], "page_id LONG, url STRING")
    metrics = spark.createDataFrame([(1, 0.5), (2, 0.25), (4, None)], "page_id LONG, coverage DOUBLE").withColumn("warnings", F.array(F.lit("w")))
    rows = O.evidence_package(pages, boxes, shots, metrics, band=8, most=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    ranges = plan.index("Exchange rangepartitioning")
    assert plan.index("Exchange") == ranges and plan.count("rangepartitioning") == 1
    assert "StructsToJson" not in plan[ranges:] and "StructsToJson" in plan[:ranges]

    got = {tuple(r)[:4] + (json.dumps(json.loads(r.json), sort_keys=True),) for r in rows.collect()}
    want = {(p, 0, 0, 0, json.dumps({"schemaVersion": "1.0.0", "page_id": p, "meta": {"url": u}, "metrics": {"coverage": c}, "warnings": ["w"]}, sort_keys=True))
            for p, u, c in ((1, "u", 0.5), (2, None, 0.25), (4, None, None))}
    lists = {}
    for p, v, e, x in found:
        band = None if e is None else e // 8
        lists.setdefault((p, 1, band), []).append((-1 if e is None else e, x, -1 if v is None else v, v))
    for (p, section, band), own in lists.items():
        for part in range(-(-len(own) // 2)):
            want.add((p, section, band, part))
    texts = {}
    for p, v, y in set(seen):
        shown = {e for q, w, e, _ in found if p is not None and q == p and v is not None and (w == v or (q == 3 and v == 6 and w is not None))}
        for band in {None if e is None else e // 8 for e in shown} or {None}:
            inside = sorted(e for e in shown if e is not None and e // 8 == band)
            texts.setdefault((p, 2, v, band or 0), []).append({"id": f"viewport-{'null' if v is None else v}", "viewport_index": v, "scroll_y": y, "elements": inside})
    want |= {(*k, json.dumps(t, sort_keys=True)) for k, all_of in texts.items() for t in all_of}
    assert {g for g in got if g[1] != 1} | {g[:4] for g in got if g[1] == 1} == want
    for key, own in lists.items():
        parts = [json.loads(g[4]) for g in sorted((g for g in got if g[:3] == key), key=lambda g: g[3])]
        assert all(0 < len(part) <= 2 for part in parts)
        flat = [e for part in parts for e in part]
        assert [(-1 if e["element_index"] is None else e["element_index"], e["x"]) for e in flat] == [o[:2] for o in sorted(own)]
        assert sorted(str(e["viewports"]) for e in flat) == sorted(str([] if o[3] is None else [o[3], 6] if key[0] == 3 else [o[3]]) for o in own)

    known = boxes.filter("page_id IS NOT NULL AND element_index IS NOT NULL")
    rows = O.evidence_package(pages, known, shots.filter("page_id IS NOT NULL AND viewport_index IS NOT NULL"), metrics, band=8, most=2)
    sinks.write_in_order(rows, ["page_id", "section", "place", "part"], "json", f"{tmp_path}/out", dealt=True)
    lines = [line.split("\t", 4) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    keys = [tuple(map(int, line[:4])) for line in lines]
    assert keys == sorted(keys) and len(lines) == rows.count()


def test_boxes_that_lie_together_are_deduplicated_where_they_are(spark):
    from sitegauge.operators import elements as E
    boxes = spark.range(600).selectExpr(
        "IF(id % 5 = 0, id % 3, 7) AS page_id", "id % 9 AS element_index", "id AS seq", "IF(id % 4 = 0, NULL, concat('t', id % 3)) AS element_type",
        "IF(id % 11 = 0, NULL, (id % 6) / 10D) AS confidence", "CAST(id % 2 AS INT) AS viewport_index", "(id % 8) / 4D AS x", "IF(id % 13 = 0, NULL, id % 2) AS y",
        "id AS w", "id AS h")
    dealt = E.dedupe_boxes(E.together(boxes))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan
    assert sorted(map(str, dealt.collect())) == sorted(map(str, E.dedupe_boxes(boxes).collect()))


def test_interval_union_shuffles_its_ranges_once(spark):
    from sitegauge.operators import evidence as V
    ranges = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 30_000, 30_010), (2, 4, 4), (None, 1, 3), (3, None, 3), (1, 0, 12), (1, None, 7)],
                                   "page_id LONG, start LONG, stop LONG")
    rows = V.interval_union(ranges)
    assert {r.page_id: r.covered for r in rows.collect()} == {1: 30, 2: 0}
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_compressed_parts_are_one_file_in_order(spark, tmp_path):
    import gzip

    from sitegauge.sources import sinks
    rows = spark.range(3000).select(F.col("id") % 7, F.col("id").alias("place"), F.format_string("[%d]", "id").alias("json")).toDF("page_id", "place", "json")
    sinks.write_in_order(rows, ["page_id", "place"], "json", f"{tmp_path}/out", "gzip")
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*.gz")))
    assert gzip.decompress(whole).decode().splitlines() == [f"{i % 7}\t{i}\t[{i}]" for i in sorted(range(3000), key=lambda i: (i % 7, i))]
    assert sorted(sinks.read_documents(spark, f"{tmp_path}/out", rows.schema).collect()) == sorted(rows.collect())


def test_evidence_package_dedupes_boxes_once(spark, data, monkeypatch):
    from sitegauge.plans import output_queries as Q
    tables, real = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df: tables.append(df.columns) or real(df))
    calls, dedupe = [], Q.E.dedupe_boxes
    monkeypatch.setattr(Q.E, "dedupe_boxes", lambda boxes: calls.append(1) or dedupe(boxes))
    Q.evidence_package(Tables(spark, data))
    assert len(calls) == 1 and ["page_id", "element_index"] == tables[0][:2]


def scans(df, name):
    return len(re.findall(rf"FileScan parquet[^\n]*{name}", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize(("name", "table", "most"), [
    ("route_failures", "events", 2), ("should_verify", "events", 2), ("termination_reason", "events", 2), ("failure_streaks", "events", 2),
    ("confidence_decay", "events", 2), ("detect_failures", "events", 2), ("dedupe_insights", "orders", 2), ("insight_evidence", "orders", 4),
    ("hypotheses", "orders", 2), ("export_report_md", "orders", 6), ("failed_combos", "events", 1), ("visit_counts", "events", 1)])
def test_few_scans(spark, data, name, table, most):
    assert scans(QUERIES[name](spark, data), f"{table}.parquet") <= most


def test_metrics_read_pages_once(spark, data):
    assert scans(QUERIES["evidence_metrics"](spark, data), "lineitem.parquet") <= 3


def test_steps_are_numbered_over_chunks(spark, data, monkeypatch):
    monkeypatch.setattr("sitegauge.sources.tables.EVENT_CHUNK", 37)
    t = Tables(spark, data)
    plain = t.actions.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")))
    want = {(r.event_id, r.step) for r in plain.collect()}
    assert {(r.event_id, r.step) for r in t.steps().collect()} == want


def test_streaks_in_one_pass(spark):
    log = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("run_id"), "id",
                                   (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("bad"), (F.col("id") % 91 == 7).alias("done"))
    w = Window.partitionBy("run_id").orderBy("id")
    log = log.withColumn("step", F.row_number().over(w).cast("long")).cache()
    so_far = Window.partitionBy("run_id").orderBy("step")
    T_cut, T.STEP_CHUNK = T.cut, 10
    try:
        T.cut = lambda width=10: T_cut(width)
        got = T.streaks(log, F.col("bad"), "n", "all", {"last_done": F.col("done")}).select("run_id", "step", "n", "all", "last_done")
    finally:
        T.cut = T_cut
    good = F.max(F.when(~F.col("bad"), F.col("step"))).over(so_far)
    want = log.select("run_id", "step", (F.col("step") - F.coalesce(good, F.lit(0))).alias("n"), F.sum(F.col("bad").cast("int")).over(so_far),
                      F.max(F.when(F.col("done"), F.col("step"))).over(so_far))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_buckets_grow_with_the_cluster(spark):
    df = spark.range(10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 5000)
        assert chunks.buckets_for(df) == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from sitegauge.sources import shared

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())

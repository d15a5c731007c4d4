"""Chunked scans must equal plain windows, also when one key holds a third of the rows and has many chunks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegauge.operators import steps as O
from sitegauge.plans import chunks


@pytest.fixture(scope="module")
def rows(spark):
    """Key 0 holds a third of 3000 rows; values repeat and some are NULL."""
    n = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1))
    return n.withColumn("v", F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(50)))).cache()


def cut():
    return [chunks.by_width(F.col("id"), 17)]


def plain():
    return Window.partitionBy("k").orderBy("id")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_row_index(rows):
    same(chunks.row_index(rows, ["k"], ["id"], cut(), "n").select("id", "n"),
         rows.select("id", F.row_number().over(plain()).alias("n")))


def test_running_sum_and_total(rows):
    got = chunks.running_sum(rows, ["k"], ["id"], cut(), F.coalesce("v", F.lit(0)), "s", "t").select("id", "s", "t")
    value = F.coalesce("v", F.lit(0))
    same(got, rows.select("id", F.sum(value).over(plain()).alias("s"), F.sum(value).over(Window.partitionBy("k")).alias("t")))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_max(rows, inclusive):
    frame = plain().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same(chunks.running_max(rows, ["k"], ["id"], cut(), F.col("v"), "m", inclusive).select("id", "m"),
         rows.select("id", F.max("v").over(frame).alias("m")))


def test_previous_keeps_nulls(rows):
    same(chunks.previous(rows, ["k"], ["id"], cut(), {"p": "v", "pid": "id"}).select("id", "p", "pid"),
         rows.select("id", F.lag("v").over(plain()).alias("p"), F.lag("id").over(plain()).alias("pid")))


def test_order_by_value_then_position(rows):
    down = rows.withColumn("d", -F.coalesce("v", F.lit(-1)))
    got = chunks.row_index(down, ["k"], ["d", "id"], [F.col("d"), *cut()], "n").select("id", "n")
    same(got, down.select("id", F.row_number().over(Window.partitionBy("k").orderBy("d", "id")).alias("n")))


def test_key_totals(rows):
    got = chunks.key_totals(rows, ["k"], {"n": F.sum("_n")}, {"_n": F.count("*")}).select("id", "n")
    same(got, rows.select("id", F.count("*").over(Window.partitionBy("k")).alias("n")))


def walk(steps, met, goals, patience=5):
    """One run, step by step."""
    goal = spent = 0
    for step in steps:
        if goal < goals:
            spent += 1
            if met(goal, step):
                goal, spent = goal + 1, 0
            elif spent >= patience:
                goal, spent = goal + 1, 0
        yield step, goal, spent


@pytest.mark.parametrize("patience", [1, 2, 5, 30])
def test_subgoals_of_long_runs(spark, patience):
    log = [(r, s, f"https://x/{'cart' if (s * 7 + r) % 11 == 0 else 'p'}", f"Page {s % 4}", "Welcome" if s % 13 == r else "-")
           for r in range(3) for s in range(1, 61)]
    df = spark.createDataFrame(log, "run_id BIGINT, step BIGINT, url STRING, title STRING, ax_text STRING")
    got = {(r.run_id, r.step): (r.goal, r.spent) for r in O.subgoal_progress(
        df, ["url contains cart", "title contains 'page 2'", 'sees "welcome"'], patience).collect()}
    assert len(got) == len(log)
    tests = [lambda x: "cart" in x[2], lambda x: "page 2" in x[3].lower(), lambda x: "welcome" in x[4].lower()]
    for run in range(3):
        mine = [x for x in log if x[0] == run]
        for x, goal, spent in walk(mine, lambda g, x: tests[g](x), 3, patience):
            assert got[(run, x[1])] == (goal, spent)


def test_replay_of_a_long_log(spark):
    """Hits do not refresh the entry, so misses chain, over chunk borders too."""
    from sitegauge.operators.sites import cache_replay
    times = sorted({(i * i * 37) % 30_000_000 for i in range(400)} | set(range(9_999_000, 10_003_000, 250)))
    df = spark.createDataFrame([(i, "a", s) for i, s in enumerate(times)], "page_id BIGINT, domain STRING, second BIGINT")
    got = {r.page_id: r.hit for r in cache_replay(df, "page_id").collect()}
    stored = None
    for i, s in enumerate(times):
        hit = stored is not None and s - stored <= 1800
        stored = stored if hit else s
        assert got[i] == hit, (i, s)


def test_interval_union_property(spark):
    import random

    from sitegauge.operators.evidence import interval_union
    rng = random.Random(5)
    data = [(p, a, a + rng.randint(0, 90)) for p in range(3) for a in [rng.randint(0, 2000) for _ in range(80)]]
    got = {r.page_id: r.covered for r in interval_union(
        spark.createDataFrame(data, "page_id BIGINT, start BIGINT, stop BIGINT"), 100).collect()}
    for p in range(3):
        assert got[p] == len({x for q, a, b in data if q == p for x in range(a, b)})

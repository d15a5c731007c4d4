"""Insights: checking, merging duplicates, ranking, scoring and turning them into hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.lookup import contains_any, map_value
from ..functions.text import title_case
from ..plans import chunks
from ..rules import insights as R
from ..sources.shared import written
from ..sources.tables import INSIGHT_CHUNK

SEPARATOR = " | "


def dedupe_key() -> Column:
    element = F.coalesce("element", F.lit(""))
    return F.coalesce(F.nullif("heuristic_id", F.lit("")), F.concat(
        F.lower(F.trim("type")), F.lit("|"), F.lower(F.trim(element))))


def evidence_texts(insights: DataFrame) -> DataFrame:
    """The texts that make up the joined evidence of a page and key, one row each in the order of ``seq``.

    A text is left out when it equals all that has been joined so far, with ' | ' between. That holds for the copies of the first
    text, until another comes; after that only for a text that holds the separator and is as long as what is joined.

    So that no group must be joined to tell, each row first gets a length that the joined text has at least: a text without a
    separator always adds its own, and of two different neighbours that hold one at least one is added, so half the shorter is
    counted. Beyond the key's longest text with a separator nothing can be left out. The runs of equal texts before that
    point go to ``_left_out`` as lengths and hashes. Runs a job for those when it is called.
    """
    keys, cut = ["page_id", "dedupe_key"], [chunks.by_width(F.col("seq"), INSIGHT_CHUNK)]
    texts = insights.withColumn("dedupe_key", dedupe_key()).filter(F.coalesce("evidence_text", F.lit("")) != "").select(
        *keys, "seq", F.col("evidence_text").alias("text"))
    c = chunks.Chunked(texts, keys, ["seq"], cut)
    last = F.lag("text").over(c.local)
    c.df = c.df.withColumns({"_own": F.first("text").over(c.local), "_holds": F.contains("text", F.lit(SEPARATOR)),
                             "_last": last, "_new": F.coalesce(last != F.col("text"), F.lit(True))})
    c.df = c.df.withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(c.so_far()))  # runs of equal texts in the chunk
    change, length = F.when(F.col("text") != F.col("_own"), F.col("seq")), F.length("text") + len(SEPARATOR)
    either = F.col("_new") & (F.col("_run") > 2) & F.contains("_last", F.lit(SEPARATOR))
    adds = F.when(~F.col("_holds"), length).when(either, F.floor(F.least(length, F.length("_last") + len(SEPARATOR)) / 2)).otherwise(0)
    rows = c.attach(
        {"_f": F.min_by(F.struct("seq", "text"), "seq"), "_d": F.min(change), "_m": F.max(F.when(F.col("_holds"), F.length("text"))),
         "_l": F.sum(adds), "_r": F.sum(F.when(F.col("_run") == 1, adds).otherwise(0))},
        {"_first": lambda b, w: F.first("_f").over(w),
         "_change": lambda b, w: F.when(F.col("_f.text") != F.col("_first.text"), F.col("_f.seq")).otherwise(F.col("_d")),
         "_from": lambda b, w: F.min("_change").over(w), "_longest": lambda b, w: F.coalesce(F.max("_m").over(w), F.lit(0)),
         "_added": lambda b, w: F.when(F.col("_f.seq") >= F.col("_from"), F.col("_l")).otherwise(F.col("_l") - F.col("_r")),
         "_before": lambda b, w: F.coalesce(F.sum("_added").over(b), F.lit(0))})
    is_first, later = F.col("seq") == F.col("_first.seq"), F.coalesce(F.col("seq") >= F.col("_from"), F.lit(False))
    own = F.when(later, adds).otherwise(0)
    least = F.length("_first.text") + F.col("_before") + F.sum(own).over(c.so_far()) - own
    rows = rows.withColumns({"_open": later & (least <= F.col("_longest")), "_kept": is_first | later})
    runs = written(rows.filter("_open").groupBy(*keys, *c.cuts, "_run").agg(
        F.min("seq").alias("seq"), F.count("*").alias("n"), F.first("text").alias("text"), F.first("_first.text").alias("begin")))
    dropped = _left_out(runs, keys).groupBy(*keys, *c.cuts).agg(F.collect_set("_run").alias("_runs"))
    rows = rows.filter("_kept").join(dropped, [*keys, *c.cuts], "left")
    return rows.filter(~F.coalesce(F.col("_open") & F.array_contains("_runs", F.col("_run")), F.lit(False))).select(*keys, "seq", "text")


# The prime that hashes are taken by, and the base of each of the two.
PRIME, BASES = 2_147_483_647, (1_000_003, 998_244_353)


def _rolled(text: Column) -> Column:
    """Per base the polynomial hash of a text, and the base to the power of its length: what its place in a longer text
    needs. The text is not empty."""
    def add(acc, digit):
        return F.struct(*[field for i, base in enumerate(BASES) for field in (
            ((acc[f"h{i}"] * base + F.ascii(digit)) % PRIME).alias(f"h{i}"), (acc[f"p{i}"] * base % PRIME).alias(f"p{i}"))])
    return F.aggregate(F.split(F.hex(text), ""), _nothing(), add)


def _nothing() -> Column:
    return F.struct(*[F.lit(v).cast("bigint").alias(f"{k}{i}") for i in range(len(BASES)) for k, v in (("h", 0), ("p", 1))])


def _then(a: Column, b: Column) -> Column:
    """Hash of one text followed by another; associative."""
    return F.struct(*[field for i in range(len(BASES)) for field in (
        ((a[f"h{i}"] * b[f"p{i}"] + b[f"h{i}"]) % PRIME).alias(f"h{i}"), (a[f"p{i}"] * b[f"p{i}"] % PRIME).alias(f"p{i}"))])


def _times(a: Column, n: Column) -> Column:
    """Hash of a text written n times, by doubling."""
    return F.aggregate(F.split(F.bin(n), ""), _nothing(), lambda acc, bit: F.when(
        bit == "1", _then(_then(acc, acc), a)).otherwise(_then(acc, acc)))


def _left_out(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Those of the ``runs`` (n equal texts each) of a key that equal all joined before them, ``begin`` being the first text.

    What is joined is carried as its length and hash, so a key is folded as one number set per run, of which there are no more
    than its longest text has characters. Each run found is then held against the joined text itself, which is as
    long as the run's text; were they to differ, the query fails.
    """
    hashed = runs.withColumns({"_own": _rolled(F.col("text")), "_part": _rolled(F.concat(F.lit(SEPARATOR), "text"))})
    ordered = F.array_sort(F.collect_list(F.struct(
        "seq", "n", F.length("text").cast("bigint").alias("length"), F.col("_own").alias("own"), _times(F.col("_part"), F.col("n")).alias("parts"))))
    groups = hashed.groupBy(*keys).agg(F.first("begin").alias("begin"), ordered.alias("runs"))
    start = F.struct(F.length("begin").cast("bigint").alias("length"), _rolled(F.col("begin")).alias("hash"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        same = (acc["length"] == x["length"]) & (acc["hash"] == x["own"])
        return F.when(same, F.struct(acc["length"].alias("length"), acc["hash"].alias("hash"), F.concat(
            acc["out"], F.array(x["seq"])).alias("out"))).otherwise(F.struct(
                (acc["length"] + x["n"] * (x["length"] + len(SEPARATOR))).alias("length"),
                _then(acc["hash"], x["parts"]).alias("hash"), acc["out"].alias("out")))

    found = written(groups.select(*keys, F.explode(F.aggregate("runs", start, step)["out"]).alias("seq")).join(runs, [*keys, "seq"]))
    added = runs.join(found.select(*keys, "seq"), [*keys, "seq"], "left_anti").select(
        *keys, F.col("seq").alias("_at"), F.repeat(F.concat(F.lit(SEPARATOR), "text"), F.col("n").cast("int")).alias("_piece"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("_at") < F.col("seq"), F.struct("_at", "_piece"))))
    whole = F.concat(F.first("begin"), F.array_join(F.transform(pieces, lambda x: x["_piece"]), ""))
    held = found.join(added, keys, "left").groupBy(*keys, *[c for c in found.columns if c not in (*keys, "n", "text", "begin")]).agg(
        F.first("text").alias("text"), whole.alias("_whole"))
    return held.filter(F.when(F.col("text") == F.col("_whole"), True).otherwise(
        F.raise_error(F.lit("two texts of one hash differ: change BASES"))))


def dedupe_insights(insights: DataFrame) -> DataFrame:
    """First insight per page and key, with the first selector and the first screenshot; one row per key, folded before the
    shuffle. All its evidence texts are the rows of ``evidence_texts``."""
    rows = insights.withColumn("dedupe_key", dedupe_key())
    fields = ["seq", "severity", "category", "type", "element", "issue", "recommendation", "heuristic_id", "confidence", "source"]
    firsts = {c: F.nullif(c, F.lit("")) for c in ("evidence_selector", "evidence_screenshot")}
    base = rows.groupBy("page_id", "dedupe_key").agg(
        F.min_by(F.struct(*fields), "seq").alias("f"), F.count("*").alias("merged"),
        *[F.min_by(v, F.when(v.isNotNull(), F.col("seq"))).alias(c) for c, v in firsts.items()])
    return base.select("page_id", "dedupe_key", "f.*", "merged", *firsts)


def merge_styles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value per style name of ``styles MAP``, as one row per name."""
    return rows.select(*keys, "seq", F.explode("styles").alias("style", "value")).groupBy(*keys, "style").agg(
        F.max_by("value", "seq").alias("value"))


def adjust_severity(insights: DataFrame) -> DataFrame:
    """Raise severity by what matters to the ``business_type`` of the row, at most to critical."""
    texts = [F.lower("type"), F.lower("category"), F.lower("issue")]

    def says(words):
        return reduce(lambda a, b: a | b, [contains_any(x, words) for x in texts])

    boost = F
    for business, words in R.SEVERITY_BOOSTS.items():
        for steps in (2, 1):
            some = [w for w, s in words.items() if s == steps]
            if some:
                boost = boost.when((F.col("business_type") == business) & says(some), steps)
    level = F.least(F.lit(4), N.severity_rank(F.col("severity")) + boost.otherwise(0))
    return insights.withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in reversed(R.SEVERITIES)]), level))


def is_critical_type() -> Column:
    return reduce(lambda a, b: a | b, [
        (F.col("business_type") == b) & F.col("type").isin(types) for b, types in R.CRITICAL_TYPES.items() if types])


def prioritize(insights: DataFrame) -> DataFrame:
    """Score of each insight and its place on the page; equal scores keep their order."""
    score = (N.severity_rank(F.col("severity")) * 100 + F.when(is_critical_type(), 50).otherwise(0)
             + F.coalesce(F.col("confidence") * 10, F.lit(0.0)))
    rows = insights.withColumn("score", score).withColumn("_down", -F.col("score"))
    return chunks.row_index(rows, ["page_id"], ["_down", "seq"], value_cut(F.col("_down"), 1000), "place").drop("_down")


def value_cut(value: Column, per_unit: int, width: int = INSIGHT_CHUNK) -> list[Column]:
    """Cuts of rows ordered by a number, then ``seq``: by its steps of 1 / ``per_unit``, a bounded number of them however many
    different numbers there are; rows that stand on a step, where equal numbers gather, are cut further by position."""
    nearest, below = F.round(value * per_unit), F.floor(value * per_unit)
    on_step = value == nearest / per_unit
    step = F.when(on_step, nearest).when(below / per_unit > value, below - 1).otherwise(below)
    return [step, (~on_step).cast("int"), F.when(on_step, chunks.by_width(F.col("seq"), width)).otherwise(0)]


def hypotheses(insights: DataFrame) -> DataFrame:
    """Tests for the severe insights: numbered in their order, placed by priority."""
    rows = insights.filter(F.col("severity").isin("critical", "high")).withColumn(
        "priority", map_value(F.col("severity"), R.SEVERITY_PRIORITY))
    levels = sorted({R.SEVERITY_PRIORITY[x] for x in ("critical", "high")}, reverse=True)
    # Number and place come from one pass: rows so far, rows so far of the same priority, and all rows of higher ones.
    c = chunks.Chunked(rows, ["page_id"], ["seq"], [chunks.by_width(F.col("seq"), INSIGHT_CHUNK)])
    sums = {"_all": F.count("*"), **{f"_p{p}": F.count_if(F.col("priority") == p) for p in levels}}
    rows = c.attach(sums, {**{f"{n}_before": (lambda b, w, n=n: F.coalesce(F.sum(n).over(b), F.lit(0))) for n in sums},
                           **{f"{n}_total": (lambda b, w, n=n: F.sum(n).over(w)) for n in sums}})
    so_far = c.so_far()
    place = F
    for i, p in enumerate(levels):
        higher = reduce(lambda a, b: a + b, [F.col(f"_p{q}_total") for q in levels[:i]], F.lit(0))
        same = F.col(f"_p{p}_before") + F.count_if(F.col("priority") == p).over(so_far)
        place = place.when(F.col("priority") == p, higher + same)
    metric = map_value(F.col("category"), R.CATEGORY_METRIC, R.CATEGORY_METRIC["custom"])
    rows = rows.withColumns({"number": F.col("_all_before") + F.count("*").over(so_far), "place": place, "metric": metric})
    number = F.col("number").cast("string")
    return rows.select(
        "page_id", "seq", "place", F.concat(F.lit("H-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"),
        F.concat(F.lit("Fix "), title_case(F.col("type"))).alias("title"),
        F.concat(F.lit("If we "), F.lower("recommendation"), F.lit(", then "), F.lower("metric"),
                 F.lit(" will improve because "), F.lower("issue")).alias("hypothesis"),
        F.concat(F.lit("Current state: "), "issue").alias("control"), F.col("recommendation").alias("treatment"),
        F.col("metric").alias("primary_metric"), map_value(F.col("severity"), R.SEVERITY_IMPACT).alias("impact"), "priority")


# ---------------------------------------------------------------- scores

def deduction() -> Column:
    return map_value(F.col("severity"), R.SEVERITY_DEDUCTION, 0)


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in R.SEVERITIES]


def score_overall(pages: DataFrame, insights: DataFrame) -> DataFrame:
    """100 less a blend of weighted and plain deductions, in whole numbers; 100 for a page without insights."""
    weight = map_value(F.col("category"), R.CATEGORY_WEIGHT_TENTHS, R.OTHER_WEIGHT_TENTHS)
    sums = insights.groupBy("page_id").agg(
        F.sum(deduction()).alias("plain"), F.sum(deduction() * weight).alias("tenths"), *severity_counts())
    rows = pages.select("page_id").join(sums, "page_id", "left").fillna(0)
    lost = F.when(F.col("tenths") == F.col("plain") * 10, F.col("plain")).otherwise(
        F.floor((F.col("tenths") * 7 + F.col("plain") * 30 + 50) / 100))
    return rows.withColumn("overall", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost))).drop("plain", "tenths")


def score_by_category(insights: DataFrame) -> DataFrame:
    return insights.groupBy("page_id", "category").agg(
        F.greatest(F.lit(0), 100 - F.sum(deduction())).alias("score"))


def score_default(insights: DataFrame) -> DataFrame:
    """Plain score, with the number of insights per category as its detail."""
    return insights.groupBy("page_id").agg(
        F.greatest(F.lit(0), 100 - F.sum(deduction())).alias("overall"),
        *[F.count_if(F.col("category") == c).alias(f"{c}_insights") for c in R.CATEGORIES])


# ---------------------------------------------------------------- checks

def insight_violations() -> dict[str, Column]:
    return {"issue": F.length("issue") < 10, "recommendation": F.length("recommendation") < 10,
            "severity": ~F.col("severity").isin(R.SEVERITIES), "category": ~F.col("category").isin(R.CATEGORIES),
            "element": F.col("element").isNull(),
            "confidence": F.coalesce(~F.col("confidence").between(0, 1), F.lit(False))}


def hypothesis_violations() -> dict[str, Column]:
    def outside(name, low, high):
        return ~F.length(name).between(low, high)

    return {"id": ~F.col("id").rlike(r"^H-\d{3}$"), "title": outside("title", 5, 100), "hypothesis": outside("hypothesis", 20, 500),
            "control": outside("control", 10, 300), "treatment": outside("treatment", 10, 300),
            "primary_metric": outside("primary_metric", 3, 50), "impact": ~F.col("impact").isin("low", "medium", "high"),
            "priority": ~F.col("priority").between(1, 10)}


def recorded_violations() -> dict[str, Column]:
    """Limits of an insight recorded by hand."""
    return {"type": ~F.length("type").between(1, 50), "severity": ~F.col("severity").isin(R.SEVERITIES),
            "issue": ~F.length("issue").between(10, 500), "recommendation": ~F.length("recommendation").between(10, 500)}


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows per key and how many break each rule."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"bad_{n}") for n, c in rules.items()])

"""Model evaluations of heuristics: parsing, joining with the knowledge, merging and comparing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import replies as RP
from ..functions import text as S
from ..functions.lookup import map_value
from ..plans import chunks
from ..rules import heuristics as H
from ..rules import insights as R

# ---------------------------------------------------------------- replies


def parsed_replies(replies: DataFrame, keys: list[str], json: Column) -> DataFrame:
    """One row per evaluation of a reply as ``e``; a reply that is malformed or holds no list of evaluations
    gives one row without. The reply is parsed once for both."""
    schema = f"{RP.EVALUATIONS_SCHEMA},_malformed STRING"
    parsed = replies.select(*keys, F.from_json(json, schema, {"columnNameOfCorruptRecord": "_malformed"}).alias("p"))
    read = F.when(F.col("p._malformed").isNull(), F.col("p.evaluations"))
    return parsed.select(*keys, read.isNull().alias("unreadable"), F.posexplode_outer(read).alias("pos", "e"))


def reply_evaluations(parsed: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Evaluations with status and confidence read. Strict drops unknown statuses and reads percents; the lenient
    form turns unknown statuses into not_applicable and only clamps. Unreadable replies stay as a NULL row."""
    status = S.normalize_status(F.col("e.status"), strict)
    confidence = N.normalize_confidence(F.col("e.confidence")) if strict else N.clamp01(F.col("e.confidence"))
    rows = parsed.select(
        *keys, "unreadable", "pos", F.col("e.heuristicId").alias("heuristic_id"),
        F.when(~F.col("unreadable"), status).alias("status"), F.when(~F.col("unreadable"), confidence).alias("confidence"),
        F.when(~F.col("unreadable"), F.coalesce(F.nullif("e.observation", F.lit("")), F.lit("No observation provided"))).alias("observation"),
        F.nullif("e.issue", F.lit("")).alias("issue"), F.nullif("e.recommendation", F.lit("")).alias("recommendation"))
    issue = F.col("status").isin("fail", "partial")
    out = rows.withColumns({"issue": F.when(issue, F.col("issue")), "recommendation": F.when(issue, F.col("recommendation"))})
    known = (F.col("heuristic_id") != "") & F.col("status").isNotNull()
    return out.filter(F.col("unreadable") | known) if strict else out


def batched_evaluations(replies: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Replies keyed by category. A category without evaluations gives one row with NULL evaluation."""
    inner = "STRUCT<evaluations:ARRAY<STRUCT<heuristicId:STRING,status:STRING,confidence:DOUBLE>>,summary:STRING>"
    by_name = F.from_json(RP.extract_json(F.col("response")), f"MAP<STRING,{inner}>")
    rows = replies.withColumn("_by", by_name).select(*keys, F.explode(F.array(*[F.struct(
        F.lit(c).alias("category"), F.try_element_at("_by", F.lit(c)).alias("c")) for c in categories])).alias("x"))
    rows = rows.select(*keys, "x.category", F.explode_outer("x.c.evaluations").alias("e"))
    return rows.select(*keys, "category", F.col("e.heuristicId").alias("heuristic_id"),
                       F.when(F.col("e").isNotNull(), S.normalize_status(F.col("e.status"), False)).alias("status"),
                       F.col("e").isNull().alias("missing"))


# ---------------------------------------------------------------- knowledge


def enrich(evaluations: DataFrame, heuristics: DataFrame, lenient: bool = False) -> DataFrame:
    """Severity and principle of the heuristic. Unknown ids are dropped, or kept as medium when lenient."""
    facts = heuristics.select("heuristic_id", F.col("severity").alias("_severity"), F.col("principle").alias("_principle"))
    rows = evaluations.drop("severity", "principle").join(facts, "heuristic_id", "left" if lenient else "inner")
    return rows.withColumns({"severity": F.coalesce("_severity", F.lit("medium")),
                             "principle": F.coalesce("_principle", F.lit(""))}).drop("_severity", "_principle")


def missing_heuristics(evaluations: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Ids that a key has no evaluation for. A key holds at most the known ids, so its set is small."""
    wanted = F.array(*[F.lit(i) for i in ids])
    known = F.when(F.col("heuristic_id").isin(ids), F.col("heuristic_id"))
    return evaluations.groupBy(*keys).agg(F.collect_set(known).alias("seen")).select(
        *keys, F.array_except(wanted, "seen").alias("missing"))


def fill_missing(evaluations: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Evaluations plus a not_applicable row of confidence 0 for each id without one."""
    gaps = missing_heuristics(evaluations, keys, ids).select(
        *keys, F.explode("missing").alias("heuristic_id"), F.lit("not_applicable").alias("status"), F.lit(0.0).alias("confidence"))
    return evaluations.select(*keys, "heuristic_id", "status", "confidence").unionByName(gaps)


# ---------------------------------------------------------------- checks and merges


def cross_validate(evaluations: DataFrame, boxes: DataFrame) -> DataFrame:
    """Claims of absence that the page contradicts, with halved confidence to two digits."""
    counts = boxes.filter(F.col("element_type").isNotNull()).groupBy("page_id", "element_type").agg(F.count("*").alias("found"))
    kind = map_value(S.heuristic_prefix(F.col("heuristic_id")), R.HEURISTIC_ELEMENT)
    claims = evaluations.filter(F.col("status").isin("fail", "not_applicable")).withColumn("element_type", kind).filter(
        F.col("element_type").isNotNull() & F.concat_ws(" ", "observation", "issue").rlike(R.ABSENCE_CLAIM))
    cents = F.round(F.col("confidence") * 100).cast("bigint")
    return chunks.salted_join(claims, counts, ["page_id", "element_type"]).withColumn(
        "new_confidence", (cents + F.when(cents % 2 == 1, 1).otherwise(0)) / 2 / 100)


def evaluation_refs(evaluations: DataFrame) -> DataFrame:
    """One row per [vN-M] reference in the texts of an evaluation."""
    texts = F.concat_ws(" ", "observation", "issue", "recommendation")
    return evaluations.withColumn("_ref", F.explode(S.viewport_refs(texts))).select(
        "*", F.col("_ref.viewport_index").alias("ref_viewport"), F.col("_ref.element_index").alias("ref_element"),
        F.col("_ref.ref").alias("ref")).drop("_ref")


def resolve_refs(evaluations: DataFrame, elements: DataFrame) -> DataFrame:
    """References with the type of the element they name, 'unknown' when it is not there."""
    known = elements.groupBy("page_id", F.col("viewport_index").alias("ref_viewport"), F.col("element_index").alias("ref_element")).agg(
        F.max_by("element_type", "seq").alias("element_type"))
    return evaluation_refs(evaluations).join(known, ["page_id", "ref_viewport", "ref_element"], "left").withColumn(
        "element_type", F.coalesce("element_type", F.lit("unknown")))


def element_status(evaluations: DataFrame) -> DataFrame:
    """Status of the first evaluation that cites an element, and the distinct ids that do."""
    rows = evaluation_refs(evaluations)
    return rows.groupBy("page_id", "ref_viewport", "ref_element").agg(
        F.min_by("status", "seq").alias("status"), F.array_sort(F.collect_set("heuristic_id")).alias("heuristics"))


def merge_viewports(evaluations: DataFrame) -> DataFrame:
    """Best evaluation per page and heuristic: highest confidence, the earlier of equals."""
    cols = ["viewport_index", "status", "severity", "confidence", "seq"]
    best = evaluations.groupBy("page_id", "heuristic_id").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("confidence"), -F.col("seq"))).alias("b"), F.count("*").alias("merged"))
    return best.select("page_id", "heuristic_id", "b.*", "merged")


def status_counts() -> list[Column]:
    issue = F.col("status").isin("fail", "partial")
    return [*[F.count_if(F.col("status") == s).alias(n) for s, n in (
        ("pass", "passed"), ("fail", "failed"), ("partial", "partial"), ("not_applicable", "not_applicable"))],
        *[F.count_if(issue & (F.col("severity") == s)).alias(f"{s}_issues") for s in R.SEVERITIES]]


def evaluation_summary(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("page_id").agg(F.count("*").alias("total"), *status_counts())


def merge_summary(evaluations: DataFrame) -> DataFrame:
    """Summary of the merged evaluations with the share that merging removed."""
    merged = merge_viewports(evaluations)
    return merged.groupBy("page_id").agg(
        F.count("*").alias("total"), *status_counts(),
        ((F.sum("merged") - F.count("*")) / F.sum("merged")).alias("dedup_rate"))


def issue_order(evaluations: DataFrame) -> DataFrame:
    """Fail and partial evaluations of a page with the order keys of its issue list."""
    return evaluations.filter(F.col("status").isin("fail", "partial")).withColumns({
        "severity_turn": 4 - N.severity_rank(F.col("severity")), "confidence_turn": -F.col("confidence")})


def compare_runs(evaluations: DataFrame, baseline: str = "baseline", optimized: str = "optimized") -> DataFrame:
    """Last evaluation per page and heuristic in each run, side by side. One pass instead of a join."""
    def last(run):
        return F.max_by(F.when(F.col("run") == run, F.struct("status", "confidence")), F.when(F.col("run") == run, F.col("seq")))

    rows = evaluations.groupBy("page_id", "heuristic_id").agg(last(baseline).alias("b"), last(optimized).alias("o"))
    verdict = (F.when(F.col("b").isNull(), "missing_in_baseline").when(F.col("o").isNull(), "missing_in_optimized")
               .when(F.col("b.status") == F.col("o.status"), "match").otherwise("differs"))
    return rows.select("page_id", "heuristic_id", F.col("b.status").alias("baseline_status"), F.col("o.status").alias("optimized_status"),
                       F.col("b.confidence").alias("baseline_confidence"), F.col("o.confidence").alias("optimized_confidence"),
                       verdict.alias("verdict"))


def classify_discrepancies(compared: DataFrame) -> DataFrame:
    """Severity and likely cause of each difference."""
    b, o = F.col("baseline_status"), F.col("optimized_status")

    def between(x, y):
        return ((b == x) & (o == y)) | ((b == y) & (o == x))

    C = R.DISCREPANCY_CAUSES
    apart = F.abs(F.col("baseline_confidence") - F.col("optimized_confidence")) > 0.2
    severity = F.when(between("pass", "fail"), "critical").when(between("fail", "partial"), "major").otherwise("minor")
    cause = (F.when(between("pass", "fail"), F.when(o == "pass", C["missed"]).otherwise(C["invented"]))
             .when(between("fail", "partial"), C["fail_partial"]).when(between("pass", "partial"), C["pass_partial"])
             .when(apart, C["confidence"]).otherwise(C["other"]))
    return compared.filter(F.col("verdict") == "differs").withColumns({"discrepancy": severity, "cause": cause})


def quality_match(compared: DataFrame, least_percent: int = 80) -> DataFrame:
    """Per page: match rates, whether the optimized run passes, and why not."""
    graded = classify_discrepancies(compared).groupBy("page_id").agg(
        F.count_if(F.col("discrepancy") == "critical").alias("critical"), F.count_if(F.col("discrepancy") == "major").alias("major"))
    sums = compared.groupBy("page_id").agg(
        F.count_if(F.col("verdict").isin("match", "differs")).alias("total"), F.count_if(F.col("verdict") == "match").alias("matching"),
        F.count_if(F.col("verdict") == "missing_in_optimized").alias("missing_in_optimized"))
    rows = sums.join(graded, "page_id", "left").fillna(0, ["critical", "major"])
    kept = F.col("total") - F.col("critical") - F.col("major")
    low = (F.col("total") > 0) & (kept * 100 < least_percent * F.col("total"))
    reasons = F.concat_ws(",", F.when(low, "match rate"), F.when(F.col("critical") > 0, "critical"),
                          F.when(F.col("missing_in_optimized") > 0, "missing"))
    return rows.withColumns({
        "match_rate": F.when(F.col("total") > 0, F.col("matching") / F.col("total")).otherwise(1.0),
        "effective_rate": F.when(F.col("total") > 0, kept / F.col("total")).otherwise(1.0),
        "reasons": reasons, "passed": reasons == ""})


def match_recommendations(quality: DataFrame) -> DataFrame:
    """Advice from the mix of differences."""
    advice = F.concat_ws("; ", F.when(F.col("critical") > 0, F.format_string("review %d flipped verdict(s)", "critical")),
                         F.when(F.col("major") > 0, F.format_string("review %d change(s) of degree", "major")),
                         F.when(F.col("missing_in_optimized") > 0, F.format_string("%d heuristic(s) not evaluated, check the batches", "missing_in_optimized")))
    return quality.withColumn("advice", F.when(advice == "", "safe to use").otherwise(advice))


# ---------------------------------------------------------------- planning what to judge


def filter_categories(evaluations: DataFrame, include=(), exclude=(), min_severity: str | None = None) -> DataFrame:
    """Rows whose category name holds an included part, no excluded one, and is severe enough."""
    name = F.lower("category")
    out = evaluations
    if include:
        out = out.filter(reduce(or_, [name.contains(i.lower()) for i in include]))
    for e in exclude:
        out = out.filter(~name.contains(e.lower()))
    if min_severity:
        out = out.filter(N.severity_rank(F.col("severity")) >= R.SEVERITY_RANK[min_severity])
    return out


def _chosen(wanted: list[int], most: int) -> Column:
    """Of a page's ordered candidates ``seen`` the viewports that a category needs."""
    index = lambda v: v["viewport_index"]
    fits = F.filter("seen", lambda v: index(v).isin(wanted)) if wanted else F.col("seen")
    # A viewport without a number is no other viewport, so it is the first of a page only if there is no other.
    first = F.slice(F.concat(F.filter("seen", lambda v: index(v).isNotNull()), F.filter("seen", lambda v: index(v).isNull())), 1, 1)
    return F.transform(F.when(F.size(fits) > 0, F.slice(fits, 1, most)).otherwise(first), index)


def select_viewports(viewports: DataFrame) -> DataFrame:
    """Viewports each category needs per page: the wanted ones or all, the first ``most`` of them, and the
    first of the page when none qualifies.

    A page's candidates are the first viewports of each number that some category wants, and the first of the others; Spark cuts
    to them before the shuffle, so a page of any size has few. Categories then choose among them in the page's row."""
    named = sorted({i for wanted, _ in H.VIEWPORT_NEEDS.values() for i in wanted or []})
    most = max(m for _, m in H.VIEWPORT_NEEDS.values())
    rows = viewports.select("page_id", "viewport_index", F.when(F.col("viewport_index").isin(named), F.col("viewport_index")).alias("slot"))
    w = Window.partitionBy("page_id", "slot").orderBy("viewport_index")
    few = rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most)
    pages = few.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("viewport_index").isNotNull(), "viewport_index"))).alias("seen"))
    chosen = F.array(*[F.struct(F.lit(c).alias("category"), _chosen(wanted or [], m).alias("chosen")) for c, (wanted, m) in H.VIEWPORT_NEEDS.items()])
    each = pages.select("page_id", F.explode(chosen).alias("n"))
    return each.select("page_id", "n.category", F.posexplode("n.chosen").alias("place", "viewport_index")).select(
        "page_id", "category", "viewport_index", (F.col("place") + 1).alias("place"))


def batch_of(category: Column) -> Column:
    """Name of the batch a category is judged in: the categories of a batch, else the category alone."""
    return map_value(category, {c: " + ".join(b) for b in H.CATEGORY_BATCHES for c in b}, category)


def evaluations_to_insights(evaluations: DataFrame, heuristics: DataFrame) -> DataFrame:
    """Fail and partial evaluations as insights, in the three styles of id, type and element. Advice that a model left out
    names the heuristic's principle, if the knowledge table has it."""
    facts = heuristics.select("heuristic_id", "principle")
    rows = evaluations.drop("principle").filter(F.col("status").isin("fail", "partial")).join(facts, "heuristic_id", "left")
    issue = F.coalesce(F.nullif("issue", F.lit("")), F.col("observation"))
    viewport = F.concat(F.lit("viewport_"), F.col("viewport_index").cast("string"))
    return rows.select(
        "page_id", "seq", "heuristic_id", S.insight_category(F.col("heuristic_id")).alias("category"), "severity", "confidence",
        issue.alias("issue"), F.when(F.col("status") == "fail", "heuristic_fail").otherwise("heuristic_partial").alias("plain_type"),
        S.id_to_type(F.col("heuristic_id")).alias("type"), viewport.alias("element"),
        F.concat(viewport, F.lit("_scroll_"), (F.col("viewport_index") * 680).cast("string")).alias("scrolled_element"),
        S.default_recommendation(F.col("recommendation"), F.col("status"), F.col("principle")).alias("recommendation"),
        F.coalesce(F.nullif("recommendation", F.lit("")), F.lit("Review and address the issue")).alias("plain_recommendation"))

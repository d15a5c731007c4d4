"""Quality rules with verdicts on hosts, in DataFrame functions only.

Every whole text is measured once. A document that breaks a base rule (too short, too repetitive) is rejected. The other
rules have a strict and a loose limit. For each host and rule, the share of the host's documents that break the strict
limit is shrunk towards the share over all hosts by a beta prior, fitted to the hosts by moments; so a host with few
documents is judged mostly by the others. A host with a shrunk share above ``max_rate`` for some rule is distrusted.
The host's verdict goes back to its documents by a join: at a trusted host the loose limits hold, at a distrusted one the
strict ones. A document within the strict limits is always kept, whatever its host.

Three-word windows are compared by a 64-bit hash of their words, within one text.

Nulls: a null text has no words and so is rejected as short; a null host is a host of its own. Repeated rows count each;
an empty table gives no rows. Columns of the input that are not named here do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# A rule's name: what it measures, and the strict and the loose limit, above which it is broken.
RULES = {
    "symbols": (lambda: F.col("n_symbols") / F.col("n_words"), 0.1, 1.0),
    "dup_lines": (lambda: F.col("n_dup_lines") / F.col("n_lines"), 0.3, 0.6),
    "word_length": (lambda: F.col("word_chars") / F.col("n_words"), 12.0, 24.0),
}
MAX_RATE = 0.3
# The prior weighs as much as so many documents at most.
MOST_PRIOR = 1_000_000.0


def _repeat_words(found: Column) -> Column:
    """Words in windows of three that occur twice or more."""
    def covered(windows: Column) -> Column:
        twice = F.filter(windows, lambda x, i: x["hash"].eqNullSafe(F.get(windows, i - 1)["hash"])
                         | x["hash"].eqNullSafe(F.get(windows, i + 1)["hash"]))
        return let(F.transform(twice, lambda x: x["at"]), lambda at: F.size(F.array_distinct(F.concat(
            at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.struct(
        F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("hash"), i.alias("at")))
    return F.when(F.size(found) < 4, 0).otherwise(let(F.sort_array(windows), covered)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    base_failed) of each row."""
    text = common.whole(text_col)
    bare = F.length(F.translate(text, common.SPACES, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, common.SPACES, "") != "")
    both = let(common.words(text), lambda found: F.struct(
        F.size(found).cast("long").alias("n_words"), _repeat_words(found).alias("n_repeat_words")))
    line_counts = let(lines, lambda line: F.struct(
        F.size(line).cast("long").alias("n_lines"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines")))
    table = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), bare.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.xxhash64(text).alias("text_hash"), both.alias("w"), line_counts.alias("l"))
    table = table.select("doc_id", "host", "text_hash", "word_chars", "n_symbols", "w.*", "l.*")
    return table.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _broken(rule: str, strict: bool) -> Column:
    value, low, high = RULES[rule]
    return F.when(F.col("n_words") > 0, value() > (low if strict else high)).otherwise(False)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, <rule>_rate, distrusted): shrunk shares of documents beyond each strict limit."""
    hosts = written(measured.groupBy("host").agg(
        F.count("*").cast("double").alias("n_docs"),
        *[F.count_if(_broken(r, True)).cast("double").alias(r) for r in RULES]))
    total = hosts.agg(F.sum("n_docs"), F.sum(F.col("n_docs") ** 2), F.count("*"), *[F.sum(r) for r in RULES]).first()
    n, squares, n_hosts = total[0] or 0.0, total[1] or 0.0, total[2]
    means = {r: (total[3 + i] or 0.0) / n if n else 0.0 for i, r in enumerate(RULES)}
    spread = hosts.agg(*[F.sum(F.col("n_docs") * (F.col(r) / F.col("n_docs") - means[r]) ** 2) for r in RULES]).first()
    rates = {}
    for i, rule in enumerate(RULES):
        weight = prior_weight(n, squares, n_hosts, means[rule], spread[i] or 0.0)
        rates[rule] = (F.col(rule) + weight * means[rule]) / (F.col("n_docs") + weight)
    distrusted = reduce(lambda a, b: a | b, [rate > max_rate for rate in rates.values()])
    return hosts.select("host", F.col("n_docs").cast("long").alias("n_docs"),
                        *[rate.alias(f"{rule}_rate") for rule, rate in rates.items()], distrusted.alias("distrusted"))


def prior_weight(n: float, squares: float, n_hosts: int, mean: float, spread: float) -> float:
    """Documents that the beta prior weighs as much as: moments of the hosts' shares, with the binomial part taken off."""
    if n_hosts < 2 or not 0 < mean < 1:
        return MOST_PRIOR
    noise = mean * (1 - mean)
    between = (spread - noise * (n_hosts - 1)) / (n - squares / n)
    return MOST_PRIOR if between <= noise / (1 + MOST_PRIOR) else max(noise / between - 1, 0.0)


def judged(docs: DataFrame, max_rate: float = MAX_RATE, **names) -> DataFrame:
    """``measures`` with ``distrusted`` (the host's verdict) and ``kept``."""
    measured = written(measures(docs, **names))
    hosts = written(host_verdicts(measured, max_rate).select(F.col("host").alias("_host"), "distrusted"))
    rows = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    broken = {s: reduce(lambda a, b: a | b, [_broken(r, s) for r in RULES]) for s in (True, False)}
    bad = F.when(F.col("distrusted"), broken[True]).otherwise(broken[False])
    return rows.withColumn("kept", ~F.col("base_failed") & ~bad)


def kept_documents(docs: DataFrame, max_rate: float = MAX_RATE, id_col: str = "doc_id", host_col: str = "source",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    hosts = judged(docs, max_rate, id_col=id_col, host_col=host_col, text_col=text_col)
    key, host, text_hash = common.fresh(docs, "key", "host", "hash")
    ids = written(hosts.where("kept").select(F.col("doc_id").alias(key), F.col("host").alias(host),
                                             F.col("text_hash").alias(text_hash)).distinct())
    same = (F.col(id_col).eqNullSafe(F.col(key)) & F.col(host_col).eqNullSafe(F.col(host))
            & (F.xxhash64(common.whole(text_col)) == F.col(text_hash)))
    return docs.join(ids, same, "left_semi")

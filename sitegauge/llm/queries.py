"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import bpe, collocations, htmltext, licenses, lm, merkle, minhash, mixing, packing, quality, simhash, tokenfiles, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def byte_bpe() -> str:
    """The public tokenizer file of the queries; the operators take any path."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_mix_sources")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    rows = mixing.mixed(table(spark, directory, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    return lm.scores(table(spark, directory, "documents"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, directory, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_license_scans")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    rows = licenses.scan(table(spark, directory, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda s: s["first"])).alias("last_word"),
        labels(exact).alias("base_labels"), labels(F.filter("spans", lambda s: s["best"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0)).alias("score"))


@query("op5_html_extraction")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    return htmltext.main_texts(table(spark, directory, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_document_fingerprints")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    rows = minhash.with_next(table(spark, directory, "documents"))
    rows = rows.withColumn("edited", minhash.half_replaced(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       minhash.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = {n: minhash.likeness(F.col("fingerprint"), F.col(f"{n}_fingerprint")) for n in ("edited", "next")}
    return rows.withColumns({f"near_{n}": near[n] for n in near}).drop("next_fingerprint")


@query("op7_token_id_output")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    folder = shared_folder(spark)
    tokenfiles.write_tokens(table(spark, directory, "documents"), folder, byte_bpe())
    found = tokenfiles.read_tokens(spark, folder)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


# The rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
URL_VALUES = ", ".join(str(r) for r in URL_RULES)
URL_SQL = f"""
WITH rules(h, p, v) AS (VALUES {URL_VALUES}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u),
f AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM x JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN f USING (k)
"""


@query("op8_url_filters", URL_SQL)
def op8(spark: SparkSession, directory: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_VALUES} AS t(host, path, verdict)")
    pages = table(spark, directory, "pages").select("page_id", "url")
    return urlfilter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM w, unnest(range(1, len(words) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
             len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(places.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN places USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words > 0 AND n_symbols > 0.1 * n_words AS s1, n_words > 0 AND n_symbols > n_words AS l1,
             n_words > 0 AND n_dup_lines > 0.3 * n_lines AS s2, n_words > 0 AND n_dup_lines > 0.6 * n_lines AS l2,
             n_words > 0 AND word_chars > 12 * n_words AS s3, n_words > 0 AND word_chars > 24 * n_words AS l3 FROM m),
h AS (SELECT source, r, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE CASE r WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END))::DOUBLE AS f
      FROM b, unnest([1, 2, 3]) AS x(r) GROUP BY source, r),
mean AS (SELECT r, sum(n) AS n, sum(n * n) AS n2, count(*) AS hosts, sum(f) / sum(n) AS p FROM h GROUP BY r),
spread AS (SELECT h.r, sum(h.n * (f / h.n - p) ** 2) AS s FROM h JOIN mean USING (r) GROUP BY h.r),
prior AS (SELECT r, p, CASE WHEN hosts < 2 OR p <= 0 OR p >= 1
                            OR (s - p * (1 - p) * (hosts - 1)) / (n - n2 / n) <= p * (1 - p) / 1000001 THEN 1000000
                       ELSE greatest(p * (1 - p) / ((s - p * (1 - p) * (hosts - 1)) / (n - n2 / n)) - 1, 0) END AS k
          FROM mean JOIN spread USING (r)),
verdict AS (SELECT source, bool_or((f + k * p) / (n + k) > 0.3) AS distrusted FROM h JOIN prior USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distrusted AS host_distrusted,
       NOT base_failed AND NOT CASE WHEN distrusted THEN s1 OR s2 OR s3 ELSE l1 OR l2 OR l3 END AS kept
FROM b JOIN verdict ON b.source IS NOT DISTINCT FROM verdict.source
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, directory: str) -> DataFrame:
    rows = quality.judged(table(spark, directory, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.col("distrusted").alias("host_distrusted"), "kept")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, directory, "documents"), byte_bpe())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


PHRASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
      FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, unnest([1, 2, 3]) AS s(k))),
totals AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
                (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS longer
           FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE size = 3) GROUP BY ALL),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
           FROM best LEFT JOIN inside USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", PHRASE_SQL)
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.collocations(table(spark, directory, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encoded(table(spark, directory, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decoded(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


MERKLE_SQL = r"""
WITH RECURSIVE b AS (
  SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes,
         list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
                        lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f FROM documents),
c AS (SELECT *, xor(list_reduce([4294967295] || bytes, lambda a, x: list_reduce([xor(a, x)] || range(8),
             lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 2 = 0 AS tampered FROM b),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS t, f,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM c),
e AS (SELECT doc_id, tree, leaf, idx, sha256(array_to_string(f, '') || coalesce(strlen(t) || ':' || t, '-')) AS claimed,
             row_number() OVER () AS k FROM d),
n(lv, tree, idx, digest) AS (
  SELECT 0, tree, idx, leaf FROM e UNION ALL
  SELECT lv + 1, tree, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM n) WHERE m > 1 GROUP BY lv, tree, idx // 3),
h AS (SELECT tree, max(lv) AS height, arg_max(digest, lv) AS subroot FROM n GROUP BY tree),
u(lv, idx, digest) AS (
  SELECT 0, tree, subroot FROM h UNION ALL
  SELECT lv + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS m FROM u) WHERE m > 1 GROUP BY lv, idx // 3),
top AS (SELECT max(lv) AS height, arg_max(digest, lv) AS root FROM u),
lower AS (SELECT k, lv, idx // (3 ** lv)::BIGINT AS own, tree FROM e JOIN h USING (tree), unnest(range(height)) AS r(lv)),
upper AS (SELECT k, h.height + lv AS s, lv, e.tree // (3 ** lv)::BIGINT AS own
          FROM e JOIN h USING (tree), top, unnest(range(top.height)) AS r(lv)),
runs AS (SELECT k, l.lv AS s, own, n.idx, digest FROM lower l JOIN n ON n.tree = l.tree AND n.lv = l.lv AND n.idx // 3 = own // 3
         UNION ALL SELECT k, s, own, u.idx, digest FROM upper JOIN u ON u.lv = upper.lv AND u.idx // 3 = own // 3),
steps AS (SELECT k, s, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS lft,
                 coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS rgt FROM runs GROUP BY k, s),
proofs AS (SELECT k, string_agg(lft || rgt, '' ORDER BY s) AS proof FROM steps GROUP BY k),
fold(k, s, acc) AS (
  SELECT k, 0, claimed FROM e UNION ALL
  SELECT fold.k, fold.s + 1, sha256(lft || acc || rgt) FROM fold JOIN steps ON steps.k = fold.k AND steps.s = fold.s),
last AS (SELECT k, arg_max(acc, s) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM e JOIN h USING (tree) JOIN last USING (k) LEFT JOIN proofs USING (k), top
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, directory: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    claimed = merkle.leaf_of(*[text if c == "text" else F.col(c) for c in columns])
    rows = merkle.manifest(table(spark, directory, "documents"), columns, claimed=claimed)
    root = merkle.folded(F.col("path"), F.col("claimed"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"),
                       root.alias("folded_root"), (root == F.col("root")).alias("verified"))

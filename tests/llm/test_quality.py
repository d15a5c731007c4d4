import re
from collections import Counter

import pytest
from cases import documents, empty, odd, odd_rows, prose
from sitegauge.llm import quality


def plain(text):
    text = text or ""
    found = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(repeated), len(found) < 50 or 100 * len(repeated) > 50 * len(found))


def measured(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                                                     r.base_failed)) for r in rows))


def test_odd_rows(spark):
    rows = quality.judged(odd(spark)).collect()
    assert measured(rows) == sorted((i is None, i or 0, plain(t)) for i, t, _ in odd_rows())
    kept = quality.kept_documents(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.kept for r in rows)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "a b c d a b c e b c d", "x", "", "a b", "# $ % # $ %\n# $ %\n\n# $ %",
                                  "l1\nl1\n \nl1 \n\nl2", "w " * 300])
def test_measures(spark, text):
    rows = quality.judged(documents(spark, [(1, text, "s")])).collect()
    assert measured(rows) == [(False, 1, plain(text))]


def test_empty(spark):
    assert quality.judged(empty(spark)).collect() == []
    assert quality.kept_documents(empty(spark)).collect() == []


def mixed_hosts():
    """Good hosts, and one where most documents are full of symbols; clean documents at each."""
    rows = []
    for h in range(10):
        for k in range(40):
            text = prose(h * 100 + k, 120)
            if h == 9 and k < 30 or h < 9 and k < 2:
                text = re.sub(r" ", " # ", text, count=40)
            rows.append((h * 100 + k, text, f"h{h}"))
    rows.append((5000, re.sub(r" ", " # ", prose(1, 120), count=40), "tiny"))
    return rows


def test_host_verdicts(spark):
    rows = {r.doc_id: r for r in quality.judged(documents(spark, mixed_hosts())).collect()}
    for i, text, host in mixed_hosts():
        symbols = "#" in text
        assert rows[i].distrusted == (host == "h9" or host == "tiny" and rows[i].distrusted)
        assert rows[i].kept == (not (symbols and rows[i].distrusted))  # clean ones stay everywhere
    assert not rows[901 - 1].kept and rows[939].kept and rows[0].kept


def test_one_bad_document_is_shrunk_away(spark):
    """A host of one bad document is judged by the others; alone in the corpus it is not."""
    rows = {r.host: r for r in quality.host_verdicts(quality.measures(documents(spark, mixed_hosts()[:360] + mixed_hosts()[-1:]))).collect()}
    assert rows["tiny"].symbols_rate < 0.3 and not rows["tiny"].distrusted


def test_prior_weight():
    # Equal shares: all shrunk to the mean. Shares spread far beyond binomial noise: hardly any shrinking.
    assert quality.prior_weight(1000, 100_000, 10, 0.1, 0.0) == quality.MOST_PRIOR
    assert quality.prior_weight(1000, 100_000, 10, 0.5, 1000 * 0.2) < 2
    assert quality.prior_weight(0, 0, 0, 0.0, 0.0) == quality.MOST_PRIOR


def test_null_host_is_a_host(spark):
    docs = documents(spark, [(i, re.sub(" ", " # ", prose(i, 100), count=60), None) for i in range(30)]
                     + [(100 + i, prose(i, 100), "good") for i in range(60)])
    rows = quality.judged(docs).collect()
    assert len(rows) == 90 and all(r.kept == (r.host == "good") for r in rows)

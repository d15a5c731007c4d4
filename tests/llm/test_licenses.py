import re
import time

import pytest
from cases import documents, empty, odd, prose
from sitegauge.llm import licenses
from sitegauge.llm.queries import QUERIES


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def plain_base(text):
    found, starts, labels = plain_words(text), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(found)) if found[i:i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_of_a_table(spark, data):
    rows = {r.doc_id: r for r in QUERIES["op4_license_scans"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(d.text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        gpl = "GNU General Public License, version 3" in d.text
        assert ("gpl-3" in r.labels.split(",")) == gpl


def licensed_rows():
    rows, at = [], 0
    for n, (t, _) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for text in (t.title(), ", ".join(w).upper(), f"{prose(n, 500)}\n{t}\n{prose(n + 1, 700)}",
                     prose(n, 13) + " " + " ".join(w[:2] + w[3:]), " ".join(w[: len(w) // 2]), " ".join(reversed(w)),
                     prose(n, 40) + " " + " ".join(x for k, x in enumerate(w) if k % 3)):
            rows.append((at, text, "s"))
            at += 1
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_block_over_the_threshold_is_found(spark, threshold):
    rows = licensed_rows()
    found = {r.doc_id: r.spans for r in licenses.scan(documents(spark, rows), threshold=threshold, phrases=[]).collect()}
    for i, text, _ in rows:
        want = plain_windows(text, licenses.TEMPLATES, threshold)
        assert {s.label for s in found[i]} == want
        for s in found[i]:
            assert s.containment >= threshold - 1e-9 and 0 <= s.first <= s.last < len(plain_words(text))


def plain_windows(text, templates, threshold):
    """Labels that meet the threshold in a block of 2t words at any start."""
    found = plain_words(text)
    return {label for t, label in templates for size in [len(t.split())] for at in range(len(found))
            if len(set(t.split()) & set(found[at:at + 2 * size])) >= threshold * len(set(t.split())) - 1e-9}


SPREAD = "this work is except where otherwise noted licensed under the terms of the gnu general public license version 3"


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_blocks_at_every_start(spark, threshold):
    """What stands before a notice does not change whether it is found."""
    rows = [(k, f"{'x ' * k}{SPREAD}{' y' * (k % 7)}", "s") for k in range(40)]
    rows += [(100 + i, t, s) for i, t, s in licensed_rows()]
    found = licenses.scan(documents(spark, rows), threshold=threshold, phrases=[]).collect()
    texts = {i: t for i, t, _ in rows}
    for r in found:
        assert {s.label for s in r.spans} == plain_windows(texts[r.doc_id], licenses.TEMPLATES, threshold)
        if r.doc_id < 40:
            gpl = [s for s in r.spans if s.label == "gpl-3"]
            assert [(s.first, s.last, s.containment) for s in gpl] == [(r.doc_id, r.doc_id + 18, 1.0)]


def test_two_notices_side_by_side(spark):
    notice = licenses.TEMPLATES[2][0]
    rows = licenses.scan(documents(spark, [(1, f"{notice} {notice}", "s")]), templates=[licenses.TEMPLATES[2]]).collect()
    assert [(s.first, s.last) for s in rows[0].spans] == [(0, 11), (12, 23)]


def test_phrases_overlap(spark):
    docs = documents(spark, [(1, "CC BY-NC by nc; cc by nc cc. By NC", "s"), (2, "xcc by nc", "s"), (3, "cc by ncé", "s")])
    rows = {r.doc_id: [s.first for s in r.spans if s.exact] for r in licenses.scan(docs).collect()}
    assert rows == {1: [0, 5, 8], 2: [], 3: []}


def test_odd_rows(spark):
    rows = licenses.scan(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and all(r.spans == [] for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}


def test_empty(spark):
    assert licenses.scan(empty(spark)).collect() == []


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 2)
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(empty(spark))


def test_a_templates_own_text_has_its_label_only(spark):
    """Near-identical templates compete for a block, wherever it stands; side by side each keeps its own."""
    texts = [t for t, _ in licenses.TEMPLATES]
    rows = [(i, text, "s") for i, text in enumerate(texts)]
    rows += [(100 + i, f"{prose(i, 300)}\n{text.title()}\n{prose(i + 1, 200)}", "s") for i, text in enumerate(texts)]
    rows += [(1000 + 20 * i + k, f"{a}\n{b}", "s") for i, a in enumerate(texts) for k, b in enumerate(texts)]
    for r in licenses.scan(documents(spark, rows), phrases=[]).collect():
        own = {r.doc_id % 100} if r.doc_id < 1000 else {(r.doc_id - 1000) // 20, (r.doc_id - 1000) % 20}
        assert {s.label for s in r.spans if s.best} == {licenses.TEMPLATES[n][1] for n in own}, r.doc_id


def test_the_best_of_overlapping_blocks(spark):
    """``best`` by all pairs: walked from the block that shares most, one stays if it meets none that stayed."""
    sizes = {label: len(set(t.split())) for t, label in licenses.TEMPLATES}
    for r in licenses.scan(documents(spark, licensed_rows()), threshold=0.5, phrases=[]).collect():
        kept = []
        for s in sorted(r.spans, key=lambda s: (-round(s.containment * sizes[s.label]), -s.containment, s.first, s.label)):
            stays = not any(s.first <= k.last and k.first <= s.last for k in kept)
            kept += [s] if stays else []
            assert s.best == stays


def test_positional_filter():
    """The rarest shared word and the words after it in the order bound what can be shared; the bound is never too low."""
    index = licenses.Templates([("a b c d e", "x")], {w: n for n, w in enumerate([b"a", b"b", b"c", b"d", b"e"])}, 0.6)
    assert index.prefixes.keys() == {0, 1, 2}
    assert index.most_shared(0, 2, {2, 3}) == 2 < index.needed[0]  # pruned though c is a prefix word
    assert index.most_shared(0, 1, {1, 2, 3, 4}) == 4
    assert index.search([b"c", b"d"]) == [] and index.search([b"b", b"d", b"e"])[0]["containment"] == 0.6


def test_phrases_and_notices_in_linear_time():
    index = licenses.Templates(licenses.TEMPLATES, {}, licenses.THRESHOLD)

    def seconds(n):
        found = [b"cc", b"by", b"nc"] * n
        notices = licenses.TEMPLATES[2][0].encode().split() * (n // 10)
        start = time.process_time()
        assert len(licenses.phrase_places(found, [(b"cc by nc", "c")])) == n
        assert [h["best"] for h in index.search(notices) if h["label"] == "gpl-3"] == [True] * (n // 10)
        return time.process_time() - start
    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.3

"""License scans: exact set-similarity search of license templates in whole texts.

Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII. Two things are found:

* places where a phrase's words stand consecutively (exact), and
* text blocks that contain at least ``THRESHOLD`` of a template's different words. A template of t words is looked for in
  every block of 2t words, whatever word it starts at.

The search is an exact set-similarity join with a containment threshold. All template words are ordered by their frequency
over all documents (counted first, in one pass that sends one number per template word and batch), rarest first.
A template with n different words must share o = ceil(THRESHOLD * n) of them with a block, so the block holds one of the
template's first n - o + 1 words (prefix filter). The blocks around such words make up stretches. From the rarest such word of
a stretch on, template and stretch go through the same order, so they share at most the shorter rest (positional
filter); one with less than o of the template's words is left out (length filter), and over the others a window slides with
the count of each shared word. A block that starts at no shared word holds no more of them than the one at the next, so
only those are looked at.

All blocks over the threshold are returned. Where those of near-identical templates overlap, ``best`` marks the one that shares
most words (on ties the one that holds more of its template, then the first, then by label).

The templates are the query set; they are a parameter that every task holds, at most ``MOST_TEMPLATES``. Documents are
scanned where they lie and never shuffled.

Nulls: a null text is empty, a null id stays null. Repeated rows stay; an empty table gives no rows. A very long text is scanned
whole by one task, in time linear in its words and hits. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

THRESHOLD = 0.8
MOST_TEMPLATES = 10_000
SEPARATORS = bytes(b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
                   for b in range(256))
# Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Templates and their labels: opening sentences of common notices.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution share alike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]
SPANS = "array<struct<label:string,first:long,last:long,containment:double,exact:boolean,best:boolean>>"
FOUND = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                            ("containment", pa.float64()), ("exact", pa.bool_()), ("best", pa.bool_())]))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(SEPARATORS).split()


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of a bounded set of words stands in all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch.column(0).cast(pa.binary()):
                found.update(filter(vocabulary.__contains__, words(text.as_py() or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = map_batches(docs.select(F.col(text_col).alias("text")), count, "word string, n long")
    return {r["word"].encode(): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Templates:
    """Templates indexed by the words of their prefixes. Words are known by their rank in the order by frequency, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.sizes, self.starts, self.labels, self.ordered, self.sets, self.needed = [], [], [], [], [], []
        #: Rank of a prefix word -> (template, place of the word in the template's order).
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        vocabulary = {w for text, _ in templates for w in words(text.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        for number, (text, label) in enumerate(templates):
            found = words(text.encode())
            ordered = sorted({self.rank[w] for w in found})
            needed = math.ceil(threshold * len(ordered) - 1e-9)
            self.sizes.append(len(found))
            self.starts.append(found[0] if found else b"")
            self.labels.append(label)
            self.ordered.append(ordered)
            self.sets.append(frozenset(ordered))
            self.needed.append(needed)
            for place, rank in enumerate(ordered[:len(ordered) - needed + 1]):
                self.prefixes.setdefault(rank, []).append((number, place))

    def most_shared(self, number: int, place: int, ranks: set[int]) -> int:
        """Positional bound: words that a text with ``ranks`` can share with a template if the rarest is at ``place`` of its order.
        Both go on from there in one order, so it is the shorter rest."""
        ordered = self.ordered[number]
        return min(len(ordered) - place, sum(r >= ordered[place] for r in ranks))

    def search(self, found: list[bytes]) -> list[dict]:
        """Blocks that meet the threshold of a template; of overlapping ones of a template, the first of the best (of equally
        good ones that with the template's first word in front, then the shortest). A block ends where it first holds
        all the template's words that it has."""
        marks = [(at, self.rank[word]) for at, word in enumerate(found) if word in self.rank]
        stretches: dict[int, list[list[int]]] = {}
        for at, rank in marks:
            for number, place in self.prefixes.get(rank, ()):
                wide, own = 2 * self.sizes[number], stretches.setdefault(number, [])
                if own and at - wide < own[-1][1]:
                    own[-1][1] = at + wide
                    own[-1][2] = min(own[-1][2], place)
                else:
                    own.append([max(0, at - wide + 1), at + wide, place])
        hits: list[dict] = []
        for number in sorted(stretches):
            own, needed, best = self.sets[number], self.needed[number], []
            for low, high, place in stretches[number]:
                part = marks[bisect_left(marks, (low,)):bisect_left(marks, (high,))]
                here = {r for _, r in part}
                if self.most_shared(number, place, here) < needed or len(own & here) < needed:
                    continue
                for first, last, shared in self._blocks([m for m in part if m[1] in own], number):
                    hit = {"label": self.labels[number], "first": first, "last": last,
                           "containment": shared / len(own), "exact": False, "best": True, "shared": shared}
                    if not best or first > best[-1]["last"]:
                        best.append(hit)
                    elif self._merit(found, number, hit) > self._merit(found, number, best[-1]):
                        best[-1] = hit
            hits += best
        return compete(hits)

    def _merit(self, found: list[bytes], number: int, hit: dict) -> tuple:
        return hit["containment"], found[hit["first"]] == self.starts[number], hit["first"] - hit["last"]

    def _blocks(self, marks: list[tuple[int, int]], number: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, shared words) of each block over the threshold that starts at one of the shared words ``marks``."""
        needed, wide = self.needed[number], 2 * self.sizes[number]
        counts: Counter[int] = Counter()
        shared = end = 0
        for k, (first, rank) in enumerate(marks):
            while end < len(marks) and marks[end][0] < first + wide:
                shared += not counts[marks[end][1]]
                counts[marks[end][1]] += 1
                end += 1
            if shared >= needed:
                seen = set()
                for last, other in marks[k:end]:
                    seen.add(other)
                    if len(seen) == shared:
                        break
                yield first, last, shared
            counts[rank] -= 1
            shared -= not counts[rank]


def compete(hits: list[dict]) -> list[dict]:
    """``best`` is false for a block that overlaps one of another label that shares more words, or as many of a shorter template:
    near-identical templates all meet the threshold where one of them stands. A block that gave way itself defeats none.

    Kept blocks of one label never overlap, nor do those of different labels, so each is found by its neighbours."""
    kept: list[tuple[int, int]] = []
    for hit in sorted(hits, key=lambda h: (-h["shared"], -h["containment"], h["first"], h["label"])):
        at = bisect_left(kept, (hit["first"],))
        before, after = kept[at - 1:at] if at else [], kept[at:at + 1]
        hit["best"] = all(last < hit["first"] for _, last in before) and all(first > hit["last"] for first, _ in after)
        if hit["best"]:
            insort(kept, (hit["first"], hit["last"]))
    return hits


def phrase_places(found: list[bytes], phrases: list[tuple[bytes, str]]) -> list[dict]:
    """Each place where a phrase's words stand one after the other, overlapping ones too."""
    line, hits = b" " + b" ".join(found) + b" ", []
    for phrase, label in phrases:
        wanted, at, first, counted = b" " + phrase + b" ", -1, 0, 0
        length = phrase.count(b" ")
        while (at := line.find(wanted, at + 1)) >= 0:
            first += line.count(b" ", counted, at)  # words since the place before
            counted = at
            hits.append({"label": label, "first": first, "last": first + length, "containment": 1.0, "exact": True, "best": True})
    return hits


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row; a span has its label, first and last word (from 0), the containment of
    the template in the block, whether it is an exact phrase, and whether it is the best of those that overlap."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates; scan them in parts")
    vocabulary = {w for text, _ in templates for w in words(text.encode())}
    index = Templates(templates, word_frequencies(docs, vocabulary, text_col), threshold)
    sought = [(b" ".join(words(text.encode())), label) for text, label in phrases]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1).cast(pa.binary()):
                found = words(text.as_py() or b"")
                counts.append(len(found))
                spans.append(phrase_places(found, sought) + index.search(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, FOUND)],
                                             ["doc_id", "n_words", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, search, f"doc_id long, n_words long, spans {SPANS}")

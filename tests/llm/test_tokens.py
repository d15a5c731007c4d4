import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import documents, empty, odd, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sitegauge.llm import packing, tokenfiles, tokens
from sitegauge.sources.shared import shared_folder
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
TRIALS = int(os.environ.get("TOKEN_TRIALS", "5000"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


PIECES = ["a", "The", "don't", "it's", "12a", "é", "ß.", "...", "###", "|", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t",
          "\r\n", " ", "　", " ", "'ll", "x" * 40, "naïve,", "漢字", "🙂", "\x1c", "\x85", "('a')"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=25).map("".join), max_size=6))
def test_ids_equal_the_library(texts):
    got = [x.tolist() for x in tokens.coder(PATH).encode(pa.array(texts, pa.string()))]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def test_runs_of_mixed_white_space():
    """Parts that are nothing but other white space, between single spaces, in the middle and at the ends of lines."""
    texts = [f"a {b} {b} b{c}{b} d" for b in BLANKS for c in ("", " ", "\n", ".")]
    draw = random.Random(7)
    kinds = ["\u00a0", " ", " ", "\n", "a", "Bc", "1", ".", "'s", "\u0301", "<|endoftext|>", *BLANKS]
    texts += ["".join(draw.choice(kinds) for _ in range(draw.randint(1, 14))) for _ in range(TRIALS)]
    texts += [" ".join(draw.choice(("a", "\u00a0", "b.", "\u3000c", "d\t")) for _ in range(6)) for _ in range(TRIALS // 10)]
    got = [x.tolist() for x in tokens.Coder(PATH).encode(pa.array(texts))]
    assert got == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_spaced_words_equal_the_library(monkeypatch):
    """Also where nothing can be remembered, and batches are small."""
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    texts = [prose(i, 30) + ".\n" + prose(i + 1, 9) + "! " + prose(i, 4) + "###" for i in range(40)] + [None, ""]
    got = [x.tolist() for x in tokens.Coder(PATH).encode(pa.array(texts))]
    assert got == [ids_of(t)[:-1] for t in texts]


def read_back(spark, docs):
    folder = shared_folder(spark)
    tokenfiles.write_tokens(docs, folder, PATH)
    return folder, tokenfiles.read_tokens(spark, folder).collect()


def test_pieces_go_to_the_library_joined():
    """Many pieces a text, and little text at a time; also by a vocabulary whose names do not tell the bytes."""
    texts = [" ".join(f"w{i}x{j}, {chr(0xe4)}{j}" for j in range(50)) + "\n!a\n<|endoftext|> b.\nend..." for i in range(400)]
    want = [ids_of(t)[:-1] for t in texts]
    for named in (True, False):
        coder, calls = tokens.Coder(PATH, 1000), []

        class Library:
            def encode_batch_fast(self, given, library=coder.tokenizer, **more):
                calls.append(list(given))
                return library.encode_batch_fast(given, **more)

        coder.tokenizer = Library()
        if not named:
            coder.size[:] = 1
        assert [x.tolist() for x in coder.encode(pa.array(texts, pa.string()))] == want
        assert max(sum(map(len, given)) for given in calls) < 200_000
        if named:
            assert sum(map(len, calls)) <= 5 and len(coder.known) == 1000


def check_files(spark, docs):
    folder, rows = read_back(spark, docs)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, ids_of(r.text)) for r in docs.select("doc_id", "text").collect()))
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    got = [(r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert [g[:2] for g in got] == [w[:2] for w in want] and sorted(got) == want
    return folder, at


def test_files_of_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    folder, total = check_files(spark, docs)
    manifest = sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r.part)
    assert [r.base for r in manifest] == np.concatenate([[0], np.cumsum([r.n_tokens for r in manifest])[:-1]]).tolist()
    # The files themselves, mapped.
    flat = np.concatenate([np.memmap(f"{folder}/part-{r.part:06d}.ids", "<u2", "r") for r in manifest])
    first = docs.orderBy("doc_id").first()
    assert len(flat) == total and flat[:len(ids_of(first.text))].tolist() == ids_of(first.text)


def test_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "READ_TOKENS", 100)
    check_files(spark, odd(spark))


def test_files_of_an_empty_table(spark):
    assert read_back(spark, empty(spark))[1] == []


def check_packing(docs, capacity=2048):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(np.array(ids_of(r.text), "<u4"))
    pieces = packing.token_pieces(docs, PATH, capacity)
    rows = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc")), capacity).collect()
    bins, found = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append((r.piece, r.start, r.length, r.crc))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, copies in texts.items():
        want = []
        for ids in copies:
            short = len(ids) % capacity or capacity
            starts = [0, *range(short, len(ids), capacity)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                want.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        assert sorted(found[doc]) == sorted(want)
    assert found.keys() == texts.keys()
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_a_table(spark, data):
    used, least = check_packing(spark.read.parquet(f"{data}/documents.parquet"))
    assert used <= least + 1


def test_packing_over_cells_and_levels(spark, data, monkeypatch):
    """With many small cells the badly filled sequences meet again, so hardly any room is lost."""
    monkeypatch.setattr(packing, "CELL", 32)
    monkeypatch.setattr(packing, "RELEASED", 8)
    used, least = check_packing(spark.read.parquet(f"{data}/documents.parquet"), 512)
    assert used <= 1.03 * least + 2


def test_packing_of_odd_rows(spark):
    check_packing(odd(spark), 64)


def test_packing_of_copies(spark):
    """A third of all rows are the same row."""
    docs = documents(spark, [(1, prose(1, 90), "a")] * 200 + [(i, prose(i, i % 150), "a") for i in range(2, 400)])
    used, least = check_packing(docs)
    assert used <= least + 1


def test_packing_of_an_empty_table(spark):
    assert check_packing(empty(spark)) == (0, 0)


@pytest.mark.parametrize("seed", range(6))
def test_evolution_improves_on_best_fit(seed):
    draw = np.random.default_rng(seed)
    lengths = np.sort(draw.integers(500, 1400, 300))[::-1].copy()
    order = np.argsort(-lengths, kind="stable").tolist()
    first = packing.Bins([], []).place(order, lengths.tolist(), 2048)
    bins, used, _ = packing.evolve(lengths, [], 2048, seed)
    again, still, _ = packing.evolve(lengths, [bins, first.numbers(len(lengths))], 2048, seed + 1)
    assert still <= used <= len(first.room)
    for b in (bins, again):
        assert np.bincount(b, lengths).max() <= 2048


def test_crossover_keeps_every_document_once():
    draw = np.random.default_rng(0)
    lengths = draw.integers(1, 2000, 200).tolist()
    parents = [packing.Bins([], []).place(draw.permutation(200).tolist(), lengths, 2048) for _ in range(2)]
    for _ in range(20):
        child = packing.crossover(*parents, lengths, 2048, draw)
        assert sorted(i for own in child.items for i in own) == list(range(200))
        assert all(r == 2048 - sum(lengths[i] for i in own) >= 0 for own, r in zip(child.items, child.room, strict=True))

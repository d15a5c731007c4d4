import base64
import hashlib
import time
from array import array

import public_tokenizers
import pytest
import tiktoken
from cases import documents, empty, odd, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from sitegauge.llm import bpe, queries

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
CODER = bpe.Encoder(PATH, PATTERN)
RANKS = CODER.machine.ranks
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return memoryview(CODER.encode(text)).cast("I").tolist()


PIECES = ["a", "aa", "aaa", "The", "don't", "it's", "12a", "é", "ß.", "...", "### ", "|", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t",
          "\r\n", " ", "　", " ", "'ll", "x" * 40, "naïve,", "漢字", "🙂", "\x1c", "\x85", "('a')", "==", "--", "tion"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=25).map("".join))
def test_ids_equal_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=60) | st.text(alphabet="aeinst ", max_size=60).map(str.encode))
def test_single_pieces_of_any_bytes(piece):
    """One piece, also such as are no text: what merging pair by pair gives."""
    got = CODER.machine.encode(piece).tolist() if piece else []
    assert got == ([RANKS[piece]] if piece in RANKS else [RANKS[p] for p in CODER.machine._merged(piece)])


def test_every_code_point_beside_letters_and_spaces():
    """Also where versions of Unicode differ on letters."""
    texts = ["".join(f"a{chr(c)} {chr(c)}b1{chr(c)}{chr(c)} \n{chr(c)}" for c in range(a, a + 256) if not 0xD800 <= c < 0xE000)
             for a in range(0, 0x33500, 256)]
    assert [ids(t) for t in texts] == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("limit", [1, 7])
def test_small_tables(monkeypatch, limit):
    """Most states, pairs and pieces are made anew each time."""
    for name in ("PIECES", "STATES", "PAIRS"):
        monkeypatch.setattr(bpe, name, limit)
    small = bpe.Encoder(PATH, PATTERN)
    for i in range(20):
        text = prose(i, 40)
        assert memoryview(small.encode(text)).cast("I").tolist() == LIBRARY.encode_ordinary(text)
        assert len(small) <= limit and len(small.machine.states) <= limit + 1


def test_merges_of_a_small_list():
    """Overlapping equal merges, and a vocabulary whose tokens nest."""
    letters = {bytes([b]): b for b in range(256)}
    machine = bpe.Transducer({**letters, b"aa": 256, b"ab": 257, b"aab": 258, b"aaaa": 259, b"ba": 260, b"abab": 261})
    for n in range(1, 1 << 11):
        piece = bin(n)[2:].translate({48: "a", 49: "b"}).encode()
        if piece not in machine.ranks:
            assert machine.encode(piece).tolist() == [machine.ranks[p] for p in machine._merged(piece)], piece


def test_ranks_that_are_no_merge_list():
    with pytest.raises(ValueError, match="bytes"):
        bpe.Transducer({b"a": 0})
    broken = bpe.Transducer({**{bytes([b]): b for b in range(256)}, b"abc": 300, b"bc": 400})
    with pytest.raises(ValueError, match="merge list"):
        broken.encode(b"xabcx")


def test_long_texts_are_cut_where_pieces_start(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_RUN", 50)
    for text in (prose(5, 900), "a  b   c \n d" * 60, "x" * 3000, "漢" * 300 + " a" * 50):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces_are_emitted_in_runs(monkeypatch):
    monkeypatch.setattr(bpe, "LOOKAHEAD", 64)
    for piece in (b"a" * 500, prose(8, 300).replace(" ", "").encode(), b"=" * 333, "漢字é".encode() * 70, b"ab" * 400):
        assert CODER.machine.encode(piece).tolist() == [RANKS[p] for p in CODER.machine._merged(piece)]


def test_a_piece_takes_linear_time():
    def seconds(n):
        piece = ("lorem" * n).encode()
        CODER.machine.encode(piece[:1000])
        start = time.perf_counter()
        CODER.machine.encode(piece)
        return time.perf_counter() - start
    assert seconds(80_000) < 8 * seconds(20_000) + 0.2


@settings(max_examples=500, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5) | st.text(min_size=1, max_size=3).map(str.encode), max_size=12),
       st.sampled_from([1, 3, 500]))
def test_decoding_any_tokens(tokens, run):
    """Characters cut anywhere, and bytes that are no text."""
    stream, bpe.TOKEN_RUN = bpe.Utf8Stream(dict(enumerate(tokens))), run
    assert "".join(stream.decode(range(len(tokens)))) == b"".join(tokens).decode("utf-8", "replace")


def test_characters_come_out_as_soon_as_they_are_whole(monkeypatch):
    monkeypatch.setattr(bpe, "TOKEN_RUN", 1)
    stream = bpe.Utf8Stream({b: bytes([b]) for b in range(256)})
    assert list(stream.decode("aé漢🙂".encode())) == ["a", "", "é", "", "", "漢", "", "", "", "🙂"]
    assert list(stream.decode(b"\xe6\xbc")) == ["", "", "�"]


def test_tables(spark):
    rows = bpe.decoded(bpe.encoded(odd(spark), PATH, PATTERN), PATH).collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t, _ in odd_rows()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in rows) == want
    assert all(memoryview(r.ids).cast("I").tolist() == LIBRARY.encode_ordinary(r.text) for r in rows)
    assert bpe.decoded(bpe.encoded(empty(spark), PATH, PATTERN), PATH).collect() == []


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(bpe, "OUT_BYTES", 100)
    df = documents(spark, [(i, prose(i, i), "a") for i in range(60)])
    assert {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df, PATH, PATTERN), PATH).collect()} == {
        i: prose(i, i) for i in range(60)}


def test_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_byte_bpe"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = array("I", LIBRARY.encode_ordinary(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert base64.b64decode(open(PATH, "rb").readline().split()[0]) in RANKS

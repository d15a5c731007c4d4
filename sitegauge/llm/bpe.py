"""Byte-level BPE as a finite-state transducer, built while it runs, and its streaming way back.

Encoding. The merges of a rank file decide for every prefix of a piece one tokenization, and two tokens stand side by side in
a tokenization just if merging their joined bytes leaves these two. So the last token of a prefix is the one token that ends
there and fits the last token of the prefix before it, and the last tokens lead back from any prefix to its whole tokenization.
A state of the transducer holds what the coming bytes can still depend on: for each place from which a token may still be
growing, the node of the vocabulary's trie reached since and the last token before that place. Its output after each byte is
the last token of the prefix. Tokens that all these places share are certain; they are emitted in runs of ``LOOKAHEAD`` bytes,
so memory does not grow with a piece. States and steps are made when a text first needs them, and as many as a bounded table
holds are remembered; there each byte costs one lookup.

Decoding. ``Utf8Stream`` is an automaton whose state is the bytes of an unfinished character. Its steps over single bytes
are lifted to steps over whole tokens, also when first needed, so text comes out token by token, and a character cut between
two tokens waits for its rest. Bytes that are no UTF-8 give U+FFFD as in ``bytes.decode(errors="replace")``.

Nulls: a null text is empty and has no ids; a null id stays. Empty tables give empty tables. Repeated rows stay, ties do not
matter, since every row is on its own. Very long texts are cut at places where the pattern always starts a new piece, and
a piece of any length takes linear time. Columns besides the two named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole

# What a worker remembers: ids of pieces, states of the transducer, pairs of tokens. What comes later is made when needed.
PIECES, STATES, PAIRS = 400_000, 30_000, 250_000
# Characters of a text that are cut into pieces at a time, and bytes of ids that are returned at a time.
TEXT_RUN, OUT_BYTES = 1_000_000, 8_000_000
# Tokens whose text is joined at a time, and bytes of a piece whose tokens are held back (more than the longest token has).
TOKEN_RUN, LOOKAHEAD = 500, 4096
# Letters and numbers of Unicode versions after 16, which the rank files' library does not know as such.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")

ENTRIES, LAST, NEVER = -1, -2, 1 << 40


class Transducer:
    """Ids of a piece by the ranks {bytes: rank}, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # by node * 256 + byte
        self.ends, self.inner, self.depth = [-1], [True], [0]  # by node: the token that ends there, whether others go on
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.ends[node] = rank
        self.fit: dict[int, bool] = {}  # by left token and right token
        self.edges: dict[bytes, tuple[list, list] | None] = {}
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((0, LAST),))

    def _state(self, entries: tuple) -> dict:
        """The state of these places; beyond ``STATES`` a passing one, which nothing remembers."""
        found = self.states.get(entries)
        if found is None:
            found = {ENTRIES: entries}
            if len(self.states) < STATES:
                self.states[entries] = found
        return found

    def _merged(self, text: bytes, until: int = 1) -> list[bytes]:
        """A few bytes merged pair by pair, until so many parts are left."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > until:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: bytes) -> tuple[list, list] | None:
        """What stands at the left and at the right end of a token while it is merged: (bytes, rank of the merge that ends
        it). None where merging does not make the token; such a token only stands for a piece that equals it."""
        found = self.edges.get(token, 0)
        if found == 0:
            parts, rank, found = self._merged(token, 2), self.ranks[token], None
            if len(token) == 1:
                found = [(token, NEVER)], [(token, NEVER)]
            elif len(parts) == 2:
                sides = [self._edges(p) for p in parts]
                if None in sides or max((self.ranks[p] for p in parts if len(p) > 1), default=-1) >= rank:
                    raise ValueError("the ranks are not those of a merge list")
                found = tuple([*[(b, min(end, rank)) for b, end in side[i]], (token, NEVER)] for i, side in enumerate(sides))
            self.edges[token] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` (``LAST``: at the start): no merge crosses their border before the
        parts beside it are merged away. Of equal merges that overlap the left one comes first."""
        after = self._edges(self.tokens[right])
        known = after is not None
        if known and left != LAST:
            ranks = self.ranks
            for x, x_ends in self._edges(self.tokens[left])[1]:
                for y, y_ends in after[0]:
                    rank = ranks.get(x + y)
                    if rank is not None:
                        rank = max(rank, ranks[x] if len(x) > 1 else 0, ranks[y] if len(y) > 1 else 0)
                        if rank < x_ends and rank <= y_ends:
                            known = False
        if len(self.fit) < PAIRS:
            self.fit[left << 32 | right] = known
        return known

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """The next state after a byte, and the last token of the prefix that ends there; remembered in ``state``."""
        entries, ended = [], -1
        child, ends, inner, fit = self.child, self.ends, self.inner, self.fit
        for node, last in state[ENTRIES]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                entries.append((node, last))
            if ended < 0 and ends[node] >= 0:
                token = ends[node]
                fits = fit.get(last << 32 | token)
                if fits or (fits is None and self._fits(last, token)):
                    ended = token
        if ended < 0:
            raise ValueError("the ranks are not those of a merge list")
        entries.append((0, ended))
        found = self._state(tuple(entries)), ended
        if len(self.states) < STATES:
            state[byte] = found
        return found

    def _certain(self, lasts: list[int], state: dict) -> int:
        """The end of the tokens that all places agree on from which a token may still grow."""
        places = {len(lasts) - self.depth[node] for node, _ in state[ENTRIES]}
        while len(places) > 1:
            latest = max(places)
            places = places - {latest} | {latest - len(self.tokens[lasts[latest - 1]])}
        return places.pop()

    def _emit(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of a prefix, from the last one back."""
        out = []
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> array:
        whole_piece = self.ranks.get(piece)
        if whole_piece is not None:
            return array("I", (whole_piece,))
        out, lasts, state = [], [], self.start
        for byte in piece:
            state, last = state.get(byte) or self._step(state, byte)
            lasts.append(last)
            if len(lasts) >= LOOKAHEAD:
                end = self._certain(lasts, state)
                out += self._emit(lasts, end)
                del lasts[:end]
        return array("I", out + self._emit(lasts, len(lasts)))


class NewerCharacter(Exception):
    """A piece holds a character that only newer versions of Unicode know."""


class Encoder(dict):
    """Ids of texts; as a table, the ids (bytes) of the pieces it remembers."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, file)}
        self.machine = Transducer(ranks)
        self.pieces, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        spans = [[chr(int(c, 16)) for c in span.split("-")] for span in NEWER.split()]
        self.newer = regex.compile("[" + "".join("-".join(s) for s in spans) + "]")
        self.first_newer = min(spans)[0]
        # A single space between two other characters starts a piece.
        self.cut = regex.compile(r"(?<=\S)(?= \S)")

    def __missing__(self, piece: str) -> bytes:
        if max(piece) >= self.first_newer and self.newer.search(piece):
            raise NewerCharacter
        ids = self.machine.encode(piece.encode()).tobytes()
        if len(self) < PIECES and len(piece) <= 200:
            self[piece] = ids
        return ids

    def _run(self, text: str) -> bytes:
        try:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        except NewerCharacter:  # cut the text as if these were unassigned
            spans = [m.span() for m in self.matches(self.newer.sub("\U000EFFFF", text))]
            return b"".join(self.machine.encode(text[a:b].encode()).tobytes() for a, b in spans)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32 bit."""
        out, at = [], 0
        while at < len(text):
            found = self.cut.search(text, at + TEXT_RUN) if len(text) > at + TEXT_RUN else None
            end = found.start() if found else len(text)
            out.append(self._run(text[at:end]))
            at = end
        return b"".join(out)


# Second bytes that may follow a lead byte; all others take 80 to BF.
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """Text that a byte completes after the ``held`` bytes of an unfinished character, and what is held then."""
    if held:
        low, high = SECOND.get(held[0], (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
        if low <= byte <= high:
            now = held + bytes([byte])
            need = 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
            return (now.decode(), b"") if len(now) == need else ("", now)
        text, rest = utf8_step(b"", byte)
        return "�" + text, rest
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")


class Utf8Stream:
    """Steps of the automaton over whole tokens."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.closed: dict[int, str] = {}  # steps from the state without held bytes back to it

    def _step(self, held: bytes, token: int) -> tuple[str, bytes]:
        text, now = [], held
        for byte in self.tokens[token]:
            done, now = utf8_step(now, byte)
            text.append(done)
        if len(self.steps) > 256:
            self.steps = {b"": self.steps[b""]}
        self.steps.setdefault(now, {})
        self.steps.setdefault(held, {})[token] = out = "".join(text), now
        return out

    def decode(self, ids: Sequence[int]) -> Iterator[str]:
        """Text in runs of tokens; an unfinished character at the end is U+FFFD."""
        held = b""
        for at in range(0, len(ids), TOKEN_RUN):
            run = ids[at:at + TOKEN_RUN]
            if not held:
                try:
                    yield "".join(map(self.closed.__getitem__, run))
                    continue
                except KeyError:  # some token here is new, or opens a character
                    pass
            text = []
            for token in run:
                row = self.steps.get(held)
                before, (done, held) = held, (row and row.get(token)) or self._step(held, token)
                text.append(done)
                if not before and not held:
                    self.closed[token] = done
            yield "".join(text)
        if held:
            yield "�"


_encoders: dict[tuple[str, str], Encoder] = {}
_streams: dict[str, Utf8Stream] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; tasks of one worker share what it remembers."""
    if (path, pattern) not in _encoders:
        gc.set_threshold(500_000, 20, 100)  # the tables are many small objects without garbage among them
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def stream(path: str) -> Utf8Stream:
    if path not in _streams:
        with open(path, "rb") as file:
            _streams[path] = Utf8Stream({int(i): base64.b64decode(t) for t, i in map(bytes.split, file)})
    return _streams[path]


def _sized(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``OUT_BYTES``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids of each whole text as little-endian unsigned 32 bit, by the rank file at ``path``, each
    match of ``pattern`` on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, pattern)
        for batch in batches:
            rows = ((i.as_py(), machine.encode(t.as_py())) for i, t in zip(batch.column(0), batch.column(1), strict=True))
            yield from _sized(rows, [pa.int64(), pa.binary()], ["doc_id", "ids"], lambda r: 50 + len(r[1]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids); null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = stream(path)
        for batch in batches:
            pairs = ((i.as_py(), ids.as_py() or b"") for i, ids in zip(batch.column(0), batch.column(1), strict=True))
            done = ((i, ids, "".join(machine.decode(memoryview(ids).cast("I")))) for i, ids in pairs)
            yield from _sized(done, [pa.int64(), pa.binary(), pa.string()], ["doc_id", "ids", "text"],
                              lambda r: 50 + len(r[1]) + len(r[2]))

    return map_batches(rows.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")

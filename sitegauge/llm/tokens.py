"""Token ids of whole texts, by a ``tokenizers`` file, fast where words repeat.

The byte-level pattern of the tokenizer always starts a new piece at a line break between two visible characters and
at a space between two visible characters, and the ids of a piece depend on that piece alone. So a text is cut at these
places with Arrow, the different pieces of a batch that are not remembered go to the library once, many in a text, and the
ids of a text are gathered from the ids of its pieces. Texts whose spacing does not allow those cuts go to the library whole. Either way the ids
equal ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces whose ids a Python worker remembers; about 170 bytes each. Beyond it, pieces are encoded once a batch.
REMEMBERED = 400_000
# Bytes of text that are cut at a time.
BATCH_BYTES = 4_000_000
# Bytes of a text of joined pieces, and the texts that go to the library at a time; what it returns is far larger than a text.
JOINED_BYTES, TEXTS = 1 << 16, 2
# Parts of texts whose ids are gathered at a time.
PARTS = 100_000
# White space of the tokenizer's pattern, as a character class.
BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Characters that the pattern keeps in one piece of their own after letters.
MARKS = ".,;:!?#*$%&|<>()[]{}=+/\\@~^\""
MARKED = rf"^(?P<stem>\pL+)(?P<tail>[{re.escape(MARKS)}]+)$"

_coders: dict[tuple[str, int], Coder] = {}


def coder(path: str, remembered: int = REMEMBERED) -> Coder:
    """The worker's coder of a tokenizer file; tasks of one worker share it. It remembers the ids of so many pieces."""
    if (path, remembered) not in _coders:
        _coders[path, remembered] = Coder(path, remembered)
    return _coders[path, remembered]


def _spans(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of spans one after the other, and where each span begins among them, and the last one ends."""
    total = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(begin - total[:-1], length) + np.arange(total[-1]), total


class Coder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: its name has a character for each
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self.newline = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4")
        # The number of each piece that is remembered, and by number where its ids begin in ``ids``.
        self.known: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), TEXTS):
            for found in self.tokenizer.encode_batch_fast(texts[i:i + TEXTS], add_special_tokens=False):
                yield np.array(found.ids, "<u4")

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each begins, and the last one ends. Each has a space or a line break in
        front, at which the pattern starts a new piece, so the library takes many as one text, and its tokens end where they do."""
        offsets = np.frombuffer(pieces.buffers()[1], "<i8")[pieces.offset:pieces.offset + len(pieces) + 1]
        cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // JOINED_BYTES)) + 1
        spans = zip([0, *cuts.tolist()], [*cuts.tolist(), len(pieces)], strict=True)
        texts = [pieces.buffers()[2][int(offsets[a]):int(offsets[b])].to_pybytes().decode() for a, b in spans]
        flat = np.concatenate(list(self._library(texts)))
        stops, ends = offsets[1:] - offsets[0], np.cumsum(self.size[flat])
        if len(ends) and ends[-1] == stops[-1]:
            last = np.searchsorted(ends, stops)
            if (ends[last] == stops).all():
                return flat, np.concatenate([[0], last + 1])
        each = list(self._library(pieces.to_pylist()))  # a vocabulary whose names do not tell the bytes
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of different pieces begin in an array, how many they are, and the array."""
        names = pieces.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        begin, length, flat = self.begin[number], self.begin[number + 1] - self.begin[number], self.ids
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, at = self._joined(pieces.take(pa.array(missing)))
            begin[missing], length[missing] = len(flat) + at[:-1], np.diff(at)
            room = max(0, min(self.remembered - len(self.known), len(missing)))
            self.known.update(zip(names[missing[:room]].tolist(), range(len(self.known), self.remembered)))
            self.begin = np.concatenate([self.begin, len(flat) + at[1:room + 1]])
            self.ids = np.concatenate([flat, fresh[:at[room]]])
            flat = np.concatenate([flat, fresh])
        return begin, length, flat

    def _words(self, words: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the wanted words one after the other, and how many each has: word k as the first of a line, word k - n after a
        space. Letters and the marks after them are encoded apart."""
        if not len(wanted):
            return np.zeros(0, "<u4"), wanted
        used = words.take(pa.array(wanted % len(words)))
        halves = pc.extract_regex(used, MARKED)
        marked = pc.is_valid(halves)
        text, none = pa.large_string(), pa.scalar("", pa.large_string())
        front = pc.if_else(pa.array(wanted < len(words)), pa.scalar("\n", text), pa.scalar(" ", text))
        stems = pc.binary_join_element_wise(front, pc.if_else(marked, halves.field("stem"), used), none)
        tails = pc.binary_join_element_wise(pa.scalar("\n", text), halves.field("tail").filter(marked), none)
        kinds = pa.concat_arrays([stems, tails]).dictionary_encode()
        code = kinds.indices.to_numpy()
        begin, length, flat = self._pieces(kinds.dictionary)
        lines = pc.starts_with(kinds.dictionary, "\n").to_numpy(zero_copy_only=False) * len(self.newline)
        begin, length = begin + lines, length - lines  # without the line break in front
        both = np.zeros((len(wanted), 2), np.int64)
        both[:, 0] = code[:len(wanted)]
        split = marked.to_numpy(zero_copy_only=False)
        both[split, 1] = code[len(wanted):]
        sizes = length[both]
        sizes[~split, 1] = 0
        place, _ = _spans(begin[both].ravel(), sizes.ravel())
        return flat[place], sizes.sum(1)

    def encode(self, texts: pa.Array, at_a_time: int = BATCH_BYTES) -> Iterator[np.ndarray]:
        """Ids (unsigned 32 bit) of each text of a string array, null as empty; a text's array is only a view. Texts are cut so many
        bytes at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        cuts = np.cumsum(sizes) // at_a_time
        starts = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(starts, starts[1:]):
            yield from self._batch(texts.slice(a, b - a))

    def _batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lines = pc.split_pattern(texts, "\n")
        line_at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        parts = pc.split_pattern(lines.flatten(), " ")
        part_at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        kinds = parts.flatten().dictionary_encode()
        del lines, parts
        code, n = kinds.indices.to_numpy(), len(kinds.dictionary)
        # A text is plain if every part has a visible character at both ends: white space of any kind that meets another
        # space is one run for the pattern.
        edged = pc.match_substring_regex(kinds.dictionary, f"^{BLANK}|{BLANK}$|^$").to_numpy(zero_copy_only=False)
        odd = np.zeros(len(part_at) - 1, bool)
        odd[np.searchsorted(part_at, np.flatnonzero(edged[code]), "right") - 1] = True
        owner = np.repeat(np.arange(len(texts)), np.diff(line_at))
        plain = np.ones(len(texts), bool)
        plain[owner[odd]] = False

        use = np.repeat(plain, np.diff(part_at[line_at]))
        key = code.astype(np.int64) + n  # a piece inside a line has a space before it
        key[part_at[:-1][np.diff(part_at) > 0]] -= n
        wanted = np.flatnonzero(np.bincount(key[use], minlength=2 * n))
        # One more piece is the line break; it stands before the first piece of each but the first line of a text.
        flat, sizes = self._words(kinds.dictionary, wanted)
        flat = np.concatenate([flat, self.newline])
        length = np.zeros(2 * n + 1, np.int64)
        length[wanted], length[2 * n] = sizes, len(self.newline)
        begin = np.zeros(2 * n + 1, np.int64)
        begin[wanted], begin[2 * n] = np.cumsum(sizes) - sizes, len(flat) - len(self.newline)
        rest = self._library(texts.filter(pa.array(~plain)).to_pylist())
        del kinds, code, edged, odd, owner, texts
        # The ids of so many parts at a time, whole texts.
        cuts = np.flatnonzero(np.diff(part_at[line_at[:-1]] // PARTS)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(plain)], strict=True):
            line, part = line_at[a:b + 1], slice(part_at[line_at[a]], part_at[line_at[b]])
            at = part_at[line[0]:line[-1] + 1] - part.start
            later = np.ones(len(at) - 1, bool)
            later[line[:-1][np.diff(line) > 0] - line[0]] = False
            before = at[:-1][later]
            run = np.insert(key[part], before, 2 * n)
            keep = np.insert(use[part], before, use[part][before] if len(before) else [])
            ends = at[line - line[0]] + np.concatenate([[0], np.cumsum(np.diff(line) - 1)])
            place, total = _spans(begin[run], np.where(keep, length[run], 0))
            out, bound = flat[place], total[ends]
            for i, is_plain in enumerate(plain[a:b].tolist()):
                yield out[bound[i]:bound[i + 1]] if is_plain else next(rest)

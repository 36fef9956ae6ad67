"""Byte-level BPE ids of whole texts, through the ``tokenizers`` library.

The pre-tokenizer of such a vocabulary never lets a token cross certain places
(before a space that begins a word, around a single line break, between an
ASCII letter and common punctuation). Texts are cut there, each distinct piece
is encoded once by the library and remembered, and the ids of a batch are
gathered with Arrow. ``tests/llm`` holds this against encoding whole texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from creditspark.llm import textbatch as tb

# Pieces remembered by a Python worker; when full, those met once are forgotten.
MEMORY_PIECES = 300_000
# Longer pieces are encoded without being remembered.
MEMORY_PIECE_BYTES = 64
# Pieces given to the library at once, and those of them in one string.
CALL_PIECES = 20_000
JOINED_PIECES = 100
# Bytes of text whose ids are gathered at once.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Bytes that surely begin a character which is not white space: printable
# ASCII, and UTF-8 lead bytes under which Unicode has no white space.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"): ord("z") + 1] = True
_LETTER[ord("A"): ord("Z") + 1] = True
# No apostrophe here: it may begin a contraction, which is a token of its own.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ",.;:!?#$%&*|()[]<>=\"/_-+@"]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which the bytes may be cut without changing any id."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n > 1:
        here, following = data[:-1], data[1:]
        edge = cut[1:n]  # a text ends between the two bytes
        solid_next = _SOLID[following] & ~edge
        # Before a space that is followed by a character of a word.
        cut[: n - 1] |= (here == 0x20) & solid_next
        # After a single line break between two characters of words.
        one = (here == 0x0A) & solid_next
        one[1:] &= _SOLID[data[:-2]] | (data[:-2] >= 0x80) & (data[:-2] < 0xC0) & _ends_word(data)[:-2]
        one[0] = False
        cut[1:n] |= one
        cut[: n - 1] |= one
        # Between an ASCII letter and punctuation.
        cut[1:n] |= _LETTER[here] & _MARK[following]
    return np.flatnonzero(cut)


def _ends_word(data: np.ndarray) -> np.ndarray:
    """Per byte: it ends a two-byte character with a lead byte from 0xC3 on."""
    out = np.zeros(len(data), dtype=bool)
    out[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return out


class Encoder:
    """Encodes slices of texts to ids; one per Python worker and vocabulary."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        added = {i: t.content.encode("utf-8") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Strings that the library turns into one id wherever they stand.
        self.special = list(added.values())
        # Bytes of text that each id stands for: a byte-level token has one character per byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(added[i]) if i in added else len(token)
        self._forget()

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        # Pieces remembered, and under the same places their ids (as bytes, four
        # for each id) and the number of slices that held them.
        self.known = _NONE
        self.coded = _NONE
        self.met = np.zeros(0, dtype=np.int32)

    def _remember(self, parts: pa.Array, coded: pa.Array, met: np.ndarray) -> None:
        """Keeps the pieces that are not too long; if those are too many, the
        ones met in several slices, half the memory at most."""
        kept = np.diff(_offsets(parts)) <= MEMORY_PIECE_BYTES
        if kept.sum() > MEMORY_PIECES:
            least = 2
            while int((kept & (met >= least)).sum()) > MEMORY_PIECES // 2:
                least *= 2
            kept &= met >= least
            met = np.ones_like(met)
        if not kept.all():
            parts, coded, met = parts.filter(pa.array(kept)), coded.filter(pa.array(kept)), met[kept]
        self.known, self.coded, self.met = parts, coded, met

    def _library(self, parts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(
            [p.decode("utf-8") for p in parts], add_special_tokens=False)]

    def _encoded(self, parts: pa.Array) -> pa.Array:
        """The ids of each of the pieces, as bytes. Pieces between which the
        texts were cut alike (before a space) are given to the library many in
        one string, and told apart by the bytes that each id stands for."""
        at, data = _offsets(parts), _bytes(parts)
        lengths = np.diff(at)
        joins = (lengths > 1) & (lengths <= MEMORY_PIECE_BYTES)
        joins[joins] = (data[at[:-1][joins]] == 0x20) & _SOLID[data[at[:-1][joins] + 1]]
        together, alone = parts.filter(pa.array(joins)), parts.filter(pa.array(~joins))
        out = [self._joined(together.slice(k, CALL_PIECES)) for k in range(0, len(together), CALL_PIECES)]
        out += [self._apart(alone.slice(k, CALL_PIECES)) for k in range(0, len(alone), CALL_PIECES)]
        order = np.argsort(np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins))))
        return pa.concat_arrays(out).take(pa.array(order)) if out else _NONE

    def _joined(self, parts: pa.Array) -> pa.Array:
        at, data = _offsets(parts), _bytes(parts)
        cut = at[[*range(0, len(parts), JOINED_PIECES), len(parts)]]
        coded = self._library([data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])
        flat = np.concatenate([np.array(ids, dtype="<u4") for ids in coded])
        sizes = self.sizes[flat]
        ends = at[0] + np.cumsum(sizes)
        if len(ends) and ends[-1] == at[-1] and sizes.min() > 0:
            last = np.searchsorted(ends, at[1:])  # of each piece, its last id
            if np.array_equal(ends[last], at[1:]):
                return _id_rows(flat, np.concatenate(([0], last + 1)))
        # An id spans two pieces (a special string with a space), or the vocabulary is not byte-level.
        return self._apart(parts)

    def _apart(self, parts: pa.Array) -> pa.Array:
        coded = self._library(parts.to_pylist())
        first = np.concatenate(([0], np.cumsum([len(ids) for ids in coded])))
        return _id_rows(np.array([x for ids in coded for x in ids], dtype="<u4"), first)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, first)``: the ids of row d are ``ids[first[d]:first[d + 1]]``."""
        rows = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        at = cuts(data, offsets)
        # The known pieces come first, so a piece's index is its place in the memory.
        found = pa.chunked_array([self.known, tb.pieces(data, at[:-1], at[1:])]).dictionary_encode().chunks[-1]
        parts, place = found.dictionary, found.indices
        coded = pa.concat_arrays([self.coded, self._encoded(parts.slice(len(self.known)))])
        gathered = coded.take(place)
        here = np.zeros(len(parts), dtype=np.int32)
        here[place.to_numpy()] = 1
        here[: len(self.met)] += self.met
        self._remember(parts, coded, here)
        ids = _bytes(gathered).view("<u4")
        first = _offsets(gathered)[np.searchsorted(at, offsets)] // 4
        text = data.tobytes()
        if any(s in text for s in self.special):
            return self._with_special(text, offsets, ids, first)
        return ids, first

    def _with_special(self, text: bytes, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray):
        """Rows that hold a special string are encoded whole by the library."""
        out = []
        for d in range(len(offsets) - 1):
            row = text[offsets[d]: offsets[d + 1]]
            if any(s in row for s in self.special):
                out.append(np.array(self._library([row])[0], dtype=np.uint32))
            else:
                out.append(ids[first[d]: first[d + 1]])
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))


_NONE = pa.array([], type=pa.large_binary())


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each of the values begins in ``_bytes``, and where the last ends."""
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)
    return at[values.offset: values.offset + len(values) + 1]


def _bytes(values: pa.Array) -> np.ndarray:
    data = values.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def _id_rows(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return tb.pieces(flat.view(np.uint8), 4 * first[:-1], 4 * first[1:])


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(ids, np.uint32(end_id)).astype("<u4")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def encoded(texts: pa.Array, path: str, end_id: int):
    """Yields ``(row, ids)`` for each text of a batch, with the end id."""
    encoder = Encoder.at(path)
    for first, end, data, offsets in tb.slices(texts, SLICE_BYTES):
        ids, at = encoder.encode(data, offsets)
        for d in range(end - first):
            yield first + d, with_end(ids[at[d]: at[d + 1]], end_id)

"""Operator 2: token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest vocabulary piece at each place
of a word (continuation pieces after the first). A trie of the pieces, each
node with a failure link and the number of pieces that are complete when the
link is taken, gives the number of pieces of a word in one pass over its
letters: no piece is built and no place is read twice.

The word mark alone is a beginning too, if the vocabulary has it: a word that no
other piece begins is the mark and continuations. With byte pieces, a character
that no continuation begins with counts by its UTF-8 bytes, so every word has a
segmentation. Without them, words without one count as one unknown token.

The automaton has a node per prefix of the vocabulary's pieces, whatever the
corpus' size. Defined cases: a null text is an empty one (no tokens); rows with
equal doc_ids are counted each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb

# Counts remembered by a Python worker.
MEMORY_WORDS = 300_000
UNKNOWN = -1
MARK = "\u2581"


class Automaton:
    """``first`` pieces begin words (the empty one: the word mark alone);
    ``later`` pieces continue them. With ``byte_pieces``, a place where no piece
    fits takes a piece per byte of its character (or of the word mark)."""

    def __init__(self, first: Iterable[str], later: Iterable[str], byte_pieces: bool = False):
        first, later = set(first), set(later)
        self.byte_pieces = byte_pieces
        # Characters of pieces that are no continuation themselves; others are met in ``pieces`` only.
        spelled = {c for piece in first | later for c in piece} - later if byte_pieces else set()
        # Node 0 is the root of beginnings, node 1 that of continuations.
        self.next: list[dict[str, int]] = [{}, {}]
        complete = [0, 0]  # the tokens of a piece that ends here, 0: none does
        for root, pieces in ((0, first), (1, later | spelled)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.next[node].get(c)
                    if to is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        complete.append(0)
                    node = to
                if piece:
                    complete[node] = len(piece.encode()) if root and piece in spelled else 1
        # link: where to go on when no child fits (None: the word has no
        # segmentation); pops: the pieces complete by then.
        self.link: list[int | None] = [None] * len(self.next)
        self.pops = [0] * len(self.next)
        if "" in first or byte_pieces:
            self.link[0], self.pops[0] = 1, 1 if "" in first else len(MARK.encode())
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if complete[child]:
                    self.link[child], self.pops[child] = 1, complete[child]
                else:
                    z, pops = self.link[node], self.pops[node]
                    while z is not None and c not in self.next[z]:
                        pops += self.pops[z]
                        z = self.link[z]
                    if z is not None:
                        self.link[child], self.pops[child] = self.next[z][c], pops
                queue.append(child)
        self.known: dict[bytes, int] = {}

    def pieces(self, word: str) -> int:
        """The pieces of ``word``; ``UNKNOWN`` if it has no segmentation."""
        node, n = 0, 0
        following, link, pops = self.next, self.link, self.pops
        for c in word:
            to = following[node].get(c)
            while to is None:
                if node == 1 and self.byte_pieces:
                    n += len(c.encode())
                    to = 1
                    break
                n += pops[node]
                node = link[node]
                if node is None:
                    return UNKNOWN
                to = following[node].get(c)
            node = to
        while node > 1:
            n += pops[node]
            node = link[node]
            if node is None:
                return UNKNOWN
        return n

    def count(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) + len(words) > MEMORY_WORDS:
            self.known.clear()
        out = np.empty(len(words), dtype=np.int64)
        for k, word in enumerate(words):
            n = self.known.get(word)
            if n is None:
                n = self.known[word] = self.pieces(word.decode())
            out[k] = n
        return out


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Beginnings (pieces with the word mark, without it; the mark alone is the
    empty one) and continuations of a sentencepiece vocabulary, without its
    control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = [], []
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k)
        (first if piece.startswith(MARK) else later).append(piece.removeprefix(MARK))
    return first, later


def has_byte_pieces(path: str) -> bool:
    """The vocabulary has a piece for each byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(k) for k in range(model.get_piece_size())) == 256


_MADE: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _MADE:
        _MADE[path] = Automaton(*sentencepiece_pieces(path), has_byte_pieces(path))
    return _MADE[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words are one each), n_unknown, and
    longest_word_tokens for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            parts = []
            for first, end, data, offsets in tb.slices(batch.column(1)):
                w = tb.words(data, offsets)
                ids, distinct = tb.encode_words(data, w)
                n = machine.count(distinct.to_pylist())[ids] if len(ids) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(end - first), w.counts)
                most = np.zeros(end - first, dtype=np.int64)
                np.maximum.at(most, row, np.abs(n))
                total = lambda x: np.bincount(row, weights=x, minlength=end - first).astype(np.int64)  # noqa: E731, B023
                parts.append((w.counts.astype(np.int64), total(np.abs(n)), total(n == UNKNOWN), most))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]],
                                                 names=["doc_id", "n_words", "n_tokens", "n_unknown", "longest_word_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_unknown long, longest_word_tokens long")

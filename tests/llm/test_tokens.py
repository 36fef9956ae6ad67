"""Batch encoding against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from creditspark.llm import textbatch as tb
from creditspark.llm import tokens as tk

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'s", "'t", "é", "ñ", "中", " ", "\u0085", "　", " ", " ",
         "\x1c", "1", "!", ".", ",", "\r\n", "😀", "word", "  x", "²", "<|endoftext|>", "_", "-", " '", "ç", "\v"]


def texts(n=6000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", None, " ", "\n", "x" * 5000]


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(tk, "MEMORY_PIECES", 3000)  # the memory starts anew now and then
    rows = texts()
    want = Tokenizer.from_file(PATH).encode_batch([r or "" for r in rows], add_special_tokens=False)
    tk.Encoder._made.clear()
    for (row, ids), e in zip(tk.encoded(pa.array(rows), PATH, 0), want, strict=True):
        assert ids.tolist() == [*e.ids, 0], rows[row]
    tk.Encoder._made.clear()


class Counting:
    """A tokenizer that notes how many strings it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, strings, **kwargs):
        self.strings += len(strings)
        return self.tokenizer.encode_batch_fast(strings, **kwargs)


def check(encoder, path, rows):
    want = Tokenizer.from_file(path).encode_batch([r or "" for r in rows], add_special_tokens=False)
    for first, end, data, offsets in tb.slices(pa.array(rows), limit=3000):
        ids, at = encoder.encode(data, offsets)
        for d in range(end - first):
            assert ids[at[d]: at[d + 1]].tolist() == want[first + d].ids, rows[first + d]


def distinct_words(n, seed=11):
    rng = random.Random(seed)
    return ["x" + "".join(rng.choice("abcdeéßñ") for _ in range(9)) + str(k) for k in range(n)]


def test_new_pieces_are_given_to_the_library_many_in_one_string():
    encoder = tk.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    words = distinct_words(20_000)
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    ids, _ = encoder.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(" ".join(words), add_special_tokens=False).ids
    assert encoder.tokenizer.strings <= len(words) // 50


def test_pieces_joined_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(tk, "JOINED_PIECES", 3)
    monkeypatch.setattr(tk, "CALL_PIECES", 7)
    monkeypatch.setattr(tk, "MEMORY_PIECES", 500)
    words = distinct_words(900)
    check(tk.Encoder(PATH), PATH, [" ".join(words[k: k + 9]) for k in range(0, 900, 5)] + texts(1500, 7))


def test_pieces_are_encoded_apart_where_ids_do_not_end_with_them(tmp_path):
    """A special string over two pieces, and a vocabulary whose tokens are no bytes."""
    path, tokenizer = str(tmp_path / "t.json"), Tokenizer.from_file(PATH)
    tokenizer.add_special_tokens(["<a b"])
    tokenizer.save(path)
    rows = ["x <a", "y b z", "no <a b here", " <a"]
    check(tk.Encoder(path), path, rows + texts(500, 9))
    for sizes in (np.zeros, np.ones):
        encoder = tk.Encoder(PATH)
        encoder.sizes = sizes(len(encoder.sizes), dtype=np.int64)
        check(encoder, PATH, distinct_words(300) + rows)


def test_memory_is_bounded_in_ids(monkeypatch):
    """Long pieces, of which each text here is one, leave nothing behind."""
    monkeypatch.setattr(tk, "MEMORY_PIECES", 400)
    encoder = tk.Encoder(PATH)
    rng = random.Random(2)
    rows = ["".join(rng.choice("中文字典語") for _ in range(400)) for _ in range(60)]
    check(encoder, PATH, rows)
    assert len(encoder.known) == len(encoder.coded) == len(encoder.met) == 0
    check(encoder, PATH, [" ".join(distinct_words(300, seed)) for seed in range(6)])
    assert len(encoder.known) == len(encoder.coded) == len(encoder.met) <= 400


def test_words_equal_bytes_split():
    rows = texts(2000, 5)
    seen = 0
    for first, end, data, offsets in tb.slices(pa.array(rows), limit=500):
        w = tb.words(data, offsets)
        ids, names = tb.encode_words(data, w)
        for d in range(end - first):
            want = (rows[first + d] or "").encode().split()
            got = [names[int(i)].as_py() for i in ids[w.first[d]: w.first[d + 1]]]
            assert got == want
            seen += 1
    assert seen == len(rows)


def test_lower_ascii_leaves_other_letters():
    data = np.frombuffer("AÉz".encode(), dtype=np.uint8)
    assert tb.lower_ascii(data).tobytes().decode() == "aÉz"

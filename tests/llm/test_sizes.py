"""Numbers of ids: those of the tokenizer, without encoding a common word twice."""

import numpy as np
import pyarrow as pa
import pytest

from tarnflow.llm import tokens


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


ALPHABET = [*"abzAZ09éÉßÿÞµªøİıſσςΣжЖ中のे.,'<|>-_$ \n\t\r ́ ", "don't", "Übermäßig", "<|endoftext|>", "aa" * 40, "İ", "ﬁ"]


@pytest.mark.parametrize("remembered", [40, tokens.REMEMBERED])
def test_numbers_are_those_of_the_tokenizer(encode, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    r = np.random.default_rng(17)
    texts = ["".join(r.choice(ALPHABET, int(r.integers(0, 14)))) for _ in range(12_000)] + [None, "", " ", "ÀÉ été À.", "x" * 200]
    known = tokens.Sizes(tokens.tokenizer_path())
    assert known._direct
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        assert tokens.numbers(part, known).tolist() == tokens.numbers(pa.array(part, pa.large_string()), known).tolist() == [encode(t) for t in part]
    assert len(tokens.numbers([], known)) == 0


def test_without_the_short_cut_numbers_are_the_same(encode):
    known = tokens.Sizes(tokens.tokenizer_path())
    known._direct = False
    texts = ["Été où la reine, the words", "Straße ÀÉ", "жж 中"]
    assert tokens.numbers(texts, known).tolist() == [encode(t) for t in texts]


def test_common_words_are_encoded_once(monkeypatch):
    """More words than are remembered: what every part holds is kept, what only one part held goes."""
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    known, seen = tokens.Sizes(tokens.tokenizer_path()), []
    counted = known._counted
    known._counted = lambda new: seen.extend(new.to_pylist()) or counted(new)
    spelt = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    common = [spelt(i) for i in range(100)]
    for part in range(60):
        tokens.numbers([" ".join([*common, *(spelt(1000 + 50 * part + i) for i in range(50))])], known)
    assert all(seen.count(w) == 1 for w in common) and len(known._words) <= 4 * 400
    assert len(seen) == 1 + 100 + 60 * 50  # the empty end of words too

"""Token ids of whole texts by a public tokenizer, white-space run by white-space run."""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarnflow.llm.shared import kept

#: File of the tokenizer that the queries use; its pre-tokens never span white space, so texts can be cut there.
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 150_000
#: A run that ends with a plain letter or digit and then ASCII punctuation: nothing joins the two, so each has its own tokens.
PARTED = r"(?s)^(?P<word>.*[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?P<end>[[:punct:]]*)$"
#: Words of these letters only are one pre-token; normalised, they are lower-cased and nothing else.
LATIN = r"^[a-zÀ-ÖØ-öø-ÿ]{1,64}$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Ids(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers. Bounded: many() empties it when it is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        tokenizer = Tokenizer.from_file(path)
        self._encode, self.model = tokenizer.encode_batch_fast, tokenizer.model
        plain = Tokenizer.from_file(path)  # for lower-case ASCII words, which nothing but white space has to part
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._encode_plain = plain.encode_batch_fast
        self._ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        for token, i in tokenizer.get_vocab().items():
            self._ends[i] = token.endswith("</w>")

    def whole(self, text: str, plain: bool = False) -> np.ndarray:
        return np.array((self._encode_plain if plain else self._encode)([text], add_special_tokens=False)[0].ids, "<u4")

    def many(self, words: list[str]) -> list[bytes]:
        """The ids of some words."""
        if len(self) > REMEMBERED:
            self.clear()
        found = [*map(self.get, words)]
        gaps = [i for i, x in enumerate(found) if x is None]
        new = [words[i] for i in gaps]
        own = self.encoded(new)
        self.update((w, ids) for w, ids in own.items() if len(w) <= 64)
        for i in gaps:
            found[i] = own[words[i]]
        return found

    def encoded(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words, which aren't remembered. Those of letters only are encoded many in one go: each ends with its first token that ends a word."""
        letters = [w for w in new if w.isalpha() and len(w) <= 64]
        ascii_ = [w for w in letters if w.isascii()]
        own: dict[str, bytes] = {"": b""}
        for plain, some in ((True, ascii_), (False, [w for w in letters if not w.isascii()])):
            for low in range(0, len(some), 1000):
                part = some[low : low + 1000]
                ids = self.whole(" ".join(part), plain)
                cuts = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
                if len(cuts) == len(part):
                    raw = ids.tobytes()
                    own.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for w in new:
            if w not in own:
                own[w] = self.whole(w).tobytes()
        return own


def ids(path: str) -> Ids:
    """One per Python worker."""
    return kept(("ids", path), lambda: Ids(path))


class Sizes:
    """Words and the number of their ids, for those who need no more. Whole arrays of words are looked up at once and only new ones become strings. Bounded: of too many words, those met least lately go."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self._ids = Ids(path)
        self._model = self._ids.model.tokenize
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7)]
        self._spelt = {ord(c): spelt(c)[0][0] for c in letters}
        probe = [*letters, *string.ascii_lowercase, "the", "words", "été", "Übermäßig"]
        self._direct = self._latin(probe) == [len(self._ids.whole(w)) for w in probe]  # else the tokenizer does more to words than its model
        self._words, self._sizes, self._met = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._turn, self._most = 0, REMEMBERED

    def _latin(self, words: list[str]) -> list[int]:
        return [len(self._model(w)) for w in "\n".join(words).lower().translate(self._spelt).split("\n")]

    def _counted(self, new: pa.Array) -> np.ndarray:
        latin = pc.and_(pc.match_substring_regex(new, LATIN), self._direct)
        plain, out = latin.to_numpy(zero_copy_only=False), np.zeros(len(new), np.int64)
        if plain.any():
            out[plain] = self._latin(new.filter(latin).to_pylist())
        rest = new.filter(pc.invert(latin)).to_pylist()
        own = self._ids.encoded(rest)
        out[~plain] = [len(own[w]) // 4 for w in rest]
        return out

    def many(self, words: pa.Array) -> np.ndarray:
        """The number of ids of each of some words."""
        words, self._turn = words.cast(pa.string()), self._turn + 1
        at = pc.index_in(words, value_set=self._words)
        old, known, out = at.drop_null().to_numpy(), at.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        self._met[old] = self._turn
        out[known] = self._sizes[old]
        new = words.filter(at.is_null())
        out[~known] = own = self._counted(new)
        short = pc.less_equal(pc.utf8_length(new), 64)
        own = own[short.to_numpy(zero_copy_only=False)]
        self._words = pa.concat_arrays([self._words, new.filter(short)])
        self._sizes, self._met = np.concatenate([self._sizes, own]), np.concatenate([self._met, np.full(len(own), self._turn)])
        self._most = min(max(self._most, 4 * len(words)), 4 * REMEMBERED)  # a look-up goes through all that are remembered
        if len(self._words) > self._most:
            last = np.sort(np.argsort(-self._met, kind="stable")[: self._most // 2])
            self._words, self._sizes, self._met = self._words.take(pa.array(last)), self._sizes[last], self._met[last]
        return out


def sizes(path: str) -> Sizes:
    """One per Python worker."""
    return kept(("sizes", path), lambda: Sizes(path))


def parted(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, pa.DictionaryArray]:
    """The runs of some texts between blanks, tabs and line ends: which run each is, where each text's begin and their number last; and of each different run the word, with A-Z lower-cased, and the punctuation that ends it."""
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    for blank in "\n\t\r":
        texts = pc.replace_substring(texts, blank, " ")
    parts = pc.split_pattern(texts, " ")
    runs = pc.dictionary_encode(parts.values)
    each = runs.dictionary
    found = pc.extract_regex(each, PARTED)
    whole = pc.or_(pc.match_substring(each, "<|"), pc.is_null(found))  # may be a special token, or can't be parted
    word = pc.if_else(whole, each, pc.struct_field(found, "word"))
    word = pc.if_else(pc.match_substring(word, "<|"), word, pc.ascii_lower(word))
    end = pc.if_else(whole, "", pc.struct_field(found, "end"))
    return runs.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64), pc.dictionary_encode(word), pc.dictionary_encode(end)


class Words:
    """The words of some texts and the punctuation after each: `names` (each once), `which` (of all, in order), `first` (those of each text, and their number last).

    Words stand between blanks, tabs and line ends; A-Z are lower-cased. Null is an empty text.
    """

    def __init__(self, texts: pa.Array | list[str | None]):
        runs, first, word, end = parted(texts)
        self.names: list[str] = word.dictionary.to_pylist() + end.dictionary.to_pylist()
        both = np.stack([word.indices.to_numpy(), end.indices.to_numpy() + len(word.dictionary)], axis=1)
        self.which = both[runs].ravel()
        self.first = 2 * first

    def sums(self, of_name: np.ndarray) -> np.ndarray:
        """For each text the sum of a number that each name has."""
        return np.add.reduceat(of_name[self.which], self.first[:-1]) if len(self.first) > 1 else np.zeros(0, np.int64)


def _lengths(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def encoded(texts: pa.Array | list[str | None], known: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other; and where each begins, and their number last."""
    words = Words(texts)
    raw = known.many(words.names)
    flat, size = np.frombuffer(b"".join(raw), "<u4"), _lengths(raw)
    n, begin = size[words.which], (np.cumsum(size) - size)[words.which]
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])], upto[words.first]


def counts(texts: pa.Array | list[str | None], known: Ids) -> np.ndarray:
    """The number of ids of each text."""
    words = Words(texts)
    return words.sums(_lengths(known.many(words.names)))


def numbers(texts: pa.Array | list[str | None], known: Sizes) -> np.ndarray:
    """The same, without the ids: each different word and punctuation is looked up once, and each different run added up once."""
    runs, first, word, end = parted(texts)
    n = known.many(pa.concat_arrays([word.dictionary, end.dictionary]))
    of_run = n[word.indices.to_numpy()] + n[len(word.dictionary) + end.indices.to_numpy()]
    return np.add.reduceat(of_run[runs], first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)

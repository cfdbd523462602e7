"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import narrowed, tidy, unit

#: The classifier is fitted on about so many labelled documents of each language, at most so many languages and n-grams.
SAMPLE, LANGUAGES, GRAMS = 2_500, 200, 60_000
#: Longest n-gram; n-grams of a word overlap, so its likelihood is taken to this power; cost of a language in the set, times half a log of the words.
ORDER, POWER, PENALTY = 3, 0.4, 2.0
#: What a fit may lack in log likelihood, provably; rounds after which it is left all the same; words that a worker remembers; characters of new words summed at once.
LACK, ROUNDS, REMEMBERED, CHARACTERS = 0.1, 1_000, 150_000, 100_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and, for each n-gram, its log probability in each of them.

    Learns from rows whose text and label aren't null: about `sample` documents
    of each language, drawn by a hash of the id. n-grams are counted where
    the documents are; the most frequent GRAMS reach the driver, with a count for each
    language. Labels are any strings, told apart by every character. Without
    labelled rows both are empty. Rows of a null id are drawn like others, repeated rows count each.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    langs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not langs:
        return [], {}
    rate = F.create_map(*(F.lit(x) for lang, n in langs.items() for x in (lang, min(1.0, sample / n))))
    drawn = rows.where(unit("doc_id", seed=4) < F.coalesce(F.try_element_at(rate, "lang"), F.lit(0.0))).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for pdf in frames:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, own in words.items():
            grams: Counter = Counter()
            for word, n in own.items():
                for g in grams_of(word):
                    grams[g] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    names = sorted(langs)
    place = F.create_map(*(F.lit(x) for i, lang in enumerate(names) for x in (lang, i)))
    counts = drawn.mapInPandas(tidy(count), "lang string, gram string, n bigint").groupBy("gram", F.try_element_at(place, "lang").alias("at")).agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("at", "n")).alias("held")).orderBy(F.desc("total"), "gram").limit(GRAMS).select("gram", "held").toPandas()
    table = np.full((len(top), len(names)), 0.5)
    for k, held in enumerate(top["held"]):
        for at, n in held:
            table[k, at] += n
    order = top["gram"].str.len().to_numpy()
    for n in range(1, ORDER + 1):
        table[order == n] /= table[order == n].sum(axis=0, keepdims=True)
    return names, dict(zip(top["gram"], np.log(table), strict=True))


class Words(dict):
    """word -> row of logs, its log likelihood in each language. Bounded: predict() empties it when it is full."""

    def __init__(self, grams: dict[str, np.ndarray], languages: int):
        super().__init__()
        self._chars = np.unique(_codes("".join(grams)))
        self._sums = np.stack([*grams.values(), np.zeros(languages)]) if grams else np.zeros((1, languages))
        self._keys = []  # for each length, the n-grams as numbers in order, and their rows in _sums
        for n in range(1, ORDER + 1):
            own = np.array([i for i, g in enumerate(grams) if len(g) == n], np.int64)
            text = "".join(g for g in grams if len(g) == n)
            keys = self._numbers(self._letters(_codes(text)), n)[::n] if text else np.zeros(0, np.int64)
            order = np.argsort(keys)
            self._keys.append((keys[order], own[order]))
        self.logs = np.zeros((1024, languages))

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of characters from 1 on; 0 for one that no n-gram has."""
        at = np.minimum(np.searchsorted(self._chars, codes), max(len(self._chars) - 1, 0))
        return np.where(self._chars[at] == codes, at + 1, 0) if len(self._chars) else np.zeros(len(codes), np.int64)

    def _numbers(self, letters: np.ndarray, n: int) -> np.ndarray:
        """The n-gram that starts at each place, but for the last n - 1, as a number; -1 with an unknown character."""
        size = len(letters) - n + 1
        out, known = np.zeros(size, np.int64), np.ones(size, bool)
        for i in range(n):
            own = letters[i : i + size]
            out = out * (len(self._chars) + 1) + own
            known &= own > 0
        return np.where(known, out, -1)

    def learn(self, words: list[str]) -> None:
        """Sum the n-grams of new words, about CHARACTERS at once; unknown n-grams favour no language."""
        part, held = [], 0
        for word in words:
            part.append(word)
            held += len(word)
            if held >= CHARACTERS:
                self._learn(part)
                part, held = [], 0
        if part:
            self._learn(part)

    def _learn(self, words: list[str]) -> None:
        text = f"^{'$^'.join(words)}$"
        letters = self._letters(_codes(text))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        left = np.repeat(first + sizes, sizes) - np.arange(len(letters))  # characters of the word from here on
        total = np.zeros((len(letters), self._sums.shape[1]))
        for n, (keys, rows) in enumerate(self._keys, 1):
            if len(keys):
                own = self._numbers(letters, n)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                inside = (keys[at] == own) & (left[: len(own)] >= n)
                if n == 1:
                    inside &= left > 1
                    inside[first] = False
                total[: len(own)] += self._sums[np.where(inside, rows[at], len(self._sums) - 1)]
        low, high = len(self), len(self) + len(words)
        if high > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(high, 2 * len(self.logs)) - len(self.logs), self.logs.shape[1]))])
        self.logs[low:high] = np.add.reduceat(total, first) * POWER
        self.update(zip(words, range(low, high), strict=True))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _part(sizes: np.ndarray, own: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows by document, those of some documents."""
    mine = np.repeat(own, sizes)
    return tuple(r[mine] for r in rows)


def _fit(sizes: np.ndarray, c: np.ndarray, like: np.ndarray, shares: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares by expectation-maximisation among the languages that have one, their log likelihood, and what the best lacks to it at most.

    The likelihood is concave, so its slopes bound what any other shares can gain. A document is
    done when that is under LACK, or when no shares can reach `enough`.
    """
    shares, at, lack, left = shares.copy(), np.zeros(len(sizes)), np.zeros(len(sizes)), np.arange(len(sizes))
    for i in range(ROUNDS):
        first, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        own, n = shares[left], np.add.reduceat(c, first)
        p = np.maximum((like * own[doc]).sum(axis=1), 1e-300)
        slope = np.add.reduceat(like * (c / p)[:, None], first)
        at[left] = np.add.reduceat(c * np.log(p), first)
        lack[left] = np.where(own > 0, slope, 0).max(axis=1) - n
        more = lack[left] > LACK
        if enough is not None:
            more &= at[left] + lack[left] > enough[left]
        if not more.any() or i == ROUNDS - 1:
            break
        own = own * slope
        shares[left[more]] = (own / own.sum(axis=1, keepdims=True))[more]
        if not more.all():
            c, like = _part(sizes, more, c, like)
            sizes, left = sizes[more], left[more]
    return shares, at, lack


def mixtures(sizes: np.ndarray, c: np.ndarray, ll: np.ndarray) -> np.ndarray:
    """For each document (of so many distinct words; their counts; their log likelihoods) the proportions of the languages; all at once.

    Starts from all languages. A document has one language if no mixture can gain
    what a second one costs. From the others the one of the least share is
    dropped, and the set of the best likelihood less PENALTY / 2 * log(words) for each language is taken.
    """
    first = np.cumsum(sizes) - sizes
    like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -50))
    alone = np.add.reduceat(c[:, None] * np.log(like), first)
    words = np.log(np.add.reduceat(c, first) + 1)
    enough = alone.max(axis=1) + PENALTY / 2 * words
    shares, fit, lack = _fit(sizes, c, like, np.full(alone.shape, 1 / alone.shape[1]), enough)
    out = np.eye(alone.shape[1])[alone.argmax(axis=1)]
    open_ = fit + lack > enough
    if not open_.any():
        return out
    c, like = _part(sizes, open_, c, like)
    sizes, shares, fit, words, alone = sizes[open_], shares[open_], fit[open_], words[open_], alone[open_]
    on, single = np.ones(shares.shape, bool), out[open_]
    best, chosen = alone.max(axis=1), single
    while True:
        score = fit - PENALTY / 2 * words * (on.sum(axis=1) - 1)
        chosen = np.where((score > best)[:, None], shares, chosen)
        best = np.maximum(best, score)
        if on[0].sum() <= 2:
            break
        on[np.arange(len(on)), np.where(on, shares, np.inf).argmin(axis=1)] = False
        shares = np.where(on, shares + 1e-6, 0)
        shares, fit, _ = _fit(sizes, c, like, shares / shares.sum(axis=1, keepdims=True))
    out[open_] = chosen
    return out


def predict(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Language of each whole text: doc_id, lang_pred, score (its share), languages (such as "de:0.90 fr:0.10").

    With keep, these columns of the row come instead of doc_id, so that no join is needed.

    "und" with score 0 where the text is null or has no letter, or no language
    was learned. Each row is judged by its whole text only, so repeated rows agree; of languages
    that fit equally the first by name wins. Other columns never matter, and an empty table gives no rows.
    """
    names, grams = model
    kept = {f"kept_{c}": c for c in keep} if keep else {"doc_id": id_col}
    rows = docs.select(docs[text_col].alias("text"), *(docs[c].alias(k) for k, c in kept.items() if c != text_col))  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(grams, len(names))
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = [words_of(t) if names and t and any(map(str.isalpha, t)) else None for t in part.column(0).to_pylist()]
                pred, score, mix = [UNKNOWN] * len(part), [0.0] * len(part), [None] * len(part)
                own = [k for k, w in enumerate(found) if w]
                if own:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known.learn([w for w in set().union(*(found[k] for k in own)) if w not in known])
                    sizes = np.array([len(found[k]) for k in own])
                    counts = np.fromiter(chain.from_iterable(found[k].values() for k in own), float, sizes.sum())
                    rows_ = np.fromiter(map(known.__getitem__, chain.from_iterable(found[k] for k in own)), np.int64, len(counts))
                    shares = mixtures(sizes, counts, known.logs[rows_])
                    for k, s in zip(own, shares, strict=True):
                        top = int(s.argmax())
                        pred[k], score[k] = names[top], float(min(1.0, s[top]))
                        mix[k] = " ".join(f"{names[j]}:{s[j]:.2f}" for j in np.argsort(-s, kind="stable") if s[j] >= 0.005)
                new = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "languages": pa.array(mix, pa.string())}
                yield pa.RecordBatch.from_pydict({k: part.column("text" if c == text_col else k) for k, c in kept.items()} | new)

    types = docs.select(*(docs[c].alias(k) for k, c in kept.items())).schema.add("lang_pred", "string").add("score", "double").add("languages", "string")
    out = rows.mapInArrow(tidy(run), types)
    return out.withColumnsRenamed(kept) if keep else out


def held_out(doc_id: Column) -> Column:
    """A quarter of all ids, by a checksum: never learned from. A null id isn't one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

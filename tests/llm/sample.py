"""Small documents with nulls, empty texts, copies, near copies, long words and other scripts."""

import numpy as np

COLUMNS = "doc_id long, text string, lang string, source string, size long, row long, key string, n long, label string, hash long, digest string, block int, piece int, home int, cls long, word string"
OTHERS = ("en", "s", 1, 2, "k", 3, "l", 4, "d", 5, 6, 7, 8, "w")


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))


BASE = words(1, 60)
NEAR = BASE.replace(BASE.split()[30], "zzzz", 1)
TEXTS = [None, "", " \n", BASE, BASE.upper(), NEAR, words(2, 40), words(3, 3000), "A b c", "a B C", words(2, 40), "12 34", "ünï 'don't\tX", "HADİ.", "x" * 70_000]

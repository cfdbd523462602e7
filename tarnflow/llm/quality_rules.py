"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering from labelled statistics; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import narrowed, save, unit

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A window's key is the top of its hash above its place; 31 bits hold any place in a text.
PLACE = (1 << 31) - 1
WINDOW = 3


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows that the text holds twice or more.

    Windows whose hashes meet are candidates (sorted longs, so equal hashes lie side by side); candidates alone are
    then sorted by their words, so that hashes that meet by chance don't count.
    """
    word, n = lambda i: F.get("words", i), F.size("words")
    hashed = lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("keys", F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), hashed)))
    near = lambda k, j: F.coalesce(k.bitwiseXOR(F.get("keys", j)).between(0, PLACE), F.lit(False))
    rows = rows.withColumn("may", F.filter("keys", lambda k, j: near(k, j - 1) | near(k, j + 1)))
    place = lambda k: k.bitwiseAND(F.lit(PLACE)).cast("int")
    gram = lambda p: F.concat_ws(" ", word(p), word(p + 1), word(p + 2))
    rows = rows.withColumn("grams", F.sort_array(F.transform("may", lambda k: F.struct(gram(place(k)).alias("g"), place(k).alias("p")))))
    same = lambda x, j: F.coalesce(x["g"] == F.get("grams", j)["g"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("grams", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))
    covered = F.aggregate(again, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n")))
    return rows.withColumn("n_repeat_words", covered["n"]).drop("keys", "may", "grams")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text. A null text has none; it and an empty one count 0 everywhere."""
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("marks", F.regexp_replace("text", f"[^A-Z0-9!?{SYMBOLS}]+", ""))
    left = lambda chars: F.octet_length(F.regexp_replace("marks", f"[^{chars}]+", "")).cast("long")
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        left(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
        left("A-Z").alias("n_capitals"),
        left("0-9").alias("n_digits"),
        left("!?").alias("n_cries"),
    )
    # a later filter isn't pushed below a generator, where it would split the text again for each word
    return _repeated(rows).select("doc_id", F.inline(F.array(counts)))


def base_failed() -> Column:
    """The fixed rule before the learned ones: too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, of: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))


#: What conditions are about: rates of the statistics, so that they hold for texts of any length.
FEATURES: dict[str, tuple[str, str]] = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_char": ("n_symbols", "word_chars"), "capitals_per_char": ("n_capitals", "word_chars"), "digits_per_char": ("n_digits", "word_chars"), "cries_per_char": ("n_cries", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"), "distinct_words": ("n_distinct_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


class Condition(NamedTuple):
    """A rate is at least `cut` (above), or under it."""

    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        rate = _share(*FEATURES[self.feature])
        return rate >= self.cut if self.above else rate < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def verdict(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The list as ordered conditional expressions: which rule rejects a row (null: none does), and whether it is kept."""
    fires = F.lit(None).cast("string")
    for rule in reversed(rules):
        fires = F.when(_all([c.holds() for c in rule]), " and ".join(map(str, rule))).otherwise(fires)
    return fires, fires.isNull()


#: A feature's thresholds are so many quantiles of each class of labels, with its ends; share of the labelled rows that rules grow on, the others prune them.
CUTS, GROW = 40, 2 / 3


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a condition gains on the bad rows it leaves."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, max_rules: int = 20, max_conditions: int = 4, least_precision: float = 0.9, least_bad: int = 3) -> list[Rule]:
    """An ordered list of rules that reject: each grown on two thirds of the rows that no earlier rule took, pruned on the other third.

    labelled: the columns of statistics() and `bad` (boolean); other columns and rows of null `bad` are left out. Rows go to the
    two parts by their statistics, so copies stay together. All labelled rows count; they are
    binned by quantiles of each class and grouped by bins, and each step is one aggregate of (feature, bin) counts, of a size set by parameters.
    A rule grows while it takes good rows, by the condition that gains most; it is cut back to the prefix that does best on the pruning part. Learning ends at a
    rule under `least_precision` or of under `least_bad` bad rows there, and at max_rules. Without rows of both classes there are no rules.
    """
    names = list(FEATURES)
    rates = [_share(*FEATURES[f]).alias(f) for f in names]
    rows = save(labelled.where("bad is not null").select("bad", (unit(*rates, seed=7) < GROW).alias("grows"), *rates), "labelled")
    ranks = [i / CUTS for i in range(CUTS + 1)]
    quantiles = rows.groupBy("bad").agg(*(F.percentile_approx(f, ranks, 10_000).alias(f) for f in names)).collect()
    if len(quantiles) < 2:
        return []
    cuts = {f: sorted({float(v) for q in quantiles for v in q[f]}) for f in names}
    binned = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c <= F.col(f)))
    cells = rows.select("grows", F.array(*map(binned, names)).alias("bins"), F.col("bad").cast("int").alias("bad"))
    left = save(cells.groupBy("grows", "bins").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")), "cells")

    def test(c: Condition) -> Column:
        at = F.get("bins", F.lit(names.index(c.feature)))
        edge = cuts[c.feature].index(c.cut) + 1
        return at >= edge if c.above else at < edge

    def counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in names}
        for r in rows.select(F.posexplode("bins").alias("f", "bin"), "p", "n").groupBy("f", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect():
            out[names[r["f"]]][r["bin"]] = (r["p"], r["n"])
        return out

    def grown() -> Rule:
        rule: Rule = ()
        while len(rule) < max_conditions:
            found = counts(left.where("grows").where(_all([test(c) for c in rule])))
            p0, n0 = (sum(x[k] for x in found[names[0]].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in names:
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    p, n = p + found[f].get(b, (0, 0))[0], n + found[f].get(b, (0, 0))[1]
                    for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        best = max(best, (_gain(x, y, p0, n0), Condition(f, above, cut)), key=lambda g: g[0])
            if best[1] is None or best[0] <= 1e-9:
                break
            rule = (*rule, best[1])
        return rule

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = grown()
        if not rule:
            break
        held = [_all([test(c) for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = [F.sum(F.when(h, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, h in enumerate(held) for c in "pn"]
        got = left.where("not grows").agg(*sums).first()
        worth = [((got[f"p{k}"] or 0), (got[f"n{k}"] or 0)) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), worth[k][0], -k))
        if worth[k][0] < least_bad or worth[k][0] < least_precision * sum(worth[k]):
            break
        rules.append(rule[: k + 1])
        left = left.where(~held[k])
    return rules


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of rows that have a label of quality, 0 (bad) or 1; several labels of an id count as several rows, null ids and other values not at all."""
    known = labels.where(labels["quality"].isin(0, 1)).select(labels["doc_id"], (labels["quality"] == 0).alias("bad"))
    return stats.join(known, "doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document, whether the base rule rejects it, which learned rule does (null: none), and whether it is kept.

    Rules are learned from the labelled documents that the base rule keeps.
    The text is read once; learning and judging work on the stored statistics.
    Null and empty texts count 0 everywhere and fail the base rule. Null ids and
    repeated rows are rows like others (a null id has no label). Without labels of both
    kinds the base rule alone decides. An empty table gives no rows.
    """
    stats = save(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    rules = learn(labelled(stats.where("not base_failed"), labels))
    fires, keeps = verdict(rules)
    return stats.withColumns({"rule": F.when(~F.col("base_failed"), fires), "kept": ~F.col("base_failed") & keeps})

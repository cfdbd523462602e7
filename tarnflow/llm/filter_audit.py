"""How filters interact: what each of five would remove before and after the others, for every order, from a histogram of failure masks."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.shared import heavy, narrowed, salted, save

#: The filters; their place is their bit.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column, words: Column) -> list[Column]:
    """Which of the filters A to D a text fails: few words, few distinct words, many capitals, odd symbols."""
    n = F.size(words)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row. Bits 0 to 3 come from the text alone, bit 4 from a group of the text's digest, whose smallest id stays.

    Only the SHA-256 of a text is grouped, not the text. Common texts are counted first and dealt to several tasks.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col, part=part_col).select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("text"), F.col("words")))]
    rows = save(rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "masks")
    copies = save(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copies")
    all_ = salted(rows, copies.select("digest", "least"), ["digest"], heavy(copies, ["digest"], rows.count()), ["doc_id"], "left")
    again = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    return all_.select("doc_id", "part", (F.col("own") + again).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows for each part. Rows of one id are counted before they meet its labels."""
    flag = lambda c: F.max(F.when(labels[c] == 1, 1).otherwise(0)).cast("long")
    known = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    counted = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    both = counted.join(known, "doc_id", "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic"))


def orders(histogram: DataFrame) -> DataFrame:
    """For every part, order of the filters and step what is kept, removed and lost, from the part's cells alone."""
    plan = [
        {"filter_order": "".join(FILTERS[i] for i in order), "step": step, "filter": FILTERS[k], "before": sum(1 << i for i in order[: step - 1]), "bit": 1 << k}
        for order in permutations(range(len(FILTERS)))
        for step, k in enumerate(order, 1)
    ]
    steps = F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order string, step int, filter string, before int, bit int>>")
    by_part = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = by_part.withColumn("p", F.explode(steps)).select("part", "cells", "p.*")
    before, bit = F.col("before"), F.col("bit")
    fails = lambda x, b: x["mask"].bitwiseAND(b) != 0
    total = lambda which, c="n": F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda acc, x: acc + x[c])
    here = lambda x: fails(x, bit) & ~fails(x, before)
    out = each.select(
        "part", "filter_order", "step", "filter",
        total(lambda x: ~fails(x, before.bitwiseOR(bit))).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x, bit) & fails(x, before)).alias("redundant"),
        total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (a language; the empty string where it is null), order of the five filters and step.

    A null text is empty: it fails A (no words) only. A null id is never a copy of a smaller one and no
    other's smallest id, and it has no labels. Rows that repeat id and text are rows of their own, none of them a copy of a
    smaller id. Of several labels of an id any 1 counts; labels without a document do nothing. Tables without documents give no rows.
    """
    return orders(cells(masks(docs), labels))

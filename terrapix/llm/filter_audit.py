"""Filter interaction audit by a Gray-code walk over the subsets of filters.

Every document is reduced to the mask of the filters it fails and counted in
its part's cell of that mask.  A walk over all subsets in Gray-code order
toggles one filter at a time: each cell keeps the number of active filters
it fails, and the running survivors change only where that number leaves or
reaches 0.  The survivors of the 2**k subsets are stored, and each step of
each order is a difference of two of them; no order is run on documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.sources.store import materialize

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
                "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_fails(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``mask``: failure bits of filters A to D on a text (short, repetitive, shouting, odd signs).

    The split text is a column of its own, so that it is made once; white
    space at either end leaves an empty first or last word, which is no word.
    """
    t = F.col(text)
    parts = F.col("_parts")
    head = (parts[0] == "").cast("long")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    split = docs.withColumn("_parts", F.split(t, SPACE))
    counted = (split.withColumn("_words", F.size(parts) - head - tail)
               .withColumn("_distinct", F.size(F.array_distinct(parts)) - F.greatest(head, tail)))
    fails = [F.col("_words") < 200, 100 * F.col("_distinct") < 50 * F.col("_words"),
             100 * capitals > 3 * F.length(t), t.rlike("[#$%&*|]")]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))
    return counted.withColumn("mask", mask.cast("int")).drop("_parts", "_words", "_distinct")


def walk(cells: Iterable[tuple[int, Sequence[int]]], k: int) -> np.ndarray:
    """states[subset] = survivors' sums of each measure, for all 2**k subsets of active filters.

    ``cells`` are (mask of failed filters, measures).  Consecutive subsets
    differ by one filter, so a step touches only the cells that fail it.
    """
    masks, sums = zip(*cells)
    sums = np.array(sums, dtype=np.int64).reshape(len(masks), -1)
    failing = [[i for i, m in enumerate(masks) if m >> f & 1] for f in range(k)]
    active = [0] * len(masks)
    running = sums.sum(axis=0)
    states = np.zeros((1 << k, sums.shape[1]), dtype=np.int64)
    states[0] = running
    subset = 0
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1
        subset ^= 1 << f
        on = subset >> f & 1
        for i in failing[f]:
            if on:
                if active[i] == 0:
                    running = running - sums[i]
                active[i] += 1
            else:
                active[i] -= 1
                if active[i] == 0:
                    running = running + sums[i]
        states[subset] = running
    return states


def steps(cells: list[tuple[int, Sequence[int]]], letters: str = LETTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    for every order of ``letters``; a cell's measures are (documents, good, toxic)."""
    k = len(letters)
    states = walk(cells, k)
    fails = [sum(s[0] for m, s in cells if m >> f & 1) for f in range(k)]
    alone = [sum(s[0] for m, s in cells if m == 1 << f) for f in range(k)]
    weight = [factorial(size) * factorial(k - 1 - size) for size in range(k)]
    shapley = [sum(weight[s.bit_count()] * int(states[s, 0] - states[s | 1 << f, 0])
                   for s in range(1 << k) if not s >> f & 1) for f in range(k)]
    for order in permutations(range(k)):
        before = 0
        for n, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            yield ("".join(letters[i] for i in order), n, int(states[after, 0]), removed, int(fails[f]) - removed,
                   int(alone[f]), good, toxic, shapley[f])
            before = after


def failure_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bits in the order of ``LETTERS``.

    Bit E marks a text that a smaller doc_id holds too, anywhere in the
    table; equal texts are told by their SHA-256.  Documents whose id is null
    are nobody's copy and nobody's original; rows that repeat the smallest id
    are all originals.  An id is good (toxic) if any of its label rows says so.
    Every text is read once; what is shuffled is a digest a document, and the
    originals are found by an equality of digest and id, so that a text that a
    third of all documents share is no single task.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = materialize(text_fails(texts, "t").select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), "mask"), "llm-fails")
    firsts = (rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
              .withColumn("first", F.lit(True)))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
             .withColumn("spread", F.lit(0).cast("long")))
    # Rows without an id match no label; a second key keeps them from meeting in one task.
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["digest", "id"], "left")
            .withColumn("mask", F.col("mask") + F.when(copy, F.lit(16)).otherwise(F.lit(0)))
            .withColumn("spread", spread).join(marks, ["id", "spread"], "left")
            .groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                         F.coalesce(F.sum("bad"), F.lit(0)).alias("toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  part: str = "lang") -> DataFrame:
    """What each filter removes at each step of each order, a part at a time (``AUDIT_SCHEMA``).

    ``kept`` after the step, ``removed`` here, ``redundant`` (fails the
    filter, gone before), ``unique_fails`` (fails this filter only),
    ``good_lost``, ``toxic_lost`` of the removed, ``shapley`` (removed by the
    filter, summed over all orders).  Every part has all of its orders and
    steps, zeros included; null texts are empty, a null part is the empty
    string, an empty table gives no rows.  Other columns of ``docs`` are not
    read; texts of any length are only counted over.  A part's cells, 32 at
    most, are one row, and parts are walked apart.
    """
    cells = failure_cells(docs, labels, doc_id, text, part)
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk_parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
        for pdf in it:
            for name, found in zip(pdf["part"], pdf["cells"]):
                own = [(int(c["mask"]), (int(c["n"]), int(c["good"]), int(c["toxic"]))) for c in found]
                yield pd.DataFrame([(name, *s) for s in steps(own)], columns=names)

    return lists.mapInPandas(walk_parts, AUDIT_SCHEMA)

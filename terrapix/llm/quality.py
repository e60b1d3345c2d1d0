"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Words are runs of letters and digits or runs of other visible characters;
single words and pairs of neighbours are hashed into a fixed number of
buckets (pairs of one word twice into one more, whatever the word) and
weighted 1 + log(count), scaled to length 1.  Every partition of
the training rows runs FTRL-proximal from the shared state, and the states
are averaged after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapix.llm.text_hash import batches, lay_out, mix64, span_hashes
from terrapix.sources.store import discard, materialize, shuffles_dropped

BITS = 18              # 2**18 buckets bound the model, whatever the corpus
MAX_TRAIN = 40_000     # labelled rows that the model is fitted on, at most (the first by hashed id)
TRAIN_PARTS = 8        # partitions that train apart within a round, at most
PART_ROWS = 5000       # rows of one of them; fewer rows need no averaging
ROUNDS = 10
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.uint8)  # 0: white space, 1: letters, digits and bytes of other scripts, 2: the rest
_KIND[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_REPEAT = np.uint64(0xB5297A4D3F84D5B5)  # hash of the pair of a word with itself


def features(group: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of all texts' n-grams, sorted by text and bucket."""
    buf, first = lay_out(group)
    kind = _KIND[buf]
    edge = np.empty(len(buf), dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(buf))
    word = kind[start] > 0
    start, end = start[word], end[word]
    h = span_hashes(_FOLD[buf], start, end)
    doc = np.searchsorted(first, start, side="right") - 1
    pair = doc[1:] == doc[:-1]
    two = mix64(h[:-1][pair] * np.uint64(3) + h[1:][pair])
    again = pair & (h[1:] == h[:-1])
    three = np.full(int(again.sum()), _REPEAT)
    bucket = np.concatenate([h, two, three]) >> np.uint64(64 - bits)
    owner = np.concatenate([doc, doc[1:][pair], doc[1:][again]])
    key, count = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | bucket, return_counts=True)
    owner, bucket = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=len(group)))
    return owner, bucket, (value / norm[owner])


@dataclass
class Model:
    """FTRL state; the last place of each array is the bias."""

    bits: int = BITS
    z: np.ndarray = field(default=None)
    n: np.ndarray = field(default=None)
    trained: bool = False

    def __post_init__(self):
        if self.z is None:
            self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self) -> np.ndarray:
        return ftrl_weights(self.z, self.n).astype(np.float32)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form minimiser for each coordinate."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[float, np.ndarray, np.ndarray]]) -> None:
    """One online pass over (label, buckets, values); ``z`` and ``n`` are updated in place."""
    for y, idx, x in rows:
        zi, ni = z[idx], n[idx]
        w = ftrl_weights(zi, ni)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        new = ni + g * g
        z[idx] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * w
        n[idx] = new


def train(rows: DataFrame, bits: int = BITS, rounds: int = ROUNDS, parts: int | None = None) -> Model:
    """Fit on ``rows`` (id, text, y), of bounded number.

    Without a row, or with one class only, the model stays untrained.  What
    reaches the driver is the state, of 2**bits numbers, after each round.
    ``parts`` partitions train apart (default: one for each ``PART_ROWS`` rows,
    ``TRAIN_PARTS`` at most).
    """
    def extract(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = 0
            for group in batches(pdf["text"]):
                doc, bucket, value = features(group, bits)
                cut = np.searchsorted(doc, np.arange(len(group) + 1))
                yield pd.DataFrame({
                    "id": pdf["id"].iloc[at:at + len(group)].to_numpy(), "y": pdf["y"].iloc[at:at + len(group)].to_numpy(),
                    "idx": [bucket[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])],
                    "x": [value[a:b].astype(np.float32) for a, b in zip(cut, cut[1:])]})
                at += len(group)

    table = materialize(rows.mapInPandas(extract, "id long, y double, idx array<int>, x array<float>"), "llm-train")
    model = Model(bits)
    n, low, high = table.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if not n or low == high:
        return model
    parts = parts or min(TRAIN_PARTS, -(-n // PART_ROWS))
    dealt = table.repartition(parts, F.xxhash64("id")).sortWithinPartitions(F.xxhash64("id"), "id")
    size = (1 << bits) + 1
    for _ in range(rounds):
        z0, n0 = model.z, model.n
        state = rows.sparkSession.sparkContext.broadcast((z0, n0))

        def one(it: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            z0, n0 = state.value
            z, n, seen = z0.copy(), n0.copy(), False
            for pdf in it:
                seen = seen or len(pdf) > 0
                ftrl_pass(z, n, ((y, np.append(i, size - 1), np.append(x, 1.0).astype(np.float64))
                                 for y, i, x in zip(pdf["y"], pdf["idx"], pdf["x"])))
            if seen:
                moved = np.flatnonzero((z != z0) | (n != n0))
                yield pd.DataFrame({"i": moved, "dz": z[moved] - z0[moved], "dn": n[moved] - n0[moved]})

        # A coordinate's state is the mean over the partitions that moved it.
        with shuffles_dropped(rows.sparkSession):
            moved = (dealt.mapInPandas(one, "i long, dz double, dn double")
                     .groupBy("i").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn"))).toArrow()
        state.destroy()  # or every round's state stays on the executors' disks
        z, n = z0.copy(), n0.copy()
        i = moved["i"].to_numpy()
        z[i] += moved["dz"].to_numpy()
        n[i] += moved["dn"].to_numpy()
        model = Model(bits, z, n, True)
    discard(table)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2 (null id: empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, text, y) of at most ``max_train`` labelled rows outside the held-out fold.

    Labels other than 0 and 1 are left out, repeated label rows count once;
    ids with both labels are left out.  The bound makes the broadcast one of
    known size, so no text is shuffled to find its label.
    """
    y = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
         .groupBy(F.col("doc_id").cast("long").alias("id"))
         .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
         .select("id", F.col("lo").cast("double").alias("y")))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(first_hashed(y, max_train)), "id")


def first_hashed(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``rows`` (id, ...), those whose id's hash is smallest.

    The hash is even, so a threshold from the number of rows leaves little more
    than ``most`` of them, and only those are ordered in one task.
    """
    n = rows.count()
    share = 1.0
    near = rows
    while n > most:
        share = min(share, most / n) * 1.1
        if share >= 1:
            near = rows
            break
        near = rows.where(F.xxhash64("id") < F.lit(int((share - 0.5) * 2.0 ** 64)))
        if near.count() >= most:
            break
    return near.orderBy(F.xxhash64("id"), "id").limit(most)


def scorer(model: Model):
    """A column function text -> probability of label 1, in [0, 1]; null texts count as empty.

    A text without words is scored by the bias alone; an untrained model
    scores every text 1 (it has no ground to reject any).  A text of any length
    is scored whole, one longer than a group of texts in a group of its own.
    """
    bits, trained, w = model.bits, model.trained, model.weights()

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for group in batches(s):
                doc, bucket, value = features(group, bits)
                dot = np.bincount(doc, value * w[bucket], minlength=len(group)) + float(w[-1])
                out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))) if trained else np.ones(len(group)))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return score

"""Document fingerprints by locally consistent parsing.

A text is parsed in levels.  Each level first joins runs of one symbol, then
labels every symbol by deterministic coin tossing (the lowest bit in which it
differs from the symbol before it, repeated until few labels are left) and
starts a phrase at each local maximum of the labels.  A phrase's name is a hash
of its symbols, and the names are the symbols of the next level.  Whether a
phrase starts somewhere depends on a few symbols around it only, so equal
substrings have the same phrases inside, wherever they stand.  A fingerprint
keeps, for three levels, the smallest names of 32 hash classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapix.llm.text_hash import mix64
from terrapix.sources.store import materialize

LEVELS = (2, 3, 4)  # phrases of about 9, 27 and 81 characters
SLOTS = 32
BATCH_CHARS = 1_000_000

_WAY_OUT = np.uint64(0xFFFFFFFFFFFFFFFF)
_POSITION = np.uint64(0x9E3779B97F4A7C15)


def _coin(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """2 * (lowest differing bit) + that bit of ``cur``; equal symbols count as differing in the highest bit."""
    diff = prev ^ cur
    low = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    low = np.minimum(low, np.uint64(63))
    return ((low << np.uint64(1)) | ((cur >> low) & np.uint64(1))).astype(np.uint8)


# Labels after the first toss are below 128 (254: before a text's first symbol),
# so the later tosses are one look-up of (label before, label).
_pairs = np.arange(256, dtype=np.uint64)
_TOSS = _coin(np.repeat(_pairs, 256), np.tile(_pairs, 256))
_OUTSIDE = 254


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols ``x``; neighbours in a text have different ones. ``first``: where texts start."""
    prev = np.empty_like(x)
    prev[1:] = x[:-1]
    prev[first] = _WAY_OUT
    lab = _coin(prev, x)
    for _ in range(3):
        pair = np.empty(len(lab), dtype=np.uint16)
        pair[1:] = lab[:-1]
        pair[first] = _OUTSIDE
        pair = (pair << np.uint16(8)) | lab
        lab = _TOSS[pair]
    return lab


def parse_level(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names and owners of one level. ``owner``: the text of each symbol, ascending."""
    new_text = np.empty(len(x), dtype=bool)
    new_text[0] = True
    np.not_equal(owner[1:], owner[:-1], out=new_text[1:])
    # Runs of one symbol become one symbol.
    head = new_text.copy()
    head[1:] |= x[1:] != x[:-1]
    if not head.all():
        at = np.flatnonzero(head)
        run = np.diff(np.append(at, len(x))).astype(np.uint64)
        x, owner, new_text = x[at], owner[at], new_text[at]
        long_run = run > 1
        x[long_run] = mix64(x[long_run] + run[long_run] * _POSITION)
    lab = _labels(x, np.flatnonzero(new_text))
    # A phrase starts with each text and at each label above both neighbours'.
    start = new_text.copy()
    if len(x) > 2:
        top = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
        start[1:-1] |= top & ~new_text[1:-1] & ~new_text[2:]
    at = np.flatnonzero(start)
    place = np.arange(len(x), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(x)))).astype(np.uint64)
    name = np.add.reduceat(mix64(x + (place + np.uint64(1)) * _POSITION), at)
    return mix64(name), owner[at]


def sketches(texts: list[str]) -> np.ndarray:
    """One row of len(LEVELS) * SLOTS 16-bit values for each text; 0 marks a class without a phrase."""
    out = np.zeros((len(texts), len(LEVELS) * SLOTS), dtype=np.uint16)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return out
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    for level in range(1, max(LEVELS) + 1):
        x, owner = parse_level(x, owner)
        if level in LEVELS:
            h = mix64(x ^ np.uint64(level))
            cls = owner.astype(np.uint64) * np.uint64(SLOTS) + (h >> np.uint64(59))
            key = np.sort((cls << np.uint64(32)) | ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)))
            cls = key >> np.uint64(32)
            least = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            value = mix64(key[least] & np.uint64(0xFFFFFFFF)) % np.uint64(65535) + np.uint64(1)
            text, slot = np.divmod(cls[least].astype(np.int64), SLOTS)
            out[text, LEVELS.index(level) * SLOTS + slot] = value
    return out


def to_hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean over the levels of the share of classes, filled in either text, that hold the same value."""
    shape = (len(a), len(LEVELS), SLOTS)
    a, b = a.reshape(shape), b.reshape(shape)
    filled = ((a > 0) | (b > 0)).sum(axis=2)
    same = ((a == b) & (a > 0)).sum(axis=2)
    per_level = np.where(filled > 0, same / np.maximum(filled, 1), np.nan)
    used = (filled > 0).sum(axis=1)
    return np.where(used > 0, np.nansum(per_level, axis=1) / np.maximum(used, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of ``text`` replaced by as much of the head of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
EDGE = "part int, place int, doc_id long, text string"


def compare(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    """Result rows of documents, each with the text of the next one.

    ``following[i]`` mostly is ``texts[i + 1]``, whose sketch is used again.
    """
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own = sketches([*texts, following[-1]]) if n else sketches([])
    new = sketches(changed)
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": to_hex(own[:n]), "edited_fingerprint": to_hex(new),
        "near_edited": likeness(own[:n], new), "near_next": likeness(own[:n], own[1:])})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; null texts count as empty; equal texts, equal fingerprints."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in cuts(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].astype("Int64"),
                                    "n_chars": [len(t) for t in texts[a:b]], "fingerprint": to_hex(sketches(texts[a:b]))})

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInPandas(run, "doc_id long, n_chars long, fingerprint string"))


def cuts(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of about ``chars`` characters; a longer text stands alone."""
    a = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


def nearest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its edited text's fingerprint and its likeness to that and to the next document.

    The next document is the one before it by doc_id (after the smallest: the
    largest; null ids come last; repeated ids are ordered by a hash of their
    texts).  A sole document is its own next.  Null texts count as empty.
    Likeness is 1 for equal texts, two empty ones too.  A text of any length
    is parsed whole, a very long one in a batch of its own.

    Documents are dealt by ranges in descending order, so that a task holds
    a document and the next one; texts are moved once.  Each task writes its
    finished rows, its first document and its last; the last ones (one a
    task) are then joined to the first document of the next task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    dealt = (body.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
             .select("doc_id", "text"))
    both = RESULT + ", " + EDGE.replace("doc_id long", "edge_id long")
    names = [c.split()[0] for c in both.split(", ")]

    def edge(part: int, place: int, key, t: str) -> pd.DataFrame:
        return pd.DataFrame({c: [None] for c in names}).assign(part=part, place=place, edge_id=pd.array([key], dtype="Int64"),
                                                              text=t)[names]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, held = None, None  # the document that waits for its next one
        for pdf in it:
            ids = [None if pd.isna(k) else int(k) for k in pdf["doc_id"]]
            texts = list(pdf["text"])
            if not texts:
                continue
            if held is None:
                yield edge(part, 0, ids[0], texts[0])
            else:
                ids, texts = [key, *ids], [held, *texts]
            for a, b in cuts(texts[:-1]):
                out = compare(ids[a:b], texts[a:b], texts[a + 1:b + 1])
                yield out.assign(part=None, place=None, edge_id=None, text=None)[names]
            key, held = ids[-1], texts[-1]
        if held is not None:
            yield edge(part, 1, key, held)

    made = materialize(dealt.mapInPandas(run, both), "llm-fingerprints")
    done = made.where("part is null").select([c.split()[0] for c in RESULT.split(", ")])

    # One first and one last document for each task that had rows.
    edges = made.where("part is not null")
    parts = edges.where("place = 0").select("part")
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                                F.min("part").over(ring)).alias("after"))
    heads = edges.where("place = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    last = (edges.where("place = 1").select("part", F.col("edge_id").alias("doc_id"), "text")
            .join(following, "part").join(heads, "after").select("doc_id", "text", "following"))

    def close(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, t, f in zip(pdf["doc_id"], pdf["text"], pdf["following"]):
                yield compare([None if pd.isna(k) else int(k)], [t], [f])

    return done.unionByName(last.mapInPandas(close, RESULT))

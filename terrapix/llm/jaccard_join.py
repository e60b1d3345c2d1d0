"""N-gram Jaccard self-join of documents by the chosen-path method.

A document is its set of five-word shingles.  Equal sets are one class.  A
class is embedded as 64 min-hash tokens (one for each hash region of its
shingles).  A run starts from all classes and picks tokens at random, each
with probability 1 / (threshold * 64); classes that share a picked token's
value go on together.  Small buckets are brute-forced, larger ones split
again by further picks, and what is still large at the last level is
brute-forced in blocks.  A pair at the threshold goes on with one expected
copy a level, so it meets in a run with a known probability, and runs are
repeated until the target recall is reached.

In a bucket, sketches only decide which classes may belong together; the
classes so connected are then compared with their whole sets, so the links
and their numbers are exact for everything the runs brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.llm.components import components
from terrapix.llm.text_hash import batches, lay_out, mix64, names
from terrapix.sources.store import materialize

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
TOKENS = 64
SMALL = 4000           # a bucket of up to so many classes is brute-forced at once
BLOCK_CLASSES = 1024   # whole sets compared in one task: two blocks of about so many classes,
BLOCK_SHINGLES = 400_000  # or so many shingles

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASH_BITS = 44        # of a shingle; the other 20 number the text in its batch
_REGION_BITS = 38      # below the 6 that choose one of 64 regions
_NO_WORDS = 0          # class of texts without a word

# For a region without a shingle: other regions to take the value from, in order.
_DETOUR = np.stack([np.random.default_rng(7 + i).integers(0, TOKENS, TOKENS) for i in range(192)]
                   + [(np.arange(TOKENS) + i) % TOKENS for i in range(1, TOKENS)])

PROFILE = "doc_id long, rowid long, class long, n int, tokens array<long>"


def shingles(group: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number << 44 | shingle hash), sorted and distinct, and the shingles of each text.

    Words are lower-cased and split at white space.  A text with fewer words
    than a shingle has one shingle of all its words; without words, none.
    """
    buf, first = lay_out(group)
    gap = _SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    marks = np.concatenate(([0], edge)) if not gap[0] else edge
    start, end = marks[::2], marks[1::2]  # the buffer ends in white space, so words are closed
    h = names(_LOWER[buf], start, end)
    owner = np.searchsorted(first, start, side="right") - 1
    count = np.bincount(owner, minlength=len(group))
    at = np.concatenate(([0], np.cumsum(count)[:-1]))
    whole = np.flatnonzero(owner[:len(owner) - words + 1] == owner[words - 1:]) if len(owner) >= words else \
        np.empty(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    start_at = np.concatenate([whole, at[short]])
    size = np.concatenate([np.full(len(whole), words), count[short]])
    mixed = size.astype(np.uint64)
    for j in range(words):
        part = h[np.minimum(start_at + j, max(len(h) - 1, 0))] if len(h) else h
        mixed = mix64(mixed * np.uint64(0x100000001B3) + np.where(j < size, part, np.uint64(0)))
    text = np.concatenate([owner[whole], short]).astype(np.uint64)
    key = np.unique((text << np.uint64(_HASH_BITS)) | (mixed >> np.uint64(64 - _HASH_BITS)))
    return key, np.bincount((key >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(group))


def profile(group: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, number of shingles and min-hash tokens of each text."""
    key, n = shingles(group, words)
    low = key & np.uint64((1 << _HASH_BITS) - 1)
    cls = np.full(len(group), _NO_WORDS, dtype=np.uint64)
    filled = np.flatnonzero(n)
    tokens = np.zeros((len(group), TOKENS), dtype=np.uint64)
    if len(filled):
        at = np.concatenate(([0], np.cumsum(n[filled])[:-1]))
        cls[filled] = mix64(np.add.reduceat(mix64(low + np.uint64(1)), at) + n[filled].astype(np.uint64)) | np.uint64(1)
        region = key >> np.uint64(_REGION_BITS)
        least = np.flatnonzero(np.append(True, region[1:] != region[:-1]))  # keys are sorted
        text, slot = np.divmod(region[least].astype(np.int64), TOKENS)
        have = np.zeros(tokens.shape, dtype=bool)
        have[text, slot] = True
        tokens[text, slot] = low[least] + np.uint64(1)
        todo = filled[~have[filled].all(axis=1)]
        original = tokens.copy()
        for other in _DETOUR:
            if not len(todo):
                break
            fill = ~have[todo] & (original[todo][:, other] > 0)
            t, s = np.nonzero(fill)
            tokens[todo[t], s] = original[todo[t], other[s]]
            have[todo[t], s] = True
            todo = todo[~have[todo].all(axis=1)]
    return cls.astype(np.int64), n, tokens.astype(np.int64)


def plain(text: str | None) -> str:
    """Text whose white space and case the byte tables understand."""
    if not isinstance(text, str):
        return ""
    return text if text.isascii() else " ".join(text.lower().split())


def profiles(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """A row for each document; ``rowid`` is equal for rows equal in id and text only."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = 0
            for group in batches(map(plain, pdf["text"])):
                cls, n, tokens = profile(group, words)
                part = pdf.iloc[at:at + len(group)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "rowid": part["rowid"].to_numpy(),
                                    "class": cls, "n": n.astype(np.int32), "tokens": list(tokens)})
                at += len(group)

    return with_rowid(docs, doc_id, text).mapInPandas(run, PROFILE)


def with_rowid(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return body.withColumn("rowid", F.xxhash64("doc_id", "text"))


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    The number of picked tokens that a pair shares has mean 1 in each step
    (close to Poisson), so the pair lives to level d with 1 - exp(-p(d - 1)).
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def candidate_buckets(classes: DataFrame, threshold: float, recall: float, depth: int, small: int) -> DataFrame:
    """(bucket, class) of the buckets to be brute-forced, each with two classes or more.

    ``classes``: class, n, tokens.  Buckets met in several runs with the same members are kept once.
    """
    runs = runs_for(recall, depth)
    rate = 1 / (threshold * TOKENS)
    rng = np.random.default_rng(2018)
    picks = [(r, i) for r in range(runs) for i in range(TOKENS) if rng.random() < rate]
    nodes = F.array(*[F.xxhash64(F.lit(r), F.lit(i), F.col("tokens")[i]) for r, i in picks])
    level = classes.select("class", F.explode(nodes).alias("node"))
    ready = []
    for d in range(depth):
        sizes = level.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        met = materialize(level.join(sizes, "node"), "llm-buckets")
        ready.append(met.where(F.col("members") <= small).groupBy("node")
                     .agg(F.sort_array(F.collect_list("class")).alias("members")))
        large = met.where(F.col("members") > small)
        if d + 1 < depth:
            pick = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)),
                            lambda i: F.pmod(F.xxhash64("node", i), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
            level = (large.select("node", "class").join(classes.select("class", "tokens"), "class")
                     .select("class", "tokens", "node", F.explode(pick).alias("i"))
                     .select("class", F.xxhash64("node", "i", F.col("tokens")[F.col("i")]).alias("node")))
    lists = ready[0]
    for r in ready[1:]:
        lists = lists.unionByName(r)
    buckets = (lists.groupBy(F.xxhash64("members").alias("bucket")).agg(F.first("members").alias("members"))
               .select("bucket", F.explode("members").alias("class")))
    # The last level's large buckets: each class goes into all pairs of its block with another.
    n = F.ceil(F.col("members") / F.lit(small))
    blocked = (large.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("class"), F.col("n")))
               .select("node", "class", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
               .select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "class"))
    return buckets.unionByName(blocked)


def connect_sketches(n: np.ndarray, sketch: np.ndarray, threshold: float) -> np.ndarray:
    """For each member the first member it is connected to by pairs whose sketches may reach the threshold.

    A member is compared with those not yet reached, so a bucket of copies costs one pass.
    """
    root = np.arange(len(n))
    left = np.arange(len(n))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        stack = [seed]
        while stack and len(left):
            v = stack.pop()
            like = (sketch[left] == sketch[v]).mean(axis=1)
            less, more = np.minimum(n[left], n[v]), np.maximum(n[left], n[v])
            slack = 5 * np.sqrt(threshold * (1 - threshold) / np.minimum(less, TOKENS))
            near = (like >= threshold - slack) & (less >= threshold * more - 1e-9)
            root[left[near]] = seed
            stack.extend(left[near].tolist())
            left = left[~near]
    return root


def bucket_edges(buckets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each class and the first one of its connected part, bucket by bucket."""
    short = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(256)).cast("short"))
    rows = (buckets.join(classes.select("class", "n", short.alias("sketch")), "class")
            .groupBy("bucket").agg(F.collect_list(F.struct("class", "n", "sketch")).alias("m")))
    rows = rows.select(F.col("m.class").alias("class"), F.col("m.n").alias("n"),
                       F.flatten("m.sketch").alias("sketch"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            a, b = [], []
            for cls, n, sketch in zip(pdf["class"], pdf["n"], pdf["sketch"]):
                root = connect_sketches(np.asarray(n), np.asarray(sketch).reshape(len(cls), TOKENS), threshold)
                far = np.flatnonzero(root != np.arange(len(root)))
                a.append(np.asarray(cls)[far])
                b.append(np.asarray(cls)[root[far]])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.mapInPandas(run, "a long, b long").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairs' intersections; only shingles of two sets or more are looked at."""
    g = len(sets)
    allof = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(allof, kind="stable")
    allof, owner = allof[order], owner[order]
    head = np.append(True, allof[1:] != allof[:-1]) if len(allof) else np.empty(0, bool)
    column = np.cumsum(head) - 1
    shared = np.bincount(column) > 1 if len(column) else np.empty(0, bool)
    use = shared[column] if len(column) else head
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]] if len(column) else column
    out = np.zeros((g, g), dtype=np.float32)  # counts below 2**24 are exact
    width = max(1, min(8192, 8_000_000 // g))
    for a in range(0, int(shared.sum()) if len(shared) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((g, width), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


LINKS = "class long, root long, texts long, rows long"


def compare_sets(pdf: pd.DataFrame, same_block: bool, threshold: float) -> pd.DataFrame:
    """Links of the classes of one task's two blocks (of one block where ``same_block``)."""
    pdf = pdf.drop_duplicates("class").sort_values("class")
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    n = np.array([len(s) for s in sets])
    both = common_counts(sets)
    linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if not same_block:
        own = pdf["own"].to_numpy()
        linked &= own[:, None] != own[None, :]
    root = np.arange(len(n))
    seen = np.zeros(len(n), dtype=bool)
    for i in range(len(n)):
        if not seen[i]:
            seen[i] = True
            stack = [i]
            while stack:
                more = np.flatnonzero(linked[stack.pop()] & ~seen)
                seen[more] = True
                root[more] = i
                stack.extend(more.tolist())
    cls = pdf["class"].to_numpy()
    out = pd.DataFrame({"class": cls, "root": cls[root], "texts": linked.sum(axis=1),
                        "rows": linked @ pdf["copies"].to_numpy()})
    return out[out["texts"] > 0]


def exact_links(docs: DataFrame, classes: DataFrame, edges: DataFrame, doc_id: str, text: str, words: int,
                threshold: float) -> DataFrame:
    """(class, root, texts, rows), in one row or more for each linked class: its links, split by block pairs.

    Connected classes are dealt into blocks of bounded size, and each pair of
    blocks is compared by one task with whole shingle sets.
    """
    star = components(edges)
    part = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    member = part.select(F.col("node").alias("class"), F.col("root").alias("part")).join(
        classes.select("class", "n", "copies", "rowid"), "class")
    size = member.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_CLASSES)),
                                                 F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    member = materialize(member.join(size, "part")
                         .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks"))), "llm-members")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = 0
            for group in batches(map(plain, pdf["text"])):
                key, n = shingles(group, words)
                low = key & np.uint64((1 << _HASH_BITS) - 1)
                cut = np.concatenate(([0], np.cumsum(n)))
                yield pd.DataFrame({"class": pdf["class"].iloc[at:at + len(group)].to_numpy(),
                                    "shingles": [low[a:b].tobytes() for a, b in zip(cut, cut[1:])]})
                at += len(group)

    chosen = (with_rowid(docs, doc_id, text).join(member.select("rowid", "class"), "rowid")
              .dropDuplicates(["rowid"]).select("class", "text").mapInPandas(run, "class long, shingles binary"))
    dealt = (member.select("class", "part", "copies", "own",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
             .select("class", "part", "copies", "own", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi")))

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return compare_sets(pdf, key[1] == key[2], threshold)

    return chosen.join(dealt, "class").groupBy("part", "lo", "hi").applyInPandas(task, LINKS)


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                  threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH,
                  small: int = SMALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, rowid, class_id, text_id, copies, n_links.

    ``text_id`` is the smallest doc_id with the same shingles and ``copies``
    the number of rows with them; ``n_links`` is the number of other rows with
    similarity of at least ``threshold``, copies included; ``class_id`` is the
    smallest doc_id connected by links.  Links between different texts are
    found with probability ``recall`` or more each.  Null and blank texts have
    no shingles and are copies of each other only.  Null ids are carried along
    (and stand for a class only if it has no other).  Texts of any length are
    compared by all of their shingles; a row's shingles are held by one task.
    """
    prof = materialize(profiles(docs, doc_id, text, words), "llm-profiles")
    classes = materialize(
        prof.groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("text_id"),
                                  F.min("rowid").alias("rowid"), F.first("n").alias("n"),
                                  F.first("tokens").alias("tokens")), "llm-classes")
    worded = classes.where("n > 0")
    buckets = candidate_buckets(worded, threshold, recall, depth, small)
    edges = bucket_edges(buckets, worded, threshold)
    links = materialize(exact_links(docs, worded, edges, doc_id, text, words, threshold), "llm-links")
    star = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    summed = links.groupBy("class").agg(F.sum("rows").alias("rows"))
    info = (classes.select("class", "copies", "text_id")
            .join(summed, "class", "left")
            .join(star.select(F.col("node").alias("class"), "root"), "class", "left")
            .withColumn("root", F.coalesce("root", "class")))
    ids = info.groupBy("root").agg(F.min("text_id").alias("class_id"))
    full = materialize(info.join(ids, "root").select(
        "class", "class_id", "text_id", "copies",
        (F.col("copies") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links")), "llm-class-info")
    return (prof.select("doc_id", "rowid", "class").join(full, "class")
            .select("doc_id", "rowid", "class_id", "text_id", "copies", "n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest (doc_id, hash of the row).

    Groups are those of ``jaccard_links``; of equal rows one stays.  Other columns pass through.
    """
    found = jaccard_links(docs, doc_id, text, **options)
    # A group whose ids are all null has no class_id; its rows are told apart by text then.
    group = F.struct(F.col("class_id").alias("c"), F.when(F.col("class_id").isNull(), F.col("rowid")).alias("r"))
    kept = (found.groupBy(group.alias("g"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rowid")).alias("k"))
            .select(F.col("k.rowid").alias("rowid")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(row.alias("row"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("rowid"))
    one = tagged.join(kept, "rowid").dropDuplicates(["rowid"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])



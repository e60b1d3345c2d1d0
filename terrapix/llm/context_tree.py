"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, numbered like the nodes of a heap (1 is
the first; after bit b of node k comes node 2k + b).  Each decision has a tree of contexts: the
last 0, 1, ... ``DEPTH`` bytes.  A context that saw a zeros and b ones gives
them the Krichevsky-Trofimov probability Pe = G(a + 1/2) G(b + 1/2) / (pi (a + b)!);
its weighted probability is half of Pe plus half of the product of its
longer contexts' (at full depth: Pe).  Both need the counts only, so the
tree is built level by level with grouped sums.  Going down again, each
context stops the mixture with the share of Pe in its weighted sum, which
leaves one probability for each decision in each full context: the exact
prediction of the weighted tree after all training bytes.

Strings of ``DEPTH`` + 1 bytes of texts outside training enter the tree with
a count of 0.  That changes no probability, and gives every string
of the corpus its own, mixed from the depths that training reached.

Texts are dealt into batches.  A batch's different strings and words, with
their counts, go to slices of all strings and words; a slice sums them, and
after the tree is weighed sends every batch the logarithms of its strings.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapix.llm.text_hash import batches
from terrapix.sources.store import discard, materialize

DEPTH = 5               # bytes of context, 5 at most: a string and a text number share 64 bits
END = 0xFF              # ends a text and precedes the next one; no byte of UTF-8
BATCH_BYTES = 24_000_000
GROUP_BYTES = 2_000_000
SLICE_BYTES = 16_000_000  # bytes of text for each slice, where that makes more slices than shuffle partitions
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double, n_bytes long, bits_per_byte double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 10, is 0 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


# ---------------------------------------------------------------- strings of a batch

def strings(group: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, text number, count) of each text's strings of ``depth`` + 1 bytes, in order; one a byte and one for the end."""
    gap = bytes([END]) * max(depth, 1)
    buf = np.frombuffer(gap + gap.join(group) + gap, dtype=np.uint8)
    size = np.fromiter((len(t) + 1 for t in group), dtype=np.int64, count=len(group))
    step = size + len(gap) - 1
    first = np.cumsum(step) - step + len(gap)
    key = buf[len(gap) - depth:].astype(np.uint64)
    have = 1
    while have < depth + 1:  # longer strings from two shorter ones
        add = min(have, depth + 1 - have)
        key = (key[:len(key) - add] << np.uint64(8 * add)) | (key[add:] & np.uint64((1 << 8 * add) - 1))
        have += add
    # Entry i is the string that ends at byte len(gap) + i; those in the gaps go.
    key <<= np.uint64(16)
    keep = np.ones(len(key), dtype=bool)
    if len(gap) > 1:
        past = (first - len(gap) + size)[:, None] + np.arange(len(gap) - 1)
        keep[past[past < len(key)]] = False
    key = key[keep]
    key |= np.repeat(np.arange(len(group), dtype=np.uint64), size)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64), count


def groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about ``GROUP_BYTES`` and fewer than 2**16; a text is never cut."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        if group and (size + len(t) > GROUP_BYTES or len(group) == 1 << 16):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` over equal entries of the sorted ``key``."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[new], (np.add.reduceat(n, new) if len(new) else n[:0])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    return summed(key[order], n[order])


def batch_strings(texts: list[bytes], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's different strings, in order, and how often training texts hold each."""
    keys, counts, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for group in groups(texts):
        key, owner, n = strings(group, depth)
        key, n = summed(key, n * train[at:at + len(group)][owner])
        at += len(group)
        keys.append(key)
        counts.append(n)
        if len(keys) == 16:
            key, n = merged(keys, counts)
            keys, counts = [key], [n]
    return merged(keys, counts)


def batch_words(texts: list[bytes], train: np.ndarray) -> Counter:
    """A batch's different words, and how often training texts hold each."""
    words: Counter = Counter()
    for t, learn in zip(texts, train.tolist()):
        if learn:
            words.update(t.split())
        else:
            for w in t.split():
                words[w] += 0
    return words


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def numbers(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def word_list(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


# ---------------------------------------------------------------- batches and slices

def deal(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row a batch: its ids, training flags and lower-cased texts, packed; about ``BATCH_BYTES`` by running length."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), (~held_out(F.col(f"`{doc_id}`"))).alias("train"),
                       F.col(f"`{text}`").alias("text"), (F.spark_partition_id().cast("long") * (1 << 32)).alias("batch"))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = base = size = 0
        ids, train, texts = [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame({"batch": [base + k], "ids": [ids], "train": [train], "n_train": [sum(train)],
                                 "n_bytes": [size], "texts": [squeeze(bytes([END]).join(texts))]})

        for pdf in it:
            base = int(pdf["batch"].iloc[0]) if len(pdf) else base
            at = 0
            for group in batches(pdf["text"], GROUP_BYTES):
                for b in group:
                    if texts and size + len(b) > BATCH_BYTES:
                        yield row()
                        k, size = k + 1, 0
                        ids, train, texts = [], [], []
                    i = pdf["id"].iloc[at]
                    ids.append(None if pd.isna(i) else int(i))
                    train.append(bool(pdf["train"].iloc[at]))
                    texts.append(b.lower())  # of bytes: A-Z only
                    size += len(b) + 1
                    at += 1
        if texts:
            yield row()

    return materialize(rows.mapInPandas(pack, "batch long, ids array<long>, train array<boolean>, n_train long, "
                                              "n_bytes long, texts binary"), "llm-texts")


def unpack(texts: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(texts).split(bytes([END]))


def tally(dealt: DataFrame, n_slices: int, depth: int) -> DataFrame:
    """(slice, batch, strings, n, words, c): what each batch holds of each slice, packed.

    A slice holds all strings of its contexts, and words by their checksum.
    """
    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for batch, flags, packed in zip(pdf["batch"], pdf["train"], pdf["texts"]):
                texts, train = unpack(packed), np.array(flags, dtype=np.int64)
                key, n = batch_strings(texts, train, depth)
                own = ((key.astype(np.uint64) >> np.uint64(8)) * SPREAD >> np.uint64(32)) % np.uint64(n_slices)
                order = np.argsort(own.astype(np.int32), kind="stable")
                cut = np.searchsorted(own[order], np.arange(n_slices + 1, dtype=np.uint64))
                words = batch_words(texts, train)
                parts: list[list[bytes]] = [[] for _ in range(n_slices)]
                for w in words:
                    parts[zlib.crc32(w) % n_slices].append(w)
                for first in range(0, n_slices, 256):
                    rows = []
                    for s in range(first, min(first + 256, n_slices)):
                        of = order[cut[s]:cut[s + 1]]
                        if len(of) or parts[s]:
                            rows.append((s, batch, squeeze(np.diff(key[of], prepend=0)), squeeze(n[of]),
                                         squeeze(b" ".join(parts[s])),
                                         squeeze(np.fromiter(map(words.__getitem__, parts[s]), np.int64, len(parts[s])))))
                    yield pd.DataFrame(rows, columns=["slice", "batch", "strings", "n", "words", "c"])

    return materialize(dealt.mapInPandas(count, "slice int, batch long, strings binary, n binary, words binary, c binary"),
                       "llm-tally")


def leaf_nodes(string: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of the eight decisions of each of the sorted, different ``string``; node holds the context
    in its higher bits."""
    nodes, zeros, ones = [], [], []
    context, byte = string >> 8 << 8, string & 255
    for j in range(8):
        bit = byte >> (7 - j) & 1
        node, low = summed(context | 1 << j | byte >> (8 - j), n * (1 - bit))
        nodes.append(node)
        zeros.append(low)
        ones.append(summed(context | 1 << j | byte >> (8 - j), n * bit)[1])
    return np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones)


def string_logs(string: np.ndarray, node: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte, from the probability of a one at each of its nodes."""
    order = np.argsort(node)
    node, one = node[order], one[order]
    context, byte = string >> 8 << 8, string & 255
    out = np.zeros(len(string))
    for j in range(8):
        p = one[np.searchsorted(node, context | 1 << j | byte >> (8 - j))]
        out += np.log10(np.where(byte >> (7 - j) & 1, p, 1 - p))
    return out


def slice_sums(tallied: DataFrame) -> DataFrame:
    """Each slice's leaf nodes (slice, node, zeros, ones) and, in a row without a node, its words and their counts."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["slice"].iloc[0])
        key, n = merged([np.cumsum(numbers(b)) for b in pdf["strings"]], [numbers(b) for b in pdf["n"]])
        node, zeros, ones = leaf_nodes(key, n)
        words: Counter = Counter()
        for packed, c in zip(pdf["words"], pdf["c"]):
            for w, k in zip(word_list(packed), numbers(c).tolist()):
                words[w] += k
        rows = pd.DataFrame({"slice": s, "node": pd.array(node, dtype="Int64"), "zeros": pd.array(zeros, dtype="Int64"),
                             "ones": pd.array(ones, dtype="Int64")})
        known = pd.DataFrame({"slice": [s], "words": [squeeze(b" ".join(words))],
                              "c": [squeeze(np.fromiter(words.values(), np.int64, len(words)))],
                              "total": [sum(words.values())], "kinds": [sum(k > 0 for k in words.values())]})
        return pd.concat([rows, known], ignore_index=True)[names].astype(
            {c: "Int64" for c in ("node", "zeros", "ones", "total", "kinds")}).astype({"words": object, "c": object}).replace(
            {"words": {np.nan: None}, "c": {np.nan: None}})

    names = ["slice", "node", "zeros", "ones", "words", "c", "total", "kinds"]
    return materialize(tallied.groupBy("slice").applyInPandas(
        merge, "slice int, node long, zeros long, ones long, words binary, c binary, total long, kinds long"), "llm-sums")


# ---------------------------------------------------------------- the tree

def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series, seven places on."""
    w = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    r = F.lit(1.0) / (w * w)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680)))) / w
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_kt(zeros: Column, ones: Column) -> Column:
    """ln Pe of ``zeros`` and ``ones``; 0 where there are none."""
    a, b = zeros.cast("double"), ones.cast("double")
    pe = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return F.when(zeros + ones > 0, pe).otherwise(0.0)


def shorter(node: Column, depth: int) -> Column:
    """The same decision in the last ``depth`` bytes of its context."""
    return F.shiftleft(F.shiftright(node, 8).bitwiseAND((1 << 8 * depth) - 1), 8) + node.bitwiseAND(255)


def node_probabilities(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(slice, node, one): the weighted tree's probability of a one at each leaf of ``leaves`` (slice, node, zeros, ones).

    Levels are written to the shared folder, deepest first; sums are partial
    before each shuffle, so that a short context, which meets all strings,
    is no single task.
    """
    pe = leaves.select("slice", "node", "zeros", "ones", log_kt(F.col("zeros"), F.col("ones")).alias("pe"))
    levels = [materialize(pe.withColumn("pw", F.col("pe")).withColumn("stop", F.lit(1.0)), "llm-level")]
    for d in range(depth - 1, -1, -1):
        up = (levels[-1].groupBy(shorter(F.col("node"), d).alias("node"))
              .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("below"))
              .withColumn("pe", log_kt(F.col("zeros"), F.col("ones"))))
        gap = F.col("below") - F.col("pe")
        # ln(Pe / 2 + product / 2), and the share of Pe in it.
        levels.append(materialize(
            up.withColumn("pw", F.greatest("pe", "below") + F.log1p(F.exp(-F.abs(gap))) - math.log(2))
            .withColumn("stop", F.when(gap > 700, 0.0).otherwise(1 / (1 + F.exp(gap)))).drop("below"), "llm-level"))
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    down = None
    for d, level in enumerate(reversed(levels)):
        own = level.select(*[c for c in level.columns if c == "slice"], "node", "stop", kt.alias("kt"))
        if down is None:
            own = own.withColumns({"sum": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            above = down.select(F.col("node").alias("up"), "sum", "rest")
            own = own.withColumn("up", shorter(F.col("node"), d - 1)).join(above, "up").drop("up")
        down = (own.withColumn("sum", F.col("sum") + F.col("rest") * F.col("stop") * F.col("kt"))
                .withColumn("rest", F.col("rest") * (1 - F.col("stop"))).drop("stop", "kt"))
    out = materialize(down.select("slice", "node", F.col("sum").alias("one")), "llm-leaves")
    for level in levels:
        discard(level)
    return out


# ---------------------------------------------------------------- scores

def batch_tables(tallied: DataFrame, tables: DataFrame) -> DataFrame:
    """(batch, strings, logs, words, c): each slice's answers to each batch."""
    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        is_node = own["node"].notna().to_numpy()
        node, one = own["node"][is_node].to_numpy(dtype=np.int64), own["one"][is_node].to_numpy(dtype=np.float64)
        words = {}
        for packed, c in zip(own["words"][~is_node], own["c"][~is_node]):
            words = dict(zip(word_list(packed), numbers(c).tolist()))
        every, _ = merged([np.cumsum(numbers(b)) for b in asked["strings"]], [numbers(b) for b in asked["n"]])
        logs = string_logs(every, node, one)
        rows = []
        for batch, packed, some in zip(asked["batch"], asked["strings"], asked["words"]):
            got = logs[np.searchsorted(every, np.cumsum(numbers(packed)))]
            want = word_list(some)
            rows.append((batch, packed, squeeze(got), some, squeeze(np.fromiter(map(words.__getitem__, want), np.int64, len(want)))))
        return pd.DataFrame(rows, columns=["batch", "strings", "logs", "words", "c"])

    return (tallied.drop("c").groupBy("slice").cogroup(tables.groupBy("slice"))
            .applyInPandas(answer, "batch long, strings binary, logs binary, words binary, c binary"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs`` (``SCORE_SCHEMA``): log10 probabilities of its text under the weighted context tree
    (``score``) and under single tokens (``base_score``), both learned from the rows outside the held-out fold.

    Texts are lower-cased (A-Z) for both models.  ``score`` is of all UTF-8
    bytes and the end; a text starts after ends only, so neighbours in the
    table do not matter.  Tokens are words between ASCII white space and one
    end.  ``bits_per_byte`` is the code length, the end included, by
    the bytes and the end.  Null texts are empty: the end alone.  Repeated rows
    count as often as they occur; an empty table gives no rows; without a
    training row every decision is even and ``train_tokens`` 0.  Other columns
    are not read.  Texts are dealt into batches by running length; what is
    shuffled is each batch's different strings and words, whose number
    follows the input, and the texts once.  A text is never cut: one longer
    than a batch is a batch of its own.
    """
    if not 0 <= depth <= DEPTH:
        raise ValueError(f"depth is 0 to {DEPTH}")
    spark = docs.sparkSession
    dealt = deal(docs, doc_id, text)
    n_bytes, n_train = (int(x or 0) for x in dealt.agg(F.sum("n_bytes"), F.sum("n_train")).first())
    n_slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SLICE_BYTES))
    tallied = tally(dealt, n_slices, depth)
    sums = slice_sums(tallied)
    leaves = node_probabilities(sums.where("node is not null").select("slice", "node", "zeros", "ones"), depth)
    words = sums.where("node is null").select("slice", "words", "c", "total", "kinds")
    total, kinds = (int(x or 0) for x in words.agg(F.sum("total"), F.sum("kinds")).first())
    total, kinds = total + n_train, kinds + (n_train > 0)  # the ends
    tables = leaves.unionByName(words.drop("total", "kinds"), allowMissingColumns=True)

    def score(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(numbers(b)) for b in answers["strings"]]
        logs = [numbers(b, np.float64) for b in answers["logs"]]
        found, log = np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*logs, np.empty(0)])
        order = np.argsort(found)
        found, log = found[order], log[order]
        seen = {}
        for packed, c in zip(answers["words"], answers["c"]):
            seen.update(zip(word_list(packed), numbers(c).tolist()))
        texts = unpack(own["texts"].iloc[0])
        parts, counts = [], []
        for group in groups(texts):
            key, owner, n = strings(group, depth)
            new = np.concatenate(([True], key[1:] != key[:-1]))
            each = log[np.searchsorted(found, key[new])][np.cumsum(new) - 1]
            parts.append(np.bincount(owner, n * each, minlength=len(group)))
            for t in group:
                tokens = t.split()
                c = np.fromiter(map(seen.__getitem__, tokens), dtype=np.float64, count=len(tokens))
                counts.append((len(tokens) + 1, int((c > 0).sum()) + (n_train > 0),
                               float(np.log10(np.append(c, n_train) + 0.1).sum()
                                     - (len(c) + 1) * math.log10(total + 0.1 * (kinds + 1)))))
        value = np.concatenate(parts)
        n_tokens, n_known, base = zip(*counts)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in own["ids"].iloc[0]], dtype="Int64"),
                             "held_out": [not t for t in own["train"].iloc[0]], "n_tokens": n_tokens,
                             "n_known": n_known, "train_tokens": total, "base_score": base, "score": value,
                             "n_bytes": size, "bits_per_byte": -value * math.log2(10) / (size + 1)})

    return (dealt.select("batch", "ids", "train", "texts").groupBy("batch")
            .cogroup(batch_tables(tallied, tables).groupBy("batch")).applyInPandas(score, SCORE_SCHEMA))

"""Removal of long repeated passages by sorted windows.

Equal stretches are brought together by content.  Of every window of
LENGTH bytes the k-gram with the least hash is its anchor; equal windows
have equal anchors.  Anchors that occur in one document only are dropped (one
bit for each comes back), and the contexts of the others, the windows around
the anchor, are dealt into buckets by the anchor.  A bucket sorts its
windows by their LENGTH bytes; equal ones form a class, and where a class's
earliest document is an earlier one than the window's own, the window's bit is
set and goes back to the document, which removes the covered bytes.

This stands in for a run-length (Burrows-Wheeler) index with streamed matching
statistics: no index is compressed and no statistic is streamed.  The result
is the same, as it only asks which document first holds each whole window.

Texts travel as packed batches of documents, compressed; what else moves is
proportional to the anchors, not to pairs of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.llm.text_hash import BASE, BYTE_CODE, INVERSE, mix64, powers, span_hashes
from terrapix.sources.store import materialize, shuffles_dropped

LENGTH = 50
GRAM = 24
BATCH_BYTES = 4_000_000
KEY_BITS = 48
PLACES = 1 << 20          # places within a slice that a gram's rank can tell apart
PORTION = 400_000         # windows that one run index holds
SLICE = PLACES // 8       # windows worked on at a time
NO_ID = np.iinfo(np.int64).max  # place of null ids: after all others

BATCH = "batch long, ids binary, lengths binary, texts binary"
ANCHORS = "bucket int, batch long, low binary, high binary, twice binary"
SHARED = "batch long, bucket int, bits binary"
CONTEXTS = "bucket int, batch long, lengths binary, docs binary, before binary, texts binary"
MASKS = "batch long, bucket int, masks binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"


class RunIndex:
    """Sorted windows of a collection of short texts.

    Windows are sorted by their LENGTH bytes; windows with equal bytes form a
    class.  ``run_head`` is where a run of one preceding byte starts within a
    class, ``run_doc`` the earliest document of the run; the result takes only
    the least of a class's, and ``order`` and ``cls`` keep an entry a window.
    """

    def __init__(self, text: np.ndarray, start: np.ndarray, before: np.ndarray, doc: np.ndarray, length: int):
        word = np.ndarray(len(text) - 7, dtype=">u8", buffer=np.ascontiguousarray(text), strides=(1,))
        cls = np.zeros(len(start), dtype=np.int64)
        order = np.arange(len(start))
        offsets = [*range(0, length - 7, 8), length - 8]
        for off in dict.fromkeys(offsets):
            # Only windows whose class still has others are sorted further.
            size = np.bincount(cls[order]) if len(order) else np.zeros(0, dtype=np.int64)
            open_ = np.flatnonzero(size[cls[order]] > 1)
            if not len(open_):
                break
            sub = order[open_]
            w = word[start[sub] + off].astype(np.uint64)
            sub = sub[np.lexsort((before[sub], w, cls[sub]))]
            order[open_] = sub
            w = word[start[order] + off].astype(np.uint64)
            c = cls[order]
            new = np.append(True, (c[1:] != c[:-1]) | ((w[1:] != w[:-1]) & (size[c[1:]] > 1)))
            cls = np.empty_like(cls)
            cls[order] = np.cumsum(new) - 1
        self.order, self.cls = order, cls
        c, b = cls[order], before[order]
        head = np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
        self.run_head = np.flatnonzero(head)
        self.run_byte = b[self.run_head]
        self.run_doc = np.minimum.reduceat(doc[order], self.run_head) if len(order) else doc[:0]
        first_run = np.flatnonzero(np.append(True, np.diff(c[self.run_head]) != 0)) if len(order) else self.run_head
        self._class_doc = np.minimum.reduceat(self.run_doc, first_run) if len(order) else doc[:0]

    def earliest(self) -> np.ndarray:
        """For each window the earliest document that holds its bytes."""
        return self._class_doc[self.cls]


def window_anchors(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor key) of each maximal run of windows with one anchor.

    ``ends``: where the texts in ``buf`` end; windows do not cross texts.  The
    buffer is worked through in slices that stay in a processor's cache.
    """
    windows = len(buf) - length + 1
    if windows <= 0:
        z = np.empty(0, dtype=np.int64)
        return z, z, z.astype(np.uint64)
    valid = np.ones(windows, dtype=bool)
    for e in ends.tolist():
        valid[max(0, e - length + 1):e] = False
    head = np.zeros(windows, dtype=bool)
    keys, before = [], -1
    power, inverse = powers(BASE, SLICE + length), powers(INVERSE, SLICE + length)
    place = np.arange(SLICE + length, dtype=np.uint64)
    low = np.uint64(PLACES - 1)
    for a in range(0, windows, SLICE):
        b = min(windows, a + SLICE)
        part = buf[a:b + length - 1]
        n = len(part)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[part] * power[:n], out=total[1:])
        grams = n - gram + 1
        h = (total[gram:] - total[:grams]) * inverse[:grams]
        # A gram's rank: the high bits of its hash, then its place (of equal grams the first counts).
        best = (h & ~low) | place[:grams]
        wide, have = length - gram + 1, 1
        while have < wide:
            step = min(have, wide - have)
            best = np.minimum(best[:len(best) - step], best[step:])
            have += step
        anchor = (best & low).astype(np.int64)
        new = head[a:b]
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[0] = anchor[0] + a != before
        new[1:] |= ~valid[a:b - 1]
        if a:
            new[0] |= not valid[a - 1]
        new &= valid[a:b]
        keys.append(mix64(h[anchor[new]]) >> np.uint64(64 - KEY_BITS))
        before = anchor[-1] + a
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    return np.flatnonzero(head), np.flatnonzero(tail), np.concatenate(keys)


class Batch:
    """Documents laid end to end, with their anchors."""

    def __init__(self, ids: bytes, lengths: bytes, texts: bytes, length: int, gram: int):
        self.ids, self.lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.raw = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.first, self.last, self.key = window_anchors(self.buf, self.ends, length, gram)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")] if len(self.first) else self.ids[:0]

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor keys in order, each run's place among them, and where each bucket starts."""
        keys, of = np.unique(self.key, return_inverse=True)
        edge = np.array([(b << KEY_BITS) // n + ((b << KEY_BITS) % n > 0) for b in range(n + 1)], dtype=np.uint64)
        return keys, of, np.searchsorted(keys, edge)


def _read(row) -> tuple[bytes, bytes, bytes]:
    return row.ids, row.lengths, row.texts


def pack_batches(docs: DataFrame, doc_id: str, text: str, batch_bytes: int) -> DataFrame:
    """Documents packed into rows of about ``batch_bytes``; a document is never split."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def close():
            raw = b"".join(texts)
            return pd.DataFrame({
                "batch": [number], "ids": [np.array(ids, dtype=np.int64).tobytes()],
                "lengths": [np.array([len(t) for t in texts], dtype=np.int64).tobytes()],
                "texts": [zstandard.ZstdCompressor(level=1).compress(raw) if raw else b""]})

        for pdf in it:
            keys = pdf["doc_id"].astype("Int64")
            for k, t in zip(keys, pdf["text"]):
                b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                if ids and held + len(b) > batch_bytes:
                    yield close()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(NO_ID if pd.isna(k) else int(k))
                texts.append(b)
                held += len(b)
        if ids:
            yield close()

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInPandas(run, BATCH))


def shared_anchors(packed: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(batch, bucket, bits): for each batch's distinct anchors of a bucket, whether two documents hold it."""
    def emit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                b = Batch(*_read(row), length, gram)
                keys, of, edge = b.buckets(n)
                if not len(keys):
                    continue
                low, high = np.full(len(keys), NO_ID), np.full(len(keys), -NO_ID - 1)
                np.minimum.at(low, of, b.doc)
                np.maximum.at(high, of, b.doc)
                twice = low != high
                rows = [(k, keys[x:y], twice[x:y]) for k, (x, y) in enumerate(zip(edge, edge[1:])) if y > x]
                yield pd.DataFrame({
                    "bucket": np.array([k for k, _, _ in rows], dtype=np.int32), "batch": row.batch,
                    "low": [x.astype(np.uint32).tobytes() for _, x, _ in rows],
                    "high": [(x >> np.uint64(32)).astype(np.uint16).tobytes() for _, x, _ in rows],
                    "twice": [np.packbits(t).tobytes() for _, _, t in rows]})

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in pdf["low"]]
        high = [np.frombuffer(x, np.uint16).astype(np.uint64) for x in pdf["high"]]
        sizes = [len(x) for x in low]
        keys = np.concatenate([h << np.uint64(32) | x for h, x in zip(high, low)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=s) for t, s in zip(pdf["twice"], sizes)])
        _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
        both = np.bincount(of, twice) > 0  # a batch lists a key once, so two listings are two batches
        keep = (times > 1) | both
        cut = np.concatenate(([0], np.cumsum(sizes)))
        return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "bucket": np.int32(key[0]),
                             "bits": [np.packbits(keep[of[a:z]]).tobytes() for a, z in zip(cut, cut[1:])]})

    return packed.mapInPandas(emit, ANCHORS).groupBy("bucket").applyInPandas(count, SHARED)


def _gather(rows: DataFrame, column: str) -> DataFrame:
    """One row a batch with its rows of all buckets."""
    return rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", column))).alias(column))


def _expand(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of buf[start:start+size] of all spans, end to end."""
    done = np.cumsum(size)
    return buf[np.repeat(start - (done - size), size) + np.arange(done[-1] if len(done) else 0)]


class Contexts:
    """A batch's different contexts of shared anchors, in the order in which they are sent."""

    def __init__(self, b: Batch, bits, n: int, length: int):
        keys, of, edge = b.buckets(n)
        shared = np.zeros(len(keys), dtype=bool)
        for r in bits if bits is not None else []:
            x, y = edge[r["bucket"]], edge[r["bucket"] + 1]
            shared[x:y] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=y - x).astype(bool)
        self.run = np.flatnonzero(shared[of]) if len(keys) else np.empty(0, dtype=np.int64)
        self.start, self.size = b.first[self.run], b.last[self.run] - b.first[self.run] + length
        bucket = np.searchsorted(edge, of[self.run], side="right") - 1
        name = mix64(span_hashes(b.buf, self.start, self.start + self.size) + b.key[self.run]) if len(self.run) else \
            np.empty(0, np.uint64)
        # Equal contexts are sent once, with the earliest document of the batch that has them.
        order = np.lexsort((b.doc[self.run], name, bucket))
        head = np.append(True, (name[order][1:] != name[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])) \
            if len(order) else np.zeros(0, bool)
        self.sent = order[head]
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.doc = b.doc[self.run]
        self.bucket = bucket[self.sent]
        self.edge = np.searchsorted(self.bucket, np.arange(n + 1))


def context_masks(packed: DataFrame, shared: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(batch, bucket, masks): for each context sent, a bit for each window that an earlier document holds."""
    def emit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                b = Batch(*_read(row), length, gram)
                c = Contexts(b, row.bits, n, length)
                out = []
                for k in np.flatnonzero(np.diff(c.edge)):
                    s = c.sent[c.edge[k]:c.edge[k + 1]]
                    begin, size = c.start[s], c.size[s]
                    first = np.concatenate(([0], b.ends[:-1]))[np.searchsorted(b.ends, begin, side="right")]
                    out.append((k, size.astype(np.uint16).tobytes(), c.doc[s].tobytes(),
                                np.where(begin > first, b.buf[np.maximum(begin - 1, 0)], 0).astype(np.uint8).tobytes(),
                                _expand(b.buf, begin, size).tobytes()))
                if out:
                    z = zstandard.ZstdCompressor(level=1)
                    yield pd.DataFrame({
                        "bucket": np.array([x[0] for x in out], dtype=np.int32), "batch": row.batch,
                        "lengths": [x[1] for x in out], "docs": [x[2] for x in out], "before": [x[3] for x in out],
                        "texts": [z.compress(x[4]) for x in out]})

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdDecompressor()
        size = [np.frombuffer(x, np.uint16).astype(np.int64) for x in pdf["lengths"]]
        counts = [len(s) for s in size]
        size, doc = np.concatenate(size), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
        before = np.frombuffer(b"".join(pdf["before"]), np.uint8)
        text = np.frombuffer(b"".join(z.decompress(x) for x in pdf["texts"]), np.uint8)
        del pdf["texts"], pdf["docs"], pdf["lengths"]
        start = np.cumsum(size) - size
        # A context that several batches sent is indexed once, with its earliest document.
        name = span_hashes(text, start, start + size)
        _, one, of = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(one), NO_ID)
        np.minimum.at(least, of, doc)
        windows = size[one] - length + 1
        own = _held_earlier(text, start[one], windows, before[one], least, length)
        # Stream the contexts: bit i of a mask is the window at place i.  In a
        # later copy of a context every window is held by an earlier document.
        whole = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
        mask = np.where(doc > least[of], whole[of], own[of])
        cut = np.concatenate(([0], np.cumsum(counts)))
        return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "bucket": np.int32(key[0]),
                             "masks": [mask[a:y].astype(np.uint32).tobytes() for a, y in zip(cut, cut[1:])]})

    joined = packed.join(_gather(shared, "bits"), "batch")
    return joined.mapInPandas(emit, CONTEXTS).groupBy("bucket").applyInPandas(index, MASKS)


def _held_earlier(text: np.ndarray, start: np.ndarray, windows: np.ndarray, before: np.ndarray, doc: np.ndarray,
                  length: int) -> np.ndarray:
    """For each context a bit for each of its windows whose matching statistic against earlier documents
    reaches ``length``.  Windows are indexed in portions by their first bytes, so equal ones stay together."""
    owner = np.repeat(np.arange(len(start), dtype=np.int32), windows)
    inner = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.uint8)
    head = np.ndarray(len(text) - 7, dtype=np.uint64, buffer=np.ascontiguousarray(text), strides=(1,))
    portions = max(1, -(-len(owner) // PORTION))
    portion = (mix64(head[start[owner] + inner]) % np.uint64(portions)).astype(np.uint32)
    order = np.argsort(portion, kind="stable")
    edge = np.searchsorted(portion[order], np.arange(portions + 1))
    hit = np.zeros(len(owner), dtype=bool)
    for a, b in zip(edge, edge[1:]):
        w = np.sort(order[a:b])
        o, i = owner[w], inner[w].astype(np.int64)
        at = start[o] + i
        prev = np.where(i > 0, text[np.maximum(at - 1, 0)], before[o])
        hit[w] = RunIndex(text, at, prev, doc[o], length).earliest() < doc[o]
    bit = np.where(hit, np.uint64(1) << inner.astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduceat(bit, np.cumsum(windows) - windows)


def _maximal(covered: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where texts end."""
    change = np.zeros(len(covered) + 1, dtype=bool)
    change[0] = change[-1] = True
    change[1:-1] = covered[1:] != covered[:-1]
    change[ends] = True
    change[0] = True
    at = np.flatnonzero(change)
    a, b = at[:-1], at[1:]
    on = covered[a] if len(covered) else np.zeros(0, bool)
    return a[on], b[on]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges, end exclusive).

    A byte is removed if a ``length``-byte string that covers it also starts in
    a row with a smaller doc_id; matches do not cross documents and are judged
    on the input.  Null texts are empty.  Rows with the same id remove nothing
    from each other; null ids come after all others.  Texts shorter than
    ``length`` stay whole.
    """
    if not 8 <= gram <= length or length - gram + 1 > 32:
        raise ValueError("gram must be at least 8 and within 31 bytes of length")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = materialize(pack_batches(docs, doc_id, text, batch_bytes), "llm-batches")
    with shuffles_dropped(spark):
        shared = materialize(shared_anchors(packed, n, length, gram), "llm-anchors")
        masks = materialize(context_masks(packed, shared, n, length, gram), "llm-masks")
    both = packed.join(_gather(shared, "bits"), "batch", "left").join(_gather(masks, "masks"), "batch", "left")

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                b = Batch(*_read(row), length, gram)
                c = Contexts(b, row.bits, n, length)
                covered = np.zeros(len(b.buf) + 1, dtype=np.int32)
                if len(c.sent):
                    mask = np.zeros(len(c.sent), dtype=np.uint32)
                    for r in row.masks if row.masks is not None else []:
                        mask[c.edge[r["bucket"]]:c.edge[r["bucket"] + 1]] = np.frombuffer(r["masks"], np.uint32)
                    # Later documents of the batch find every window in the one that was sent.
                    later = c.doc > c.doc[c.sent][c.of]
                    m = np.where(later, np.uint32(0xFFFFFFFF), mask[c.of])
                    for i in range(length - gram + 1):
                        on = ((m >> np.uint32(i)) & np.uint32(1)).astype(bool) & (i <= c.size - length)
                        np.add.at(covered, c.start[on] + i, 1)
                        np.add.at(covered, c.start[on] + i + length, -1)
                gone = np.cumsum(covered[:-1]) > 0
                a, z = _maximal(gone, b.ends)
                begin = b.ends - b.lengths
                of = np.searchsorted(b.ends, a, side="right")
                cut = np.searchsorted(of, np.arange(len(b.ids) + 1))
                view = memoryview(b.raw)
                digests, spans = [], []
                for i, (s, e) in enumerate(zip(begin.tolist(), b.ends.tolist())):
                    h, at = hashlib.sha256(), s
                    x, y = a[cut[i]:cut[i + 1]].tolist(), z[cut[i]:cut[i + 1]].tolist()
                    for p, q in zip(x, y):
                        h.update(view[at:p])
                        at = q
                    h.update(view[at:e])
                    digests.append(h.hexdigest())
                    spans.append([{"a": p - s, "b": q - s} for p, q in zip(x, y)])
                yield pd.DataFrame({
                    "doc_id": pd.array([None if k == NO_ID else k for k in b.ids.tolist()], dtype="Int64"),
                    "n_bytes": b.lengths, "n_removed": np.bincount(of, z - a, minlength=len(b.ids)).astype(np.int64),
                    "n_spans": np.diff(cut), "kept_sha256": digests, "spans": spans})

    return both.mapInPandas(finish, RESULT)

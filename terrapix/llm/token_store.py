"""Token ids in shard files: one wavelet matrix for each block of documents.

A block's ids are replaced by their ranks in the block's sorted alphabet and
stored as bit-planes, highest bit first; each plane reorders the sequence
(zeros before ones, both in order) for the next.  Sampled counts of ones give
rank and select, so token access, counting and occurrence lookup work on the
planes without decoding the rest.

A shard is one Parquet part file, written by Spark in ascending document
order; each of its rows is a block that can be read alone.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapix.llm.text_hash import names

BLOCK_TOKENS = 1 << 20   # a block ends with the document that reaches this
SAMPLE = 512             # bits between two sampled counts of ones
VOCAB_KEPT = 2_000_000    # pieces whose ids a worker remembers before it starts anew
RECENT_BITS = 20          # of a piece's hash: slots for the pieces last met
SECOND = 0x5851F42D4C957F2D  # seed of the second names

BLOCK = ("shard int, block int, shard_offset long, n_tokens long, n_docs long, doc_ids binary, doc_null binary, "
         "doc_lengths binary, alphabet binary, zeros binary, planes binary, counts binary")


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of token ids."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray, counts: np.ndarray):
        self.n, self.alphabet, self.zeros, self.planes, self.counts = n, alphabet, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        present = np.bincount(ids) > 0 if n else np.zeros(0, dtype=bool)
        alphabet = np.flatnonzero(present).astype(np.uint32)
        ranks = np.cumsum(present) - 1
        wide = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        cur = ranks[ids].astype(wide) if n else np.empty(0, wide)
        levels = max(0, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        planes, zeros, counts = [], [], []
        for level in range(levels):
            one = (cur & wide(1 << (levels - 1 - level))) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(packed)
            ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), SAMPLE // 8))
            counts.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32))
            # Places first: on mixed bits this is several times faster than a mask.
            ones_at = np.flatnonzero(one)
            cur = np.concatenate((cur.take(np.flatnonzero(~one)), cur.take(ones_at)))
            zeros.append(n - len(ones_at))
        width, blocks = (n + 7) // 8, -(-((n + 7) // 8) // (SAMPLE // 8))
        return cls(n, alphabet, np.array(zeros, dtype=np.uint32),
                   np.concatenate(planes).reshape(levels, width) if levels else np.zeros((0, width), np.uint8),
                   np.concatenate(counts).reshape(levels, blocks) if levels else np.zeros((0, blocks), np.uint32))

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i <= 0:
            return 0
        s = min(i // SAMPLE, self.counts.shape[1] - 1)
        a, b = s * SAMPLE // 8, i // 8
        plane = self.planes[level]
        c = int(self.counts[level][s]) + int(np.bitwise_count(plane[a:b]).sum())
        return c + (int(plane[b]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else c

    def access(self, i: int) -> int:
        """The id at place i."""
        rank = 0
        for level in range(len(self.zeros)):
            one = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            rank = rank << 1 | one
            i = int(self.zeros[level]) + ones if one else i - ones
        return int(self.alphabet[rank])

    def _symbol(self, token: int) -> int | None:
        r = int(np.searchsorted(self.alphabet, token))
        return r if r < len(self.alphabet) and self.alphabet[r] == token else None

    def _range(self, sym: int, a: int, b: int) -> tuple[int, int]:
        for level in range(len(self.zeros)):
            x, y = self._ones(level, a), self._ones(level, b)
            if sym >> (len(self.zeros) - 1 - level) & 1:
                a, b = int(self.zeros[level]) + x, int(self.zeros[level]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before place i."""
        sym = self._symbol(token)
        if sym is None:
            return 0
        a, b = self._range(sym, 0, min(i, self.n))
        return b - a

    def _place(self, level: int, j: int, one: bool) -> int:
        """Place of the j-th (from 0) one or zero of a plane: by the sampled counts, then inside one sample."""
        c = self.counts[level].astype(np.int64)
        if not one:
            c = np.arange(len(c)) * SAMPLE - c
        s = int(np.searchsorted(c, j, side="right")) - 1
        bits = np.unpackbits(self.planes[level][s * SAMPLE // 8:(s + 1) * SAMPLE // 8], bitorder="little")
        return s * SAMPLE + int(np.flatnonzero(bits == one)[j - c[s]])

    def select(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of ``token``; -1 if there is none."""
        sym = self._symbol(token)
        if sym is None:
            return -1
        a, b = self._range(sym, 0, self.n)
        if not 0 <= j < b - a:
            return -1
        i = a + j
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(sym >> (len(self.zeros) - 1 - level) & 1)
            i = self._place(level, i - int(self.zeros[level]) if one else i, one)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.rank(token, self.n))]

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up: each plane merges its zeros and ones again."""
        levels = len(self.zeros)
        wide = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        cur = np.zeros(self.n, dtype=wide)
        for level in range(levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            z = int(self.zeros[level])
            up = np.empty_like(cur)
            up[np.flatnonzero(~one)] = cur[:z]
            up[np.flatnonzero(one)] = cur[z:] | wide(1 << (levels - 1 - level))
            cur = up
        return self.alphabet[cur] if self.n else np.empty(0, dtype=np.uint32)


# Classes of bytes for places where the byte-level pre-tokenizer always breaks.
_LETTER, _VISIBLE, _BLANK, _OTHER_BLANK = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)  # 0: control characters and bytes of other scripts
_CLASS[33:127] = _VISIBLE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[32], _CLASS[9:14] = _BLANK, _OTHER_BLANK
# White space outside these classes; texts that hold any are encoded whole.
_RARE = "\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RARE_BLANK = re.compile(f"[{_RARE}]")
_PLAIN = re.compile(f" ?[^\\t-\\r {_RARE}]+")


def pieces(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start: with each text, with each run of white space, after one that is a single
    character other than a space, and between an ASCII letter and a visible ASCII non-letter.

    Tokens end at all of these places, whatever stands around, so pieces can be encoded apart.
    """
    c = _CLASS[buf]
    blank = c >= _BLANK
    cut = np.zeros(len(buf), dtype=bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | ((c[1:] == _VISIBLE) & (c[:-1] == _LETTER))
    opens = np.zeros(len(buf) + 1, dtype=bool)
    opens[first] = True
    alone = c == _OTHER_BLANK
    alone[1:] &= ~blank[:-1] | opens[1:-1]
    cut[1:] |= alone[:-1] & ~blank[1:]
    cut |= opens[:-1]
    return np.flatnonzero(cut)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, run: str) -> Encoder:
    """This Python worker's encoder for one run of ``write_shards``; its tasks share the pieces remembered,
    and what an earlier run remembered is let go."""
    if (path, run) not in _encoders:
        _encoders.clear()
        _encoders[path, run] = Encoder(path, special_as_text=False)
    return _encoders[path, run]


class Encoder:
    """Ids of whole texts, the same as the tokenizer's own on the text.

    Texts are cut into pieces at places where tokens always end; each
    different piece is encoded once and remembered by a 64-bit name.  A piece
    that is met again must have the second, independent name of the one
    remembered; one that has not is encoded on its own.  With ``special_as_text`` strings of special tokens in a text
    are ordinary text; without it the tokenizer is used as its file gives it,
    and texts that hold the string of an added token are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # sorted hashes, whose pieces
        # By piece: name and second name, and place and number of its ids in the pool.
        self.name, self.check = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.begin, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.uint32)
        # The piece last met for each value of the hash's high bits: most spans are found here, without a sort.
        self.recent_name = np.zeros(1 << RECENT_BITS, dtype=np.uint64)
        self.recent = np.zeros(1 << RECENT_BITS, dtype=np.int32)

    def _holds_added(self, text: str) -> bool:
        return any(s in text for s in self.added)

    def _ids(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, the order of the pieces there, and the number of ids of each piece.

        Pieces without white space, or with one space in front, are encoded many
        at a time with line ends between, which are tokens of their own there.
        """
        texts = [b.decode("utf-8", "surrogatepass") for b in new]
        plain = np.array([self.line is not None and _PLAIN.fullmatch(t) is not None and not self._holds_added(t)
                          for t in texts], dtype=bool)
        size = np.zeros(len(new), dtype=np.int64)
        together = np.flatnonzero(plain)
        parts: list[np.ndarray] = []
        groups = ["\n".join([texts[i] for i in together[a:a + 500]]) + "\n" for a in range(0, len(together), 500)]
        for e in self.tok.encode_batch_fast(groups, add_special_tokens=False):
            parts.append(np.array(e.ids, dtype=np.uint32))
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        end = np.flatnonzero(ids == self.line) if len(ids) else np.empty(0, np.int64)
        size[together] = np.diff(np.concatenate(([-1], end))) - 1
        ids = ids[ids != self.line] if len(ids) else ids
        apart = np.flatnonzero(~plain)
        more = [e.ids for e in self.tok.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False)]
        size[apart] = [len(x) for x in more]
        order = np.concatenate([together, apart])
        return np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32)]), order, size

    def _learn(self, name: np.ndarray, check: np.ndarray, new: list[bytes], known: bool = True) -> np.ndarray:
        """Encode pieces and return their numbers; those not ``known`` are not found by their names later."""
        ids, order, size = self._ids(new)
        begin = np.empty(len(new), dtype=np.int64)
        begin[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        number = np.arange(len(self.name), len(self.name) + len(new))
        self.pool = np.concatenate([self.pool, ids])
        self.name, self.check = np.concatenate([self.name, name]), np.concatenate([self.check, check])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        if known:
            at = np.argsort(np.concatenate([self.known, name]), kind="stable")
            self.known = np.concatenate([self.known, name])[at]
            self.number = np.concatenate([self.number, number])[at]
        return number

    def _numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece of each span; pieces not met before are encoded."""
        hashes, check = names(buf, start, end), names(buf, start, end, SECOND)

        def cut(spans: np.ndarray) -> list[bytes]:
            data = buf.tobytes()
            return [data[a:b] for a, b in zip(start[spans].tolist(), end[spans].tolist())]

        slot = (hashes >> np.uint64(64 - RECENT_BITS)).astype(np.int64)
        out = self.recent[slot].astype(np.int64)
        miss = np.flatnonzero(self.recent_name[slot] != hashes)
        if len(miss):
            name, at, of = np.unique(hashes[miss], return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, name)
            have = np.zeros(len(name), dtype=bool)
            inner = place < len(self.known)
            have[inner] = self.known[place[inner]] == name[inner]
            if not have.all():
                new = miss[at[~have]]
                self._learn(name[~have], check[new], cut(new))
                place = np.searchsorted(self.known, name)
            number = self.number[place]
            out[miss] = number[of]
            slot = (name >> np.uint64(64 - RECENT_BITS)).astype(np.int64)
            self.recent[slot] = number
            self.recent_name[slot] = self.name[self.recent[slot]]
        other = np.flatnonzero(self.check[out] != check)
        if len(other):
            out[other] = self._learn(hashes[other], check[other], cut(other), known=False)
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; number of ids of each)."""
        if len(self.known) > VOCAB_KEPT:
            self._forget()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        length = np.array([len(b) for b in raw], dtype=np.int64)
        first = np.cumsum(length) - length
        per_text = np.ones(len(texts), dtype=np.int64)
        ids = np.empty(0, dtype=np.uint32)
        if len(buf):
            start = pieces(buf, first)
            odd = [i for i, t in enumerate(texts) if not t.isascii() and _RARE_BLANK.search(t) or
                   t.isascii() and any(c in t for c in "\x1c\x1d\x1e\x1f") or self._holds_added(t)]
            if odd:
                inside = np.zeros(len(buf) + 1, dtype=bool)
                for i in odd:
                    inside[first[i] + 1:first[i] + length[i]] = True
                start = start[~inside[start]]
            end = np.append(start[1:], len(buf))
            piece = self._numbers(buf, start, end)
            begin, size = self.begin[piece], self.size[piece]
            done = np.cumsum(size)
            ids = self.pool[np.repeat(begin - (done - size), size) + np.arange(done[-1])]
            owner = np.searchsorted(first, start, side="right") - 1
            per_text += np.bincount(owner, size, minlength=len(texts)).astype(np.int64)
        out = np.full(len(ids) + len(texts), end_id, dtype=np.uint32)
        body = np.ones(len(out), dtype=bool)
        body[np.cumsum(per_text) - 1] = False
        out[body] = ids
        return out, per_text


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id",
                 text: str = "text", shards: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write shards in ascending order of doc_id.

    Rows are dealt by ranges of (doc_id, hash of the text), nulls first, so
    repeated ids keep a fixed order.  A document is never split over blocks;
    one longer than a block lengthens its block.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = uuid.uuid4().hex
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = (body.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
             .select("doc_id", "text"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, offset = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, run)
        ids, lengths, docs_, nulls, held = [], [], [], [], 0

        def close():
            nonlocal ids, lengths, docs_, nulls, held, block, offset
            all_ids = np.concatenate(ids)
            m = WaveletMatrix.build(all_ids)
            row = [shard, block, offset, len(all_ids), len(docs_),
                   np.array(docs_, dtype=np.int64).tobytes(), np.packbits(np.array(nulls)).tobytes(),
                   np.array(lengths, dtype=np.uint32).tobytes(), m.alphabet.tobytes(), m.zeros.tobytes(),
                   m.planes.tobytes(), m.counts.tobytes()]
            ids, lengths, docs_, nulls, held = [], [], [], [], 0
            block, offset = block + 1, offset + len(all_ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 7
            names = [c.split()[0] for c in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds)], names)

        def add(keys: list, texts: list[str]):
            nonlocal held
            got, per_text = enc.encode(texts, end_id)
            ids.append(got)
            lengths.extend(per_text.tolist())
            docs_.extend(0 if k is None else k for k in keys)
            nulls.extend(k is None for k in keys)
            held += len(got)

        for batch in it:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and chars < 2 * block_tokens:
                    chars += len(texts[upto])
                    upto += 1
                add(keys[at:upto], texts[at:upto])
                at = upto
                if held >= block_tokens:
                    yield close()
        if docs_:
            yield close()

    blocks = dealt.mapInArrow(encode, BLOCK)
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all shards with ``start``: tokens of all blocks before.

    A block knows its offset in its shard; the offsets of the shards come from
    their totals, one row for each task that wrote, which is what is broadcast.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
              .select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start")))
    return (blocks.join(F.broadcast(shards), "shard")
            .withColumn("start", F.col("shard_start") + F.col("shard_offset")).drop("shard_start"))


def load_block(row) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the document ids and the documents' lengths of a row of ``read_blocks``."""
    zeros = np.frombuffer(row.zeros, np.uint32)
    n, levels = int(row.n_tokens), len(zeros)
    planes = np.frombuffer(row.planes, np.uint8).reshape(levels, -1) if levels else np.zeros((0, (n + 7) // 8), np.uint8)
    counts = np.frombuffer(row.counts, np.uint32).reshape(levels, -1) if levels else np.zeros((0, 1), np.uint32)
    null = np.unpackbits(np.frombuffer(row.doc_null, np.uint8))
    ids = [None if z else int(d) for d, z in zip(np.frombuffer(row.doc_ids, np.int64), null)]
    return (WaveletMatrix(n, np.frombuffer(row.alphabet, np.uint32), zeros, planes, counts), ids,
            np.frombuffer(row.doc_lengths, np.uint32))


def document_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the shards: doc_id, start, n_tokens, ids_crc32."""
    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                m, ids, lengths = load_block(row)
                tokens = m.decode()
                end = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(tokens.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, dtype="Int64"), "start": row.start + end - lengths,
                    "n_tokens": lengths.astype(np.int64),
                    "ids_crc32": [zlib.crc32(raw[4 * (b - a):4 * b]) for a, b in zip(lengths.tolist(), end.tolist())]})

    return read_blocks(spark, path).mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")

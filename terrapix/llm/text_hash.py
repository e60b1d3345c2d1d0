"""Vectorised hashing over a batch of texts laid end to end in one byte buffer.

``names`` chains a mixing function over a span's 8-byte words; use it where
two spans must not be taken for one another.  ``span_hashes`` is a polynomial
in the bytes modulo 2**64, taken from one running sum over the whole buffer,
so its work for a span does not depend on the length; some strings of 1,024
bytes and more collide in it for any base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SLICE = 1 << 17
LONG_SPAN = 4096  # bytes from which on a span is hashed on its own
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        _powers[base] = have
    return have[:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for many spans in order of their starts; equal bytes, equal hash.

    Spans may overlap.  The buffer is worked through in slices, so that
    memory besides the result is bounded by a slice and the longest span.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(start, a + SLICE, side="left"))
        part = buf[a:int(end[i:j].max())]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[part] * powers(BASE, len(part)), out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        h = (total[e] - total[s]) * powers(INVERSE, len(part) + 1)[s]
        out[i:j] = mix64(h + (e - s).astype(np.uint64))
        i = j
    return out


def names(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of buf[start:end] for many spans; equal bytes, equal name.

    Different spans of up to seven bytes have different names; longer ones
    differ but by chance.  Another ``seed`` gives names that are independent.
    """
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded.tobytes(), 0, (1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    first = words[start] & mask[np.minimum(size, 8)]
    short = size < 8
    first[short] |= size[short].astype(np.uint64) << np.uint64(56)
    out = mix64(first ^ np.uint64(seed))
    live = np.flatnonzero(~short & (size <= LONG_SPAN))
    k = 1
    while len(live):
        out[live] = mix64(out[live] + size[live].astype(np.uint64) * np.uint64(BASE))
        live = live[size[live] > 8 * k]
        more = words[start[live] + 8 * k] & mask[np.minimum(size[live] - 8 * k, 8)]
        out[live] = mix64(out[live] * np.uint64(BASE) + more)
        k += 1
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        salt = seed.to_bytes(8, "little")
        digest = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8, salt=salt).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def batches(texts: Iterable[str | None], max_bytes: int = 4_000_000) -> Iterator[list[bytes]]:
    """Group UTF-8 texts (null: empty) so that a group has about ``max_bytes``; one text is never cut."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if group and size + len(b) > max_bytes:
            yield group
            group, size = [], 0
        group.append(b)
        size += len(b) + 1
    if group:
        yield group


def lay_out(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a newline after each text, and each text's first offset (one more at the end)."""
    buf = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(b) + 1 for b in group), dtype=np.int64, count=len(group))
    return buf, np.concatenate(([0], np.cumsum(lengths)))

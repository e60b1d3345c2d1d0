"""Periodic run detection by string synchronising sets.

A run is a maximal stretch of words with smallest period q and at least two
periods.  Periods up to ``DIRECT`` are found by comparing the text with
itself moved by q.  For longer ones, at each scale t = 4, 8, 16, ... (periods
3t - 1 to 6t - 2) positions are chosen by their context alone: i is chosen
if the smallest hash of the t-word windows that start in i .. i + t is that
of the first or of the last one, windows of a period up to t / 3 left out.
Any t consecutive positions hold a chosen one unless the 3t - 1 words from
the first on are highly periodic, so a run holds a chosen position and the
same one a period later; pairs of chosen positions with equal contexts of
2t words propose periods.  The runs that this leaves out repeat a highly
periodic stretch; they lie between two runs of one small period p that
overlap by less than p, and the phases of those two give their periods.
Every proposal is then measured by comparing words, so what is returned
is exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.llm.text_hash import batches, mix64

DIRECT = 10      # periods found without chosen positions
MIN_LENGTH = 12  # words of a reported run
RUN_SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")


def equal_stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all maximal stretches of 2q words or more whose words q apart are equal."""
    if len(words) < 2 * q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], words[q:] == words[:-q], [False]))))
    start, end = edge[::2], edge[1::2]
    long_enough = end - start >= q
    return start[long_enough], end[long_enough] + q


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    have, m = 1, h
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on (b > a), going by ``step`` (1 or -1), are equal; chunks double."""
    n, size = 0, 16
    room = len(words) - b if step == 1 else a + 1
    while n < room:
        k = min(size, room - n)
        if step == 1:
            differ = words[a + n:a + n + k] != words[b + n:b + n + k]
        else:
            differ = (words[a - n - k + 1:a - n + 1] != words[b - n - k + 1:b - n + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n += k
        size *= 2
    return n


class RunFinder:
    """All runs of one array of word numbers, in which each text ends with a number of its own."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.tried: set[tuple[int, int]] = set()

    def keep(self, start: int, end: int, q: int) -> None:
        # Periods come in ascending order: a stretch that is known has a smaller one.
        self.runs.setdefault((start, end), q)

    def propose(self, pairs: Iterator[tuple[int, int]]) -> None:
        """Measure (q, a), ascending: the words from a and from a + q on may be equal."""
        last_q, last_end = 0, -1
        for q, a in pairs:
            if q == last_q and a + q <= last_end:
                continue
            right = reach(self.words, a, a + q, 1)
            left = reach(self.words, a - 1, a + q - 1, -1) if a else 0
            if left + right >= q:
                last_q, last_end = q, a + q + right
                self.keep(a - left, last_end, q)

    def small_periods(self) -> None:
        for q in range(1, DIRECT + 1):
            for start, end in zip(*(x.tolist() for x in equal_stretches(self.words, q))):
                self.keep(start, end, q)

    def highly_periodic(self, p_max: int, length: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of known runs of a period up to ``p_max`` and ``length`` words or more."""
        return sorted((a, b, p) for (a, b), p in self.runs.items() if p <= p_max and b - a >= length)

    def chosen_pairs(self, t: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(q, a) of chosen positions a, a + q with equal contexts and a period of this scale; ``hashes`` of t-word windows."""
        h = hashes.copy()
        worst = np.uint64(0xFFFFFFFFFFFFFFFF)
        h[h == worst] -= np.uint64(1)
        for a, b, _ in self.highly_periodic(t // 3, t):
            h[a:b - t + 1] = worst
        if len(h) <= t:
            return []
        low = sliding_min(h, t + 1)
        at = np.flatnonzero((low != worst) & ((low == h[:len(low)]) | (low == h[t:])))
        context = mix64(hashes[at] * np.uint64(3) + hashes[at + t])
        order = np.argsort(context, kind="stable")
        at, context = at[order], context[order]
        found, gap = [], 1
        while gap < len(at):
            same = context[gap:] == context[:-gap]
            q = at[gap:] - at[:-gap]
            near = same & (q <= 6 * t - 2)
            if not near.any():
                break
            fit = near & (q >= 3 * t - 1)
            found.append(np.stack([q[fit], at[:-gap][fit]], axis=1))
            gap += 1
        if not found:
            return []
        return [(int(q), int(a)) for q, a in np.unique(np.concatenate(found), axis=0)]

    def phase_pairs(self, t: int) -> list[tuple[int, int]]:
        """(q, a) for squares whose halves lie in two adjacent runs of one period up to t / 3."""
        by_period: dict[int, list[tuple[int, int]]] = {}
        for a, b, p in self.highly_periodic(t // 3, 3 * t - 1):
            by_period.setdefault(p, []).append((a, b))
        out = []
        w = self.words
        for p, runs in by_period.items():
            for (a1, e1), (a2, e2) in zip(runs, runs[1:]):
                if not a2 <= e1 < a2 + p:
                    continue
                # The second run's first period, looked up in the last two periods of the first run.
                head = w[a2:a2 + p]
                back = np.lib.stride_tricks.sliding_window_view(w[e1 - 2 * p:e1 - 1], p)
                hit = np.flatnonzero((back == head).all(axis=1)) if p < 64 else [
                    i for i in range(p) if w[e1 - 2 * p + i] == head[0] and np.array_equal(w[e1 - 2 * p + i:e1 - p + i], head)]
                for i in hit:
                    q = (a2 - (e1 - 2 * p + int(i))) % p
                    low, high = 3 * t - 1, min(6 * t - 2, e1 - a1, e2 - a2 + p)
                    first = low + (q - low) % p
                    out += [(x, e1 - x) for x in range(first, high + 1, p)]
        return sorted(set(out))

    def find(self) -> dict[tuple[int, int], int]:
        self.small_periods()
        t = 4
        hashes = mix64(self.words.astype(np.uint64) + np.uint64(1))
        for size in (1, 2):  # windows of 2 and 4 words
            hashes = mix64(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:]) if len(hashes) > size else hashes[:0]
        while 2 * (3 * t - 1) <= len(self.words):
            self.propose(iter(sorted(set(self.chosen_pairs(t, hashes)) | set(self.phase_pairs(t)))))
            hashes = mix64(hashes[:-t] * np.uint64(0x9E3779B97F4A7C15) + hashes[t:]) if len(hashes) > t else hashes[:0]
            t *= 2
        return self.runs


def word_numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal words equal numbers, across the texts."""
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in t), dtype=np.int64, count=len(t)) for t in texts]


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each array of word numbers, its runs (start, end, period) of two periods or more, by start and period.

    Texts of like length are laid end to end, so that the array operations
    of the larger scales do not run over texts that are too short for them.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) > 1:
            classes.setdefault(len(t).bit_length(), []).append(i)
    for members in classes.values():
        most = max(int(texts[i].max()) for i in members) + 1
        parts = []
        for k, i in enumerate(members):
            parts += [texts[i], np.array([most + k])]
        first = np.concatenate(([0], np.cumsum([len(texts[i]) + 1 for i in members])))
        for (a, b), q in RunFinder(np.concatenate(parts)).find().items():
            k = int(np.searchsorted(first, a, side="right")) - 1
            out[members[k]].append((a - int(first[k]), b - int(first[k]), q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def looped(words: np.ndarray, h: int) -> np.ndarray:
    """The word positions of a text whose end is replaced by repetitions of a stretch of its own, where h % 10 is 0.

    The stretch starts at a = g % n (g = h // 10) and has 1 + (n - a) // (3 + g % 8) words.
    """
    n = len(words)
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def judge(ids: list[int | None], texts: list[bytes], loop: bool) -> Iterator[tuple]:
    """One result row (``RUN_SCHEMA``) a text."""
    words = [t.split() for t in texts]  # at space and \\t \\n \\v \\f \\r
    numbers = word_numbers(words)
    if loop:
        for k, i in enumerate(ids):
            at = looped(numbers[k], zlib.crc32(b"" if i is None else str(i).encode()))
            if at.size and at[-1] != at.size - 1 or (np.diff(at) != 1).any():
                numbers[k] = numbers[k][at]
                words[k] = [words[k][j] for j in at.tolist()]
    for i, own, runs in zip(ids, words, find_runs(numbers)):
        runs = [(a, b, q) for a, b, q in runs if b - a >= max(MIN_LENGTH, 2 * q)]
        gone = np.zeros(len(own) + 1, dtype=np.int64)
        for a, b, q in runs:
            gone[a + q] += 1
            gone[b] -= 1
        kept = [w for w, g in zip(own, np.cumsum(gone).tolist()) if not g] if runs else own
        listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
        best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2],
                                                1000 * (best[1] - best[0]) // best[2])
        yield (i, len(own), len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(),
               hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loop: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_runs, the longest run, digests of all runs and of the collapsed text.

    Words are separated by ASCII white space.  A run is reported from
    ``MIN_LENGTH`` words and two periods on; the collapsed text leaves out
    each word that some run holds after its first period.  With ``loop``,
    rows picked by their id's checksum are given a loop first (``looped``; a
    null id counts as empty text).  Null texts are empty: no run, the digest
    of nothing.  Repeated rows each give their own; an empty table gives no
    rows; other columns are not read.  A text is worked on whole in one task,
    whatever its length, in memory of a few words' numbers a word; short
    texts share one pass of about 4 MB.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        for pdf in it:
            at = 0
            ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
            for group in batches(pdf["text"]):
                rows = list(judge(ids[at:at + len(group)], group, loop))
                at += len(group)
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in names if not c.endswith("sha256")})

    return (docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
            .mapInPandas(run, RUN_SCHEMA))

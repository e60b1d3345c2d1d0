"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  Pieces are placed in descending
order of size into the open bin with the least room that holds them; where
none does, the bin size with the least expected cost a token is opened,
and at the end each bin shrinks to the smallest length that holds its
contents.  Pieces are dealt at random into groups of bounded size that are
packed apart, each by one task.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.sources.store import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP_PIECES = 50_000  # expected pieces of a group; at this size the last bins of a group waste next to nothing
OVERHEAD = 64.0        # cost of a sequence besides its length, in tokens

PACKED = "rid long, group long, bin long, capacity int, offset int"


def open_size(size: int, left: int, capacities: tuple[int, ...], overhead: float, fill=None) -> int:
    """The permitted length >= ``size`` with the least cost for each token it can expect to hold.

    ``left``: tokens not yet placed, this piece's among them; they are what can fill a bin.
    ``fill``: the tokens that a bin of a length would hold (default: as many of ``left`` as it has room for).
    Ties go to the shorter length.
    """
    fits = [c for c in capacities if c >= size]
    return min(fits, key=lambda c: ((c + overhead) / max(1, fill(c) if fill else min(c, left)), c))


class Unplaced:
    """The sizes still to place, in ascending order of their negatives; equal ones form a run."""

    def __init__(self, sizes: np.ndarray):
        value, count = np.unique(-np.asarray(sizes, dtype=np.int64), return_counts=True)
        self.value, self.count = value.tolist(), count.tolist()

    def fill(self, size: int, placed: int, capacity: int) -> int:
        """Tokens of a new bin of ``capacity``: a piece of ``size``, of which ``placed`` are placed, then
        the largest pieces that still fit, whole ones only."""
        run = bisect_left(self.value, -size)
        room, have = capacity - size, self.count[run] - placed - 1
        while room:
            take = min(have, room // -self.value[run])
            room += take * self.value[run]
            run = max(run + 1, bisect_left(self.value, -room))
            if run == len(self.value):
                break
            have = self.count[run]
        return capacity - room


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES,
             overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and (downsized) capacity of each piece; ``sizes`` are given in descending order."""
    capacities = tuple(sorted(capacities))
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    used: list[int] = []
    opened: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by the room left
    mask = 0                                                         # bit r: some bin has room r
    left = int(sizes.sum())
    unplaced, last, since = Unplaced(sizes), 0, 0  # since: where the run of this size starts
    for i, s in enumerate(sizes.tolist()):
        if s != last:
            last, since = s, i
        above = mask >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(used), open_size(s, left, capacities, overhead, lambda c: unplaced.fill(s, i - since, c))
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        room -= s
        left -= s
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    table = np.array(capacities)
    final = table[np.searchsorted(table, np.array(used, dtype=np.int64))] if used else np.empty(0, dtype=np.int64)
    return bins, offsets, final[bins] if len(sizes) else final


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "n_tokens",
                   capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, part, n_tokens, bin_id, capacity, offset) for every piece of every row.

    A document longer than the longest length is cut into pieces of that
    length and a rest; ``part`` counts from 0.  Rows with null, zero or
    negative tokens give one row with 0 tokens and null bin_id, capacity and
    offset.  Repeated rows are each packed.  ``bin_id`` is unique over groups.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    whole = docs.select(F.col(doc_id).alias("doc_id"), n.alias("_n"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / top) - 1, F.lit(0).cast("long")))
    size = F.least(F.lit(top).cast("long"), F.col("_n") - F.col("part") * top)
    pieces = (whole.select("doc_id", "_n", F.explode(parts).alias("part"))
              .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "part", size.alias("n_tokens")))
    pieces = materialize(pieces, "llm-pieces")  # pins rid, and cuts off the pass over the texts
    filled = pieces.where("n_tokens > 0")
    n_groups = max(1, -(-filled.count() // group_pieces))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "rid"], ascending=[False, True], kind="stable")
        b, offset, cap = best_fit(pdf["n_tokens"].to_numpy(), capacities, overhead)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "group": np.int64(key[0]), "bin": b,
                             "capacity": cap.astype(np.int32), "offset": offset.astype(np.int32)})

    packed = (filled.select("rid", "n_tokens", F.pmod(F.xxhash64("rid"), F.lit(n_groups)).alias("group"))
              .groupBy("group").applyInPandas(pack, PACKED))
    return (pieces.join(packed, "rid", "left")
            .select("doc_id", "part", "n_tokens",
                    (F.col("group") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), "capacity", "offset"))

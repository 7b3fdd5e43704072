"""Best-fit packing into bins of several permitted lengths, chosen jointly.

Documents longer than the largest permitted length are cut into pieces of that length and a rest. Pieces are dealt evenly
over packing tasks of about PIECES pieces; each packs its own, longest first. A piece goes to the open bin that it fills
best. If none has room, a bin of the permitted length that costs least for each token that it will hold is opened. A bin
of length c costs c, OVERHEAD for opening, and c * c / QUADRATIC for attention, which grows with the square. What it will
hold is taken from all that still waits: greedily, longest first, the lengths that fit its room one after the other, and
of these the share that the room has among the rooms of all open bins, as these compete for the same pieces. So a long
bin is opened only where its room can be filled and its attention is worth it. Last, each bin shrinks to the least
permitted length that holds its contents. Only ids and lengths are shuffled; the dealing is round robin over sorted rows,
so no key can crowd a task and a recomputed task gets the same rows.

Defined results: null texts and texts without words have length 0 and are in no bin (no row); repeated rows are packed
each; an empty table gives an empty result. Ties: pieces of one length are packed in order of doc_id (null first) and
piece; of bins with the same room the last one touched is filled; of lengths that cost the same the smaller is opened.
Other columns are never read by `pack`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.util import materialize, n_words

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
QUADRATIC = 16_384
PIECES = 100_000
_SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, capacity long, bin_used long"


def cost(capacity: int, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    """What a bin costs, in tokens."""
    return capacity + overhead + capacity * capacity / quadratic


def _fill(waiting: list[int], at: int, room: int) -> int:
    """How much of a room the lengths in waiting[at:] can fill one after the other; they are negative, longest first."""
    full = room
    while room:
        at = bisect_left(waiting, -room, at)
        if at == len(waiting):
            break
        # All of one length that fit, at once.
        n = -waiting[at]
        end = bisect_right(waiting, -n, at, min(len(waiting), at + room // n))
        room -= n * (end - at)
        at = end
    return full - room


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (pieces come longest first, none longer than the largest capacity), and the length,
    used length and length when opened of each bin."""
    caps = sorted(capacities)
    price = {c: cost(c, overhead, quadratic) for c in caps}
    pieces, waiting = lengths.tolist(), (-lengths).tolist()
    left, open_room = sum(pieces), 0
    where, offset, used, opened = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct rooms of open bins, in order
    for k, n in enumerate(pieces):
        left -= n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                del by_room[room], rooms[at]
            open_room -= room
        else:

            def a_token(c):
                room = c - n
                share = min(1.0, left / (open_room + room)) if room else 1.0
                return price[c] / (n + share * _fill(waiting, k + 1, room))

            b, room = len(used), min((c for c in caps if c >= n), key=a_token)
            used.append(0)
            opened.append(room)
        where[k], offset[k] = b, used[b]
        used[b] += n
        room -= n
        if room >= 1:
            open_room += room
            if room in by_room:
                by_room[room].append(b)
            else:
                by_room[room] = [b]
                insort(rooms, room)
    used_ = np.array(used, np.int64)
    fits = np.array(caps, np.int64)[np.searchsorted(caps, used_)] if len(used) else used_
    return where, offset, fits, used_, np.array(opened, np.int64)


def pack(df: DataFrame, length=None, capacities=CAPACITIES, pieces_per_task: int = PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start and length in the document, bin_id, its offset in the bin,
    and the bin's capacity and used length. length: a column; the number of words by default."""
    most = max(capacities)
    sizes = df.select("doc_id", (n_words(F.col("text")) if length is None else length.cast("long")).alias("size")).filter("size > 0")
    sizes = materialize(sizes, "pack-sizes")
    pieces = sizes.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / most))).alias("piece"))
    start = F.col("piece") * most
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(most), F.col("size") - start).alias("length"))
    n = sizes.agg(F.sum(F.floor((F.col("size") - 1) / most) + 1)).first()[0] or 0
    tasks = max(1, -(-n // pieces_per_task))

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        part = pa.Table.from_batches(batches)
        first = TaskContext.get().partitionId() << 32
        size, ids, piece = (part[c].fill_null(-1).to_numpy() for c in ("length", "doc_id", "piece"))
        part = part.take(pa.array(np.lexsort((piece, ids, -size))))
        where, offset, capacity, used, _ = best_fit(part["length"].to_numpy(), capacities)
        out = part.append_column("bin_id", pa.array(where + first)).append_column("bin_offset", pa.array(offset))
        yield from out.append_column("capacity", pa.array(capacity[where])).append_column("bin_used", pa.array(used[where])).to_batches(65_536)

    return pieces.repartition(tasks).mapInArrow(run, _SCHEMA)

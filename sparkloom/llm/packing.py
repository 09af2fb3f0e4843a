"""Packing tokenized documents into sequences by exact-complement hashing, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cell_ranks, cut, lean
from .tokens import encoder


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """start, length of each piece of n tokens: pieces of `capacity`, of which the first takes what doesn't fill one."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def token_pieces(docs: DataFrame, path: str, ranks: str | None, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of little-endian uint32 ids) and, if asked, ids of each piece of each row.

    A row's ids are those of its whole text (null: empty) and end_id.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        enc = encoder(path, ranks)
        for batch in batches:
            docs_, cols = batch.column(0).to_pylist(), [[] for _ in names]
            for doc, ids in zip(docs_, enc.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    for c, v in zip(cols, (doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32))):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class SumIndex:
    """Sums of one, two and three lengths, to the combinations that give them and are still there.

    Singles are the counts themselves. Pairs lie in one array in order of their sum (capacity squared / 4 at most), the
    greater length first. Triples of a sum are a third length with a pair of the rest, so they aren't spelled out. Counts
    only fall, so a combination that is used up never comes back: a cursor for each sum passes it once and for good. One
    that is only held by the bin in the making (`held`) is passed for the moment.
    """

    def __init__(self, counts: list[int], capacity: int):
        self.c = counts
        there = np.flatnonzero(counts[:capacity])  # no length is 0
        i, j = np.tril_indices(len(there))
        a, total = there[i], there[i] + there[j]
        a, total = a[total < capacity], total[total < capacity]
        order = np.lexsort((-a, total))
        self.greater = a[order].tolist()
        self.ends = np.cumsum(np.bincount(total, minlength=capacity + 1)).tolist()
        self.pair_at = [0, *self.ends[:-1]]
        self.thirds = there[::-1].tolist()
        self.third_at = [0] * (capacity + 1)

    def _free(self, lengths: tuple[int, ...], held: tuple[int, ...] = ()) -> bool:
        return all(self.c[x] >= lengths.count(x) + held.count(x) for x in lengths)

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        c, end = self.c, self.ends[total]
        for at in range(self.pair_at[total], end):
            a = self.greater[at]
            if c[a] and c[total - a] > (2 * a == total):  # else used up
                if self._free((a, total - a), held):
                    return a, total - a
            elif at == self.pair_at[total]:
                self.pair_at[total] += 1
        return None

    def triple(self, total: int, held: tuple[int, ...]) -> tuple[int, int, int] | None:
        at = self.third_at[total]
        while at < len(self.thirds):
            third = self.thirds[at]
            if 3 * third < total:
                break
            rest = total - third
            if rest > 1 and self._free((third,), held) and (two := self.pair(rest, (*held, third))):
                return (third, *two)
            if at == self.third_at[total] and (rest < 2 or not self.c[third] or self.pair_at[rest] == self.ends[rest]):
                self.third_at[total] += 1
            at += 1
        return None

    def fill(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """The fewest lengths that fill the gap exactly, beside those held."""
        return (gap,) if self._free((gap,), held) else self.pair(gap, held) or self.triple(gap, held)


def _exact(c: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins that are filled without a gap by two to four lengths, and how many; c, the number of each length, is used up."""
    bins, index = [], SumIndex(c, capacity)
    for length in range(capacity - 1, 0, -1):
        while c[length] > 0 and (rest := index.fill(capacity - length, (length,))):
            need = Counter([length, *rest])
            m = min(c[x] // k for x, k in need.items())
            for x, k in need.items():
                c[x] -= k * m
            bins.append(([length, *rest], m))
    return bins


def _best_fit(c: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins for the numbers of lengths c: from long to short, each goes to the fullest bin that takes it, or to a new one."""
    open_, gaps = {}, []  # gap -> bins of that gap, as (lengths, number)

    def put(gap: int, items: list[int], m: int) -> None:
        if m:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((items, m))

    for length in range(capacity, 0, -1):
        n = c[length]
        while n:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                items, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[k]
            else:
                gap, items, m = capacity, [], n
            per = gap // length  # a bin that took one is the fullest for the next
            used = min(m, n // per)
            put(gap - per * length, items + [length] * per, used)
            n, m = n - used * per, m - used
            if m and n and n < per:
                put(gap - n * length, items + [length] * n, 1)
                n, m = 0, m - 1
            if items:
                put(gap, items, m)
    return [(items, m) for made in open_.values() for items, m in made]


def pack_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, number of such bins) for pieces of 1 to `capacity` tokens; it grows with lengths, not with pieces."""
    c = [0] * (capacity + 1)
    for length, n in counts.items():
        c[length] = n
    full = [([capacity], c[capacity])] if c[capacity] else []
    c[capacity] = 0
    return full + _exact(c, capacity) + _best_fit(c, capacity)


def _slots(plan: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """By length and first place: the place of a length's pieces tells bin and offset."""
    rows, used, base = [], Counter(), 0
    for items, m in plan:
        offset = 0
        for length, k in sorted(Counter(items).items(), reverse=True):
            rows.append((length, used[length], k, base, offset))
            used[length] += k * m
            offset += k * length
        base += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "per", "base", "offset"), cols))


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; cut) with sequence_id and offset in a sequence of at most `capacity`.

    The numbers of each length (capacity rows at most) come to the driver, which plans bins from them alone; a piece's
    place among those of its length then tells its bin. Sequences have no gaps before their ends.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(pack_plan(counts, capacity), capacity)
    big = int(max([0, *counts.values()])) + 1
    keys = slots["length"].astype(object) * big + slots["first"] if len(slots["length"]) and capacity * big > 2**62 else slots["length"] * big + slots["first"]
    placed = cell_ranks(pieces, ["length"], F.struct("doc_id", "piece", "ids_crc32", "start"), "place")
    kept = [c for c in placed.columns if c != "place"]

    def run(batches):
        for batch in batches:
            length, place = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "place"))
            k = np.searchsorted(keys, length * big + place, "right") - 1
            of = place - slots["first"][k]
            made = [pa.array(slots["base"][k] + of // slots["per"][k]), pa.array(slots["offset"][k] + of % slots["per"][k] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in kept], *made], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name != "place")
    return placed.mapInArrow(lean(run), f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, ranks: str | None, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each whole document.

    A null text is empty and gives its end id alone. Repeated rows are packed each for itself; an empty table gives none;
    other columns are left out. `sequences` makes the packed ids themselves.
    """
    return assign(cut(token_pieces(docs, path, ranks, capacity, end_id, False, doc_id, text)), capacity)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces' ids (token_pieces with ids) in order; a sequence is bounded by the capacity."""
    key = ["doc_id", "piece", "start", "ids_crc32"]
    once = pieces.select(*key, "ids").dropDuplicates(key)
    same = [placed[k].eqNullSafe(once[k]) for k in key]
    rows = placed.join(once, same[0] & same[1] & same[2] & same[3]).select("sequence_id", "offset", "ids")
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

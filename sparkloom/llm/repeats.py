"""Removal of repeated byte strings by prefix-free parsing: a dictionary of phrases, and suffix orders of its phrases and of the parse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop, global_places, lean, release

#: Bits of a place in a piece of text; a longer text is cut into pieces that overlap.
PLACE = 17

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def gram(length: int) -> int:
    """Bytes of a rolling hash: so many that the depths from there to `length` are bits of one long."""
    return max(1, length - 60, 2 * length // 5)


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 << PLACE)
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def triggers(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side (ends: their ends): for each trigger that is the least of some window, its hash, its place,
    and the first and last start of the windows, of `length` bytes, whose first least rolling hash it is.

    A window's trigger hangs on the window's bytes alone, so equal windows have equal triggers at equal distances.
    """
    n, wide = len(raw), gram(length)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= length
    if n < length or not fits.any():
        return none
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[wide:] - sums[:-wide]) * down[: n - wide + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = ((h >> np.uint64(32 + PLACE)) << np.uint64(PLACE)).astype(np.uint32) | np.arange(len(h), dtype=np.uint32)
    span, have = length - wide + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    valid = np.zeros(n + 1, np.int8)
    valid[starts[fits]] = 1  # texts that fit are at least `length` apart, so these places are all different
    valid[ends[fits] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid, dtype=np.int8)[: len(least)] > 0)
    x = (least[at] & np.uint32((1 << PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (at[1:] != at[:-1] + 1)]))
    return h[x[new]], x[new], at[new], at[np.append(new[1:], len(at)) - 1]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, ...]]:
    """Texts in pieces side by side: their numbers, bytes and ends, what to add for a place in the text, and the first and
    the end place of the triggers that a piece answers for. Pieces of a long text overlap, so each holds all windows of those."""
    most = (1 << PLACE) - 1
    step = most - 3 * length
    held, size = [], 0

    def out():
        parts = [texts[i][s:e] for i, s, e in held]
        s, e = (np.array(x) for x in list(zip(*held))[1:])
        full = np.array([len(texts[i]) for i, _, _ in held])
        numbers = np.array([i for i, _, _ in held])
        return numbers, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(e - s), s, np.where(s > 0, s + length, 0), np.where(e < full, s + step + length, full)

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - 3 * length), step) if len(t) >= length else ():
            e = min(len(t), s + most)
            if held and size + e - s > most:
                yield out()
                held, size = [], 0
            held.append((i, s, e))
            size += e - s
            if e == len(t):
                break
    if held:
        yield out()


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """h, k, place of each trigger of docs (k, raw): its hash, the row's key, and place: its byte << 16, the distance to the
    first start of its windows << 8, the distance to the last."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for numbers, raw, ends, shift, low, end in _pieces(batch.column(1).to_pylist(), length):
                h, x, lo, hi = triggers(raw, ends, length)
                of = np.searchsorted(ends, lo, "right")
                at = x + (shift - np.concatenate([[0], ends[:-1]]))[of]
                own = (at >= low[of]) & (at < end[of])
                place = (at << 16 | (x - lo << 8) | (x - hi))[own]
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(keys[numbers[of[own]]]), pa.array(place)], names=["h", "k", "place"])

    return docs.mapInArrow(lean(run), "h long, k long, place long")


def _bounds(place: int, size: int, length: int) -> tuple[int, int, int]:
    """The trigger's byte, and the first and the end byte of its windows."""
    at = place >> 16
    return at, max(0, at - (place >> 8 & 255)), min(size, at - (place & 255) + length)


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """h, c1, c2, g, place, again of each place of rows (g, raw, places): hashes of the trigger and of its context, which is
    the bytes of all its windows and where the trigger stands in them; again: the document held that context before."""
    names = ["h", "c1", "c2", "g", "place", "again"]
    wide = gram(length)

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            hs, cs, gs, ps, old = [], [], [], [], []
            for g, raw, places in zip(*[c.to_pylist() for c in batch.columns]):
                if g in done:  # rows alike in doc_id and text
                    continue
                done.add(g)
                own: set[bytes] = set()
                for place in sorted(places):
                    at, a, b = _bounds(place, len(raw), length)
                    if b - a >= length:
                        c = xxhash.xxh3_128_digest(raw[a:b], at - a)
                        hs.append(xxhash.xxh3_64_intdigest(raw[at : at + wide]))
                        cs.append(c)
                        gs.append(g)
                        ps.append(place)
                        old.append(c in own)
                        own.add(c)
            c = np.frombuffer(b"".join(cs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(gs, pa.int64()), pa.array(ps, pa.int64()), pa.array(old, pa.bool_())], names=names)

    return rows.mapInArrow(lean(run), "h long, c1 long, c2 long, g long, place long, again boolean")


def _sides(rows: DataFrame, length: int) -> DataFrame:
    """left, right, g, place of each place of rows (g, raw, places): the phrase that ends with the trigger, from back to
    front, and the parse from the trigger on, each as far as the trigger's windows reach."""
    wide = gram(length)

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for g, raw, places in zip(*[c.to_pylist() for c in batch.columns]):
                if g in done:
                    continue
                done.add(g)
                for place in places:
                    at, a, b = _bounds(place, len(raw), length)
                    for c, v in zip(cols, (raw[a : at + wide][::-1], raw[at:b], g, place)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["left", "right", "g", "place"])

    return rows.mapInArrow(lean(run), "left binary, right binary, g long, place long")


def common(strings: list[bytes], width: int) -> np.ndarray:
    """The common prefix of each string of at most `width` bytes with the one before it; 0 for the first."""
    out, size = np.zeros(len(strings), np.int64), np.fromiter(map(len, strings), np.int64, len(strings))
    for at in range(1, len(strings), 1 << 13):
        part = strings[at - 1 : at + (1 << 13)]
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(-1, width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[at : at + len(first)] = np.minimum(first, np.minimum(size[at - 1 : at - 1 + len(first)], size[at : at + len(first)]))
    return out


def met(mask: int, depth: int) -> int:
    """Depths of the nodes above a string, as bits, once the next string shares `depth` with the last; -1: nothing."""
    return 0 if depth < 0 else (mask & ((1 << depth) - 1)) | (1 << depth)


def clipped(mask: int, depth: int) -> int:
    """Depths, none above `depth`: those above it come down to it."""
    return 0 if depth < 0 else (mask & ((1 << depth) - 1)) | ((1 << depth) if mask >> depth else 0)


def _ordered(rows: DataFrame, by: str, then: str, out: str, length: int) -> DataFrame:
    """rows with `out`: in the order of all rows' strings `by`, the depths (as bits from gram(length) on) of the nodes that a
    string lies in with others, which are the running minima of the common prefixes on both sides.

    Rows are sorted over range partitions, equal strings by `then`, so that no string is bound to one task. Within a
    partition minima run forth and back; the masks at its two ends, two rows of each partition, come to the driver, which
    carries them from partition to partition.
    """
    wide, top = gram(length), length - gram(length) + 1
    fields = [f.name for f in rows.schema]
    more = ["part", "edge", "fore", "back", "low", "high"]

    def run(batches):
        batches = list(batches)
        n = sum(b.num_rows for b in batches)
        if not n:
            return
        table = pa.Table.from_batches(batches)
        shared = (common(table.column(by).to_pylist(), length) - wide).tolist()
        fore, back, low, high = [0] * n, [0] * n, [top] * n, [top] * n
        for i in range(1, n):
            p = max(-1, shared[i])
            fore[i], low[i] = met(fore[i - 1], p), min(low[i - 1], p)
        for i in range(n - 2, -1, -1):
            p = max(-1, shared[i + 1])
            back[i], high[i] = met(back[i + 1], p), min(high[i + 1], p)
        edge = [0] * n
        edge[0] |= 1
        edge[-1] |= 2
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for name, values in zip(more, ([part] * n, edge, fore, back, low, high)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + ", ".join(f"{m} long" for m in more)
    local = cut(rows.orderBy(by, then, "g", "place").mapInArrow(lean(run), schema))
    ends: dict[int, dict] = {}
    for r in local.where("edge > 0").select(by, *more).collect():  # two rows of each partition at most
        for side in (1, 2):
            if r["edge"] & side:
                ends.setdefault(r["part"], {})[side] = r
    parts = sorted(ends)
    left, right = {p: 0 for p in parts}, {p: 0 for p in parts}
    gaps = [int(common([ends[p][2][by], ends[q][1][by]], length)[1]) - wide for p, q in zip(parts, parts[1:])]
    for p, q, gap in zip(parts, parts[1:], gaps):
        last = ends[p][2]
        left[q] = met(last["fore"] | clipped(left[p], last["low"]), max(-1, gap))
    for p, q, gap in zip(reversed(parts), reversed(parts[:-1]), reversed(gaps)):
        first = ends[p][1]
        right[q] = met(first["back"] | clipped(right[p], first["high"]), max(-1, gap))
    carried = {p: (left[p], right[p]) for p in parts if left[p] or right[p]}

    def mend(batches):
        for batch in batches:
            col = {m: batch.column(batch.schema.get_field_index(m)).to_pylist() for m in more}
            masks = [
                f | b if p not in carried else f | b | clipped(carried[p][0], lo) | clipped(carried[p][1], hi)
                for p, f, b, lo, hi in zip(col["part"], col["fore"], col["back"], col["low"], col["high"])
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in fields], pa.array(masks, pa.int64())], names=[*fields, out])

    return local.mapInArrow(mend, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {out} long")


def runs(near: int, far: int, lefts: int, rights: int, top: int) -> Iterator[tuple[int, int, int, int]]:
    """first and last distance, from near to far, at which a window lies in one node of the phrases' order and one of the
    parse's order, and the depths of the two: a window at distance l has l bytes before the trigger, top - l behind it."""
    l = near
    while l <= far:
        above = lefts >> l
        if not above:
            return
        i = l + (above & -above).bit_length() - 1
        above = rights >> (top - l)
        if not above:
            l = max(l + 1, top - rights.bit_length() + 1)
            continue
        j = top - l + (above & -above).bit_length() - 1
        lower = (rights & ((1 << j) - 1)).bit_length() - 1  # the next node up, which takes over from there
        last = min(i, far, top - lower - 1)
        yield l, last, i, j
        l = last + 1


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """w1, w2, g, s1, s2: for each run of windows of an entry whose phrase side and parse side lie in nodes with others, a
    hash of the two nodes' bytes, and the first and last start. Entries have a hash in common if they share those windows."""
    wide, top = gram(length), length - gram(length)

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("left", "right", "g", "place", "lefts", "rights")}
            keys, gs, lo, hi = [], [], [], []
            for left, right, g, place, lefts, rights in zip(*cols.values()):
                at, far, near = place >> 16, place >> 8 & 255, place & 255
                for first, last, i, j in runs(near, far, lefts, rights, top):
                    keys.append(xxhash.xxh3_128_digest(left[: i + wide] + right[wide : j + wide], i << 16 | first << 8 | last))
                    gs.append(g)
                    lo.append(at - last)
                    hi.append(at - first)
            w = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *[pa.array(c, pa.int64()) for c in (gs, lo, hi)]], names=["w1", "w2", "g", "s1", "s2"])

    return rows.mapInArrow(lean(run), "w1 long, w2 long, g long, s1 long, s2 long")


def _later(rows: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """rows (cut) that aren't the first of their key in the order of `first`; equal ones of the first aren't either."""
    firsts = cut(rows.groupBy(*key).agg(F.min(F.struct(*first)).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(firsts, key).where(F.struct(*first) != F.col("f"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, t1, t2 (128 bits of a hash of the text), k (a hash of the three), raw."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), raw.alias("raw"), F.xxhash64(raw).alias("t1"), F.xxhash64(F.lit(1), raw).alias("t2"))
    return rows.withColumn("k", F.xxhash64("doc", "t1", "t2"))


def _with_texts(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """g, raw, places of places (k, t2, g, places); a text without places is dealt out, but goes no further."""
    return keyed.select("k", "t2", "raw").join(places, ["k", "t2"]).select("g", "raw", "places")


def repeated_spans(keyed: DataFrame, length: int = 100) -> DataFrame:
    """k, t2, spans (start, end; unordered, they may overlap) of what repeats in keyed (doc, t1, t2, k, raw)."""
    spark = keyed.sparkSession
    ids = cut(keyed.select("doc", "t1", "t2", "k", F.length("raw").cast("long").alias("n")).distinct())
    ids = cut(global_places(ids, [F.col("doc").isNull().asc(), F.col("doc").asc(), F.col("t1").asc(), F.col("t2").asc()], "g"))
    copies = cut(_later(ids.select("t1", "t2", "g", "k", "n"), ["t1", "t2"], ["g"]).select("g", "n"))
    new = cut(ids.join(copies.select("g"), "g", "left_anti").select("k", "t2", "g"))
    release(spark)

    seen = cut(_parse(keyed.select("k", "raw"), length))
    shared = cut(seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    release(spark)
    places = cut(seen.join(shared.hint("shuffle_hash"), "h").groupBy("k").agg(F.collect_set("place").alias("places")))
    drop(seen, shared)
    release(spark)

    found = cut(_contexts(_with_texts(keyed, cut(new.join(places, "k"))), length))
    drop(places)
    release(spark)
    once = found.where("NOT again").drop("again")
    words = cut(once.groupBy("c1", "c2").agg(F.min(F.struct("g", "place")).alias("f"), F.count("*").alias("n"), F.min("h").alias("h")))
    again = once.join(words.where("n > 1").select("c1", "c2", "f"), ["c1", "c2"]).where(F.struct("g", "place") != F.col("f"))
    at = F.shiftright("place", 16)
    whole = [(at - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("start"), (at - F.col("place").bitwiseAND(F.lit(255)) + length).alias("end")]
    copied = cut(again.select("g", *whole).unionByName(found.where("again").select("g", *whole)))
    drop(found)
    release(spark)

    several = cut(words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    entries = cut(words.join(several, "h").select("f.g", "f.place").groupBy("g").agg(F.collect_list("place").alias("places")).join(new, "g"))
    release(spark)
    sides = cut(_sides(_with_texts(keyed, entries), length))
    drop(words, several, entries)
    release(spark)
    parsed = cut(_ordered(sides, "right", "left", "rights", length).where("rights > 0"))
    release(spark)
    both = _ordered(parsed, "left", "right", "lefts", length).where("lefts > 0")
    windows = cut(_windows(both, length))
    drop(sides, parsed)
    release(spark)
    later = _later(windows, ["w1", "w2"], ["g", "s1", "s2"]).select("g", F.col("s1").alias("start"), (F.col("s2") + length).alias("end"))
    spans = copied.unionByName(later).unionByName(copies.where(F.col("n") >= length).select("g", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    marks = cut(spans.groupBy("g").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(ids.select("g", "k", "t2"), "g").select("k", "t2", "spans"))
    drop(windows, copied)
    release(spark)
    return marks


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (bytes) and spans of each whole document.

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document of smaller
    doc_id, or earlier in the same one; strings are judged on the input and may overlap. A null text is empty. Null doc_ids
    come last; rows of one doc_id and one text are one document, whose result each of them gets; texts of one doc_id are
    ordered by a hash. An empty table gives none; other columns are left out.

    Prefix-free parsing, to the depth of `length` bytes. A trigger is a place whose rolling hash is the least of a window;
    triggers part texts into phrases, and every window hangs on one trigger, by its bytes alone. (1) Of documents alike all
    but the first go as a whole. (2) Triggers whose hash stands once in the corpus hold no repeat. (3) The dictionary: a
    phrase with what its windows reach is an entry, and all its occurrences but the first in the corpus go as a whole.
    (4) Entries that share a trigger with another are put into two suffix orders, that of the phrases (read from the trigger
    back) and that of the parse (read from the trigger on), with the common prefixes of neighbours. In each order a window's
    side belongs to one node, the run of entries that share it; two nodes, one of each order, name a set of entries that
    share a run of windows, and of these the first in the order of the corpus stays. Sets are named by 128 bits of a hash of
    their bytes: for a collision to be likely a corpus must have some 10^18 phrases.
    """
    if not 2 <= length <= 1 << 14:
        raise ValueError("length must be 2 to 16384")
    keyed = _keyed(docs, doc_id, text)
    marks = repeated_spans(keyed, length)
    rows = keyed.select("doc", "raw", "k", "t2").join(marks, ["k", "t2"], "left").select("doc", "raw", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * with_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, raw, found in zip(*[c.to_pylist() for c in batch.columns]):
                gone = merged([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *[x for s in gone for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else raw
                for c, v in zip(cols, (doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, gone)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * with_text)

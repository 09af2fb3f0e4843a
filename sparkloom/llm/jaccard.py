"""Jaccard join of word shingles: tiles of near sizes, hashed bitmap signatures that bound overlap, exact intersections."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .runtime import cut, drop, lean, release
from .shingles import shingle_set

#: Bits of a signature: a power of two of at least half the set's size within these bounds. Wider ones are folded to meet narrower ones.
LEAST_BITS, MOST_BITS = 256, 8192
#: Most frequent shingles that stand last in the order of all shingles: 8 MB to each worker at most.
MOST_FREQUENT = 1 << 20
#: Texts among which frequent shingles are looked for: one of so many, by hash. What is frequent decides the cost, never the result.
SAMPLE = 16
#: A shingle that so many texts of the sample hold is a frequent one.
FREQUENT = 4
#: Rows of a tile that meet in one task; larger tiles are cut into blocks whose pairs are dealt out.
BLOCK = 2048
#: Shingles of the sets of a block, where sets themselves meet: 32 MB.
HELD = 1 << 22
#: So many times more shingles have the sets of a block whose wide signatures meet: 16 MB.
WIDER = 8
#: Shingles of each set whose tiles are searched first, its most shared ones, to group near copies before the rest meet.
FIRST = 2


def signature(hashes: np.ndarray, wide: bool = False) -> bytes:
    """Bit b is set if an odd number of shingles falls on b: two signatures differ in no more bits than the sets in shingles.

    A wide one has two to four bits for each shingle, a sixteenth to a thirty-second of the set: it leaves room for few sets
    that don't link.
    """
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if wide else min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(hashes) // 2 - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(signatures: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to so many; the low bits of a hash stay its place."""
    while signatures.shape[1] > words:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def prefix_size(n: int, percent: int) -> int:
    """So many shingles, first in a fixed order of all, of a set of n: of two linked sets both have one in common among them."""
    return n - ceil(percent * n / 100) + 1 if n else 0


def prefix(hashes: np.ndarray, percent: int, last: np.ndarray) -> np.ndarray:
    """The set's first shingles in the order (stands in `last`, hash); hashes and `last` ascend."""
    p = prefix_size(len(hashes), percent)
    if not len(last):
        return hashes[:p]
    late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
    return np.concatenate([hashes[~late], hashes[late]])[:p]


def _longs(a: np.ndarray) -> list[int]:
    return a.view("<i8").tolist()


def _signed(docs: DataFrame, words_in: int, percent: int, last: np.ndarray) -> DataFrame:
    """doc_id, th, n, node (a hash of the set), first (its first shingles) and sig of each row."""

    def run(batches):
        for b in batches:
            n, nodes, first, sigs = [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), words_in)
                n.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                first.append(_longs(prefix(s, percent, last)))
                sigs.append(signature(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.array(nodes, "<u8").view("<i8")), pa.array(first, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "th", "n", "node", "first", "sig"])

    return docs.mapInArrow(lean(run), "doc_id long, th long, n long, node long, first array<long>, sig binary")


def _gathered(picked: DataFrame, asked: DataFrame, words_in: int) -> DataFrame:
    """node, shared and the set, ascending hashes as bytes, of the nodes asked for (node, shared, d, t: a row's doc_id and hash
    of text). Texts are dealt once: repeated rows meet where the join has put them."""

    def gather(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t.as_py(), words_in).tobytes() for t in b.column(2)], pa.binary())], names=["node", "shared", "set"])

    texts = picked.select(F.struct("doc_id", "th").alias("key"), "text")  # structs are equal where both have null
    keys = asked.select(F.struct(F.col("d").alias("doc_id"), F.col("t").alias("th")).alias("asked"), "node", "shared")
    found = texts.join(keys, F.col("key") == F.col("asked")).dropDuplicates(["asked", "node"])
    return found.select("node", "shared", "text").mapInArrow(lean(gather), "node long, shared long, set binary")


def _widened(sets: DataFrame) -> DataFrame:
    """node, shared and the wide signature of each set."""

    def run(batches):
        for b in batches:
            sigs = [signature(np.frombuffer(s.as_py(), "<u8"), wide=True) for s in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary())], names=["node", "shared", "sig"])

    return sets.select("node", "shared", "set").mapInArrow(lean(run), "node long, shared long, sig binary")


def _frequent(picked: DataFrame, words_in: int) -> np.ndarray:
    """Frequent shingles of the sample, ascending: all, or those above the next power of two that leaves MOST_FREQUENT."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_longs(shingle_set(t.as_py(), words_in)) for t in b.column(0)], pa.list_(pa.int64()))], names=["set"])

    sample = picked.where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text")
    counts = cut(sample.mapInArrow(lean(run), "set array<long>").select(F.explode("set").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT))
    power = F.floor(F.log2("c")).cast("int")
    sizes = {r["k"]: r["n"] for r in counts.groupBy(power.alias("k")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > MOST_FREQUENT:
            break
        total, least = total + sizes[k], k
    found = counts.where(power >= least).select("tok").toArrow() if total else None
    drop(counts)
    return np.sort(found.column("tok").combine_chunks().to_numpy().view("<u8")) if total else np.zeros(0, "<u8")


def _band(n: Column, percent: int) -> Column:
    """Sets that link are in the same or neighbouring bands; the rounding of logarithms moves a bound for all sets alike."""
    return F.floor(F.log(n.cast("double")) / F.lit(-log(percent / 100) + 1e-12)).cast("int")


def _cells(batches):
    """Rows of each cell of tiles; they come sorted by tile, cell, then key."""
    held, key = [], None
    for b in batches:
        for r in b.to_pylist():
            k = (r["tok"], r["band"], r["i"], r["j"])
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(r)
    if held:
        yield held


def _meeting(rows: list[dict], percent: int):
    """root (a number for each row's root) of a cell's rows, and room(k): the rows after row k that aren't tied to it yet and
    whose signatures leave room for a link with it. Who changes root changes what room gives."""
    words = min(len(r["sig"]) for r in rows) // 8
    sigs = np.stack([fold(np.frombuffer(r["sig"], "<u8")[None], words)[0] for r in rows])
    cross = rows[0]["i"] != rows[0]["j"]
    n, side, guest = (np.array([r[c] for r in rows]) for c in ("n", "block", "guest"))
    _, root = np.unique([r["root"] for r in rows], return_inverse=True)

    def room(k: int) -> np.ndarray:
        rest = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
        if cross:
            rest = rest[side[rest] != side[k]]
        if guest[k]:
            rest = rest[~guest[rest]]
        both = n[k] + n[rest]
        apart = np.bitwise_count(sigs[rest] ^ sigs[k]).sum(1, dtype=np.int64)
        # overlap <= (both - apart) / 2, and a link needs (100 + percent) overlap >= percent both
        return rest[(100 + percent) * (both - apart) >= 2 * percent * both]

    return root, room


def _prune(percent: int):
    """Candidates among the rows of each cell of tiles, for mapInArrow.

    A row that opens a link first meets all others of the cell that aren't tied to it yet; a pair is kept if its signatures
    leave room for enough overlap and it ties rows together that what has been kept so far does not.
    """

    def run(batches):
        a, b = [], []
        for rows in _cells(batches):
            root, room = _meeting(rows, percent)
            for k in range(len(rows) - 1):
                may = room(k)
                for m in may[np.sort(np.unique(root[may], return_index=True)[1])].tolist():
                    x, y = sorted((rows[k]["node"], rows[m]["node"]))
                    a.append(x)
                    b.append(y)
                    root[root == root[m]] = root[k]
            if len(a) > 4096:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def _roomy(percent: int):
    """What of each cell's rows may link yet, for mapInArrow: (node, node) of a row that another root's row has room for, and
    pairs a < b with room, a forest of each cell, that tie together all such rows. No more of either than rows come in."""

    def run(batches):
        a, b = [], []
        for rows in _cells(batches):
            root, room = _meeting(rows, percent)
            tied, hit = root.copy(), np.zeros(len(rows), bool)
            for k in range(len(rows) - 1):
                may = room(k)
                if not len(may):
                    continue
                hit[may] = hit[k] = True
                may = may[tied[may] != tied[k]]
                for m in may[np.unique(tied[may], return_index=True)[1]].tolist():
                    x, y = sorted((rows[k]["node"], rows[m]["node"]))
                    a.append(x)
                    b.append(y)
                    tied[tied == tied[m]] = tied[k]
            for k in np.flatnonzero(hit).tolist():
                a.append(rows[k]["node"])
                b.append(rows[k]["node"])
            if len(a) > 4096:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def _tied(percent: int):
    """Links among the rows of each cell, for mapInArrow, by intersection of their sets: a forest that ties all rows that links
    of the cell tie, so fewer rows than come in, however many pairs have room."""

    def run(batches):
        a, b = [], []
        for rows in _cells(batches):
            sets = [np.frombuffer(r["set"], "<u8") for r in rows]
            for r, s in zip(rows, sets):
                r["sig"] = signature(s)
            root, room = _meeting(rows, percent)
            for k in range(len(rows) - 1):
                may, own = room(k), sets[k]
                while len(may):
                    now, may = may[:64], may[64:]
                    size = np.array([len(sets[m]) for m in now])
                    met = np.concatenate([sets[m] for m in now])
                    same = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
                    both = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
                    for m in now[100 * both >= percent * (len(own) + size - both)].tolist():
                        if root[m] != root[k]:
                            x, y = sorted((rows[k]["node"], rows[m]["node"]))
                            a.append(x)
                            b.append(y)
                            root[root == root[m]] = root[k]
                    may = may[root[may] != root[k]]
            if len(a) > 4096:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(tiles: DataFrame, more: DataFrame, percent: int, block: int, held: int = 0) -> DataFrame:
    """Tiles' rows (tok, node, n, root) with what `more` has of their nodes, dealt to cells and sorted within each.

    A tile is a shingle and a size band: sets of the band, and as guests those of the band above, which don't meet each other
    there. Large tiles are cut into blocks by a hash, and each pair of blocks is a cell. With `held`, a block's sets have
    so many shingles at most, give or take the hash, down to 16 sets.
    """
    own = _band(F.col("n"), percent)
    placed = tiles.withColumn("own", own).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("guest", F.col("band") < F.col("own"))
    most = F.least(F.lit(float(block)), F.greatest(F.lit(16.0), F.lit(float(held)) / F.max("n"))) if held else F.lit(float(block))
    sizes = placed.groupBy("tok", "band").agg(F.ceil(F.count("*") / most).cast("int").alias("g"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("guest").alias("all_guests")).where("lo <> hi and not all_guests").select("tok", "band", "g")
    met = placed.join(sizes, ["tok", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = met.select("tok", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", "node", "n", "root").join(more, "node")
    return dealt.repartition("tok", "band", "i", "j").sortWithinPartitions("tok", "band", "i", "j", F.desc("shared"), "node")


def _candidates(tiles: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs a < b of tiles' rows (tok, node, n, root) whose signatures leave room for a link: a forest of each cell."""
    return _dealt(tiles, nodes.select("node", "sig", "shared"), percent, block).mapInArrow(lean(_prune(percent)), "a long, b long").distinct()


def _clustered(may: DataFrame, owned: DataFrame) -> DataFrame:
    """tok (a cluster), node, n, root of the nodes that `may`, of `_roomy`, has marked: what its pairs tie of roots is a cluster."""
    x, y = (owned.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    clusters = components(may.where("a < b").join(x, "a").join(y, "b"), "root_a", "root_b")
    marked = owned.join(may.where("a = b").select(F.col("a").alias("node")), "node")
    return marked.join(clusters.select(F.col("root").alias("tok"), F.col("node").alias("root")), "root").select("tok", "node", "n", "root")


def _ties(tiles: DataFrame, nodes: DataFrame, reach: DataFrame, picked: DataFrame, percent: int, words_in: int, block: int) -> DataFrame:
    """Links a < b that tie all of the tiles' rows (tok, node, n, root) that any link between two roots ties.

    Pairs with room fall within clusters of what the roots and the tiles' forests tie. The clusters' sets that have room then
    meet as tiles do, each once for a cluster instead of once for each shingle: first wide signatures, which are small enough
    for many to a block, then the sets that these leave room for, in the clusters that are left. A large cluster's sets
    are thus not dealt once for each of its blocks; pairs without a link arise in a task and stay there.
    """
    spark = tiles.sparkSession

    def roomy(rows: DataFrame, more: DataFrame, held: int = 0) -> DataFrame:
        return cut(_dealt(rows, more, percent, block, held).mapInArrow(lean(_roomy(percent)), "a long, b long").distinct())

    owned = cut(nodes.select("node", "n").join(reach, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    may = roomy(tiles, nodes.select("node", "sig", "shared"))
    left = cut(_clustered(may, owned))
    release(spark)
    sets = cut(_gathered(picked, nodes.join(left.select("node"), "node").select("node", "d", "t", "shared"), words_in))
    release(spark)
    fine = roomy(left, _widened(sets), WIDER * HELD)
    near = cut(_clustered(fine, owned))
    found = cut(_dealt(near, sets.join(near.select("node"), "node", "left_semi"), percent, block, HELD).mapInArrow(lean(_tied(percent)), "a long, b long").distinct())
    release(spark)
    drop(owned, may, left, sets, fine, near)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose sets link, by intersection of their hashes."""

    def run(batches):
        for b in batches:
            keep = []
            for m in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[m].as_py(), "<u8") for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return cut(met.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long, linked boolean"))


def _proposed(slim: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs a < b that `groups` (text_hash, group) proposes: each set of a group with the group's smallest, so no pairs of all."""
    texts = groups.select(F.col("text_hash").alias("th"), "group").distinct()
    own = cut(slim.where("n > 0").select("th", "node").distinct().join(texts, "th").join(nodes.select("node"), "node").select("group", "node").distinct())
    heads = own.groupBy("group").agg(F.min("node").alias("head"))
    return own.join(heads, "group").where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _linked(docs: DataFrame, percent: int, words_in: int, doc_id: str, text: str, block: int, proposed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, th, n, node of each row (equal sets are one node); node, least of each set with words; node, root of sets that
    have links.

    All shingles stand in one order: by hash, the most frequent ones last. Linked sets share one of their first shingles in
    that order, so these name the tiles, and nothing is lost by any choice of what is frequent. Tiles of near copies make few
    pairs: the first two rounds keep a forest of what signatures let link, exact intersection judges it, and only sets that are
    still apart and that signatures, narrow and then wide ones, let link then meet, where intersections are taken in the task and
    a forest of links alone comes out. Sets are told apart by 64 bits of a hash. Groups that are
    `proposed` come first: they are judged like the forest, so they save pairs and change no link.
    """
    own = F.col(f"`{text}`").cast("string")
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("th"), own.alias("text"))
    spark = docs.sparkSession
    last = _frequent(picked, words_in)
    rows = cut(_signed(picked, words_in, percent, last).withColumn("row", F.monotonically_increasing_id()))
    named = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")))
    heads = cut(rows.join(named.select("row"), "row", "left_semi").select("node", "n", "sig", F.col("doc_id").alias("d"), F.col("th").alias("t"), "first"))
    slim = cut(rows.select("doc_id", "th", "n", "node"))
    drop(rows)
    release(spark)
    first = heads.select("node", F.explode("first").alias("tok"))
    again = first.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")  # shingles that two sets name at least
    known = cut(first.join(again, "tok"))
    release(spark)
    nodes = cut(heads.drop("first").join(known.groupBy("node").agg(F.count("*").alias("shared")), "node"))
    drop(heads)
    release(spark)
    order = Window.partitionBy("node").orderBy(F.desc("c"), "tok")  # a set's own first shingles
    tiles = cut(known.withColumn("pos", F.row_number().over(order)).join(nodes.select("node", "n"), "node"))
    drop(known)

    def at(some: Column, roots: DataFrame | None) -> DataFrame:
        part = tiles.where(some).select("tok", "node", "n")
        return part.withColumn("root", F.col("node")) if roots is None else part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # what may link, as a forest over all sets that have any such partner; then the sets, and what is left
    guessed = None if proposed is None else cut(_proposed(slim, nodes, proposed))
    release(spark)
    likely = cut(_candidates(at(F.col("pos") <= FIRST, None if guessed is None else cut(components(guessed))), nodes, percent, block))
    likely = likely if guessed is None else guessed.unionByName(likely)
    more = cut(_candidates(at(F.lit(True), cut(components(likely))), nodes, percent, block))
    release(spark)
    tried = likely.unionByName(more)
    asked = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    sets = cut(_gathered(picked, nodes.join(asked, "node").select("node", "d", "t", "shared"), words_in))
    release(spark)
    links = _verified(tried, sets, percent)
    release(spark)
    reach = cut(components(links.where("linked")))
    drop(sets)
    links = links.where("linked").select("a", "b")
    links = links.unionByName(_ties(at(F.lit(True), reach), nodes, reach, picked, percent, words_in, block))
    reach = cut(components(links))
    release(spark)
    drop(tiles, nodes)
    return slim, named, reach


def jaccard_components(docs: DataFrame, percent: int = 85, words_in: int = 4, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: two rows link where 100 |A and B| >= percent |A or B| of their sets of
    word shingles, and a component is what links reach; component_id is its smallest doc_id.

    Texts without words, null ones too, have no shingles and link with nothing, not even alike ones; with fewer words than
    words_in the whole sequence is one shingle. Equal sets are one node, so copies make no pairs. Null doc_ids are carried and
    are component_id only in a component without others. Repeated rows are repeated; an empty table gives none; other
    columns are left out.
    """
    slim, named, reach = _linked(docs, percent, words_in, doc_id, text, block)
    grouped = named.select("node", "least").join(reach, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    firsts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.join(firsts, "root").select("node", "component_id")
    out = slim.join(of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, words_in: int = 5, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, proposed: DataFrame | None = None) -> DataFrame:
    """doc_id, group (a set's id), component_id (the group's smallest doc_id) and text_hash of each row, linked as by
    `jaccard_components`, but that texts without words are one group.

    `proposed` (text_hash, group) of the same rows, as by `simhash.near_duplicates`: groups whose links are verified before
    any others are looked for. Wrong ones cost time only.
    """
    slim, _, reach = _linked(docs, percent, words_in, doc_id, text, block, proposed)
    nodes = slim.groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = cut(nodes.join(reach, "node", "left").select("node", "least", F.coalesce("root", "node").alias("group")))
    firsts = cut(grouped.groupBy("group").agg(F.min("least").alias("component_id")))
    of = grouped.select("node", "group").join(firsts, "group")
    return slim.join(of, "node").select("doc_id", "group", "component_id", F.col("th").alias("text_hash"))


#: The same rows of a table `documents`.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w
), nodes AS (
  SELECT md5(array_to_string(list_sort(sh), chr(10))) AS node, min(doc_id) AS least, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1
), e AS (
  SELECT node, n, unnest(sh) AS t FROM nodes
), p AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), c AS (
  SELECT reach.a AS node, min(nodes.least) AS component_id FROM reach JOIN nodes ON reach.b = nodes.node GROUP BY 1
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.node = md5(array_to_string(list_sort(s.sh), chr(10)))
"""

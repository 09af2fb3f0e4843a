"""Approximate nearest neighbours: inverted lists, and an adaptive dimension scan within each probed list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut, lean

#: Most vectors that the fit reads; most lists; candidates and queries that meet in one task.
SAMPLE, LISTS, BLOCK, ASKS = 16384, 4096, 8192, 2048
#: Entries that every query is compared with first: the distances of those in its lists bound what the lists may give.
PILOT = 4096
#: Share of the sample's own neighbours that the probed lists must hold, which sets their number.
COVER = 0.97
#: Dimensions of a column block, and the test's width: a candidate goes when its distance in d of D rotated dimensions is
#: over the bound by more than chance allows, (1 + WIDTH / sqrt(d)) for lengths.
COLUMNS, WIDTH = 16, 2.1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each point its n nearest centres, nearest first."""
    d = (centres**2).sum(1) - 2 * points @ centres.T
    n = min(n, len(centres))
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


class Index:
    """What a bounded sample fits: norm bound, rotation, centres, lists to probe, and a pilot that bounds distances.

    Greatest inner product is least distance once each candidate has one more dimension, sqrt(bound^2 - norm^2), and each
    query a zero there.
    """

    def __init__(self, sample: np.ndarray, bound: float, rows: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bound, self.k = bound, k
        dims = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        points = self.lifted(sample)
        lists = int(np.clip(round(np.sqrt(rows)), 1, min(LISTS, max(1, len(points) // 8))))
        centres = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(8):
            of = _nearest(points, centres, 1)[:, 0]
            n = np.bincount(of, minlength=lists)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, points)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.centres = centres
        asks = rng.choice(len(points), min(256, len(points)), replace=False)
        queries = self.queries(sample[asks])
        exact = _nearest(queries, points, k + 1)
        of = _nearest(points, centres, 1)[:, 0]
        order = _nearest(queries, centres, lists)
        place = np.argsort(order, axis=1)
        self.probes = int(np.clip(np.quantile(np.take_along_axis(place, of[exact], 1) + 1, COVER, method="higher"), 1, lists))
        self.pilot, self.pilot_list = points[:PILOT], of[:PILOT]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.bound**2 - (vectors**2).sum(1), 0))
        return np.column_stack([vectors, rest]) @ self.rotation

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.zeros(len(vectors))]) @ self.rotation

    def bounds(self, queries: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Squared distances within which the pilot's entries in each query's probed lists (query x list) give it k others;
        infinite if they are too few."""
        if len(self.pilot) <= self.k:
            return np.full(len(queries), np.inf)
        d = (queries**2).sum(1)[:, None] + (self.pilot**2).sum(1) - 2 * queries @ self.pilot.T
        d = np.where(probed[:, self.pilot_list], d, np.inf)
        return np.partition(d, self.k, axis=1)[:, self.k] * (1 + 1e-9) + 1e-12


def scan(queries: np.ndarray, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no column block's test gives up: distances grow block by block of rotated dimensions,
    and a pair goes as soon as its share of the distance says that the whole is over the query's bound."""
    dims = queries.shape[1]
    q, p = queries[:, :COLUMNS], points[:, :COLUMNS]
    d = (q**2).sum(1)[:, None] + (p**2).sum(1) - 2 * q @ p.T
    d0 = min(COLUMNS, dims)
    limit = lambda n: bounds * (n / dims) * (1 + WIDTH / np.sqrt(n)) ** 2 if n < dims else bounds
    i, j = np.nonzero(d <= limit(d0)[:, None] + 1e-9)
    part = d[i, j]
    for at in range(COLUMNS, dims, COLUMNS):
        part = part + ((queries[i, at : at + COLUMNS] - points[j, at : at + COLUMNS]) ** 2).sum(1)
        keep = part <= limit(min(at + COLUMNS, dims))[i] + 1e-9
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids (the `keep` least of its ids, ascending), rep (the least): rows of equal vectors as one. A vector that many
    rows share is first cut in 24 salted parts, so no task sorts them all; nothing past the `keep` least can be asked for."""
    w = lambda *by: Window.partitionBy(*by).orderBy("id")
    parts = rows.withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.lit(24))).withColumn("r", F.row_number().over(w("v", "salt"))).where(F.col("r") <= keep)
    least = parts.withColumn("r", F.row_number().over(w("v"))).where(F.col("r") <= keep)
    return least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("rep"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the `k` vectors of greatest inner product found for each query row.

    `is_query` is a condition on the column id. Vectors that are null, empty, zero or hold null or non-finite values take no
    part, nor do null ids. Vectors of different lengths have no inner product, so each length is searched for itself. Every
    other row is a candidate of every query but those of its own id; an id that stands with several vectors is one neighbour,
    by its greatest score, and as a query it has one ranking, of the best that any of its vectors finds. Scores are in double
    precision, ties go to the smaller id. All candidates are returned if there are at most k. An empty table gives none; other
    columns are left out.

    Equal vectors are one entry of the index. A sample of at most SAMPLE entries fits centres, as many as the root of the
    entries, and the number of lists to probe; every entry is put in its centre's list. Lists and their queries meet in
    blocks of at most BLOCK and ASKS, so neither a large list nor a popular one lands in one task. Only probed lists give
    results; queries to which the scan leaves too few scan their lists again without a bound.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL").where(_valid(F.col("v")))
    rows = cut(rows.distinct())
    sizes = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # one, but for odd tables
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = _pairs(rows.where(F.size("v") == sizes[0]), is_query, k)
    for n in sizes[1:]:
        pairs = pairs.unionByName(_pairs(rows.where(F.size("v") == n), is_query, k))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pairs(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, vec_id, score: what the index finds for the queries among rows (id, v; distinct, of one length), k others of
    each query's vector at least if there are so many."""
    spark = rows.sparkSession
    entries = cut(_distinct(rows, k + 1))
    lone = not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()  # no id has two vectors
    n, bound = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    share = F.lit(min(1.0, SAMPLE / n) * (1 << 30))
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("v"), "rep").limit(SAMPLE).select("v").toArrow()
    sample = sample if sample.num_rows > 1 else entries.orderBy("rep").limit(SAMPLE).select("v").toArrow()
    index = Index(_matrix(sample.column(0)), float(np.sqrt(bound)), n, k)
    held = spark.sparkContext.broadcast(index)

    def to_list(batches):
        for batch in batches:
            of = _nearest(held.value.lifted(_matrix(batch.column(2))), held.value.centres, 1)[:, 0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], names=["rep", "ids", "v", "list"])

    listed = cut(entries.select("rep", "ids", "v").mapInArrow(lean(to_list), "rep long, ids array<long>, v array<double>, list int"))
    held_by = {r["list"]: (r["n"], r["lone"]) for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("lone")).collect()}  # LISTS rows at most
    asks = rows.where(is_query)
    known = cut(asks.join(entries.select("v", "rep"), "v").select("rep", F.col("id").alias("query_id")))
    # Enough probes to find k others: lists are taken until they hold them.
    filled = np.array([held_by.get(i, (0, 0))[1] for i in range(len(index.centres))])

    def probe(batches):
        for batch in batches:
            ix = held.value
            q = ix.queries(_matrix(batch.column(1)))
            order = _nearest(q, ix.centres, len(ix.centres)) if len(q) else np.zeros((0, 1), np.int64)
            enough = np.maximum(ix.probes, (np.cumsum(filled[order], axis=1) <= ix.k).sum(1) + 1) if len(q) else []
            a = np.repeat(np.arange(len(q)), np.minimum(enough, len(ix.centres))) if len(q) else np.zeros(0, np.int64)
            lists = np.concatenate([o[:e] for o, e in zip(order, enough)]) if len(q) else np.zeros(0, np.int64)
            probed = np.zeros((len(q), len(ix.centres)), bool)
            probed[a, lists] = True
            parts = [ix.bounds(q[s : s + 256], probed[s : s + 256]) for s in range(0, len(q), 256)]
            within = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a)), batch.column(1).take(pa.array(a)), pa.array(lists.astype(np.int32)), pa.array(within[a])], names=["q", "qv", "list", "within"])

    distinct_asks = cut(known.select("rep").distinct().join(entries.select("rep", "v"), "rep").select(F.col("rep").alias("q"), F.col("v").alias("qv")))
    probes = cut(distinct_asks.mapInArrow(lean(probe), "q long, qv array<double>, list int, within double"))

    def listing(names: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        """The ids of the best entries of each query i: k + 1 entries, or as many as k + 1 different ids take."""
        order = np.lexsort((np.array([ids[x][0] for x in j.tolist()], np.int64), -score, i))
        i, j, score = i[order], j[order], score[order]
        if lone:
            top = np.arange(len(i)) - np.searchsorted(i, i, "left") <= k
            i, j, score = i[top], j[top], score[top]
        n = [len(ids[x]) for x in j.tolist()]
        every = np.array([y for x in j.tolist() for y in ids[x]], np.int64)
        i, score = np.repeat(i, n), np.repeat(score, n)
        if not lone and len(i):
            order = np.lexsort((-score, every, i))
            best = order[np.concatenate([[True], (i[order][1:] != i[order][:-1]) | (every[order][1:] != every[order][:-1])])]
            best = best[np.lexsort((every[best], -score[best], i[best]))]
            i, every, score = i[best], every[best], score[best]
            top = np.arange(len(i)) - np.searchsorted(i, i, "left") <= k
            i, every, score = i[top], every[top], score[top]
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(every), pa.array(score)], names=["q", "id", "score"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            ix = held.value
            qv, pv = _matrix(left.column("qv")), _matrix(right.column("v"))
            lifted, ids, names, within = ix.lifted(pv), right.column("ids").to_pylist(), left.column("q").to_numpy(), left.column("within").to_numpy()
            for s in range(0, len(qv), 256):
                i, j = scan(ix.queries(qv[s : s + 256]), lifted, within[s : s + 256])
                parts.append(listing(names, i + s, j, np.einsum("ij,ij->i", qv[i + s], pv[j]), ids))
        return pa.Table.from_batches(parts, schema=pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    def best(probes: DataFrame) -> DataFrame:
        """q, id, score: what the probed lists give each query, k + 1 at most."""
        asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
        blocks = np.array([max(1, -(-held_by.get(i, (0, 0))[0] // BLOCK)) for i in range(len(filled))])
        turns = np.array([max(1, -(-asked.get(i, 0) // ASKS)) for i in range(len(filled))])
        at = lambda x: F.element_at(F.array(*[F.lit(int(v)) for v in x]), F.col("list") + 1) if len(set(x.tolist())) > 1 else F.lit(int(x[0]))
        each = lambda x: F.explode(F.sequence(F.lit(0), at(x) - 1))
        left = probes.withColumn("turn", F.pmod(F.xxhash64("q"), at(turns)).cast("int")).withColumn("block", each(blocks))
        right = listed.withColumn("block", F.pmod(F.xxhash64("rep"), at(blocks)).cast("int")).withColumn("turn", each(turns))
        keys = ["list", "block", "turn"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
        first = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return cut(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"))

    top = best(probes)
    short = distinct_asks.join(top.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) <= k).select("q")
    again = cut(probes.where("within < double('infinity')").join(short, "q").withColumn("within", F.lit(float("inf"))))
    if again.limit(1).count():
        top = cut(top.join(again.select("q").distinct(), "q", "left_anti").unionByName(best(again)))
    return known.join(top, known["rep"] == top["q"]).where(F.col("query_id") != F.col("id")).select("query_id", F.col("id").alias("vec_id"), "score")

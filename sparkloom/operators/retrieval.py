"""Rankings as relations: vector, lexical and metadata scores, fusion, and the strategies made of them.

A ranking has (query_id, rank, item_id, score). Ties go by item_id, and scores are rounded before they are ordered, so
that engines and plans agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places to which scores are rounded before they are ordered, and the most queries and items of one block of a scan.
PLACES, QUERY_BLOCK, ITEM_BLOCK = 6, 512, 4096
#: Parts that a key's blocks of items are dealt to, and entries that a task holds of its queries' best before it sends them on.
DEAL, HELD = 8, 1 << 21


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column | str, least: float = 1e-12) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def rank_by(df: DataFrame, by: list[str], *order: Column, out: str = "rank", k: int | None = None) -> DataFrame:
    """Dense places from 1; with k, Spark cuts groups before it deals them out (WindowGroupLimit)."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(out) <= k)


def top_items(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Scores (query_id, item_id, score) as a ranking."""
    return rank_by(scores, ["query_id"], F.desc("score"), F.asc("item_id"), k=k).select("query_id", "rank", "item_id", "score")


def collapse(scores: DataFrame, item: Column) -> DataFrame:
    """The best score of each query and item, where several rows stand for one item."""
    return scores.withColumn("item_id", item).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def _blocks(rows: DataFrame, ident: str, vector: str, on: list[str], size: int, more: list[str] | None = None, kind: type = np.float64) -> DataFrame:
    """key, ids, matrix: rows of one key in blocks of at most `size`, each a row with its vectors as bytes, and an array of
    each column of `more`.

    The key holds the values of `on` (rows with a null there go), or is empty. Rows stay where they are, in their order if
    there is one key; those without a vector go.
    """
    rows, more = rows.where(F.col(vector).isNotNull()), more or []
    if on:
        rows = rows.dropna(subset=on)
    key = F.to_json(F.struct(*[F.col(c) for c in on])) if on else F.lit("")
    picked = rows.select(key.alias("key"), F.col(ident).cast("long").alias("ids"), F.col(vector).alias("matrix"), *more)
    names = ["key", "ids", "matrix", *more]

    def run(batches):
        held: dict[str, list] = {}  # parts of unfinished blocks; together no more than two batches
        count = 0

        def made(k, parts):
            ids, m = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            rest = [pa.concat_arrays([p[2][j] for p in parts]) for j in range(len(more))]
            for i in range(0, len(ids), size):
                part = ids[i : i + size]
                ends = pa.array([0, len(part)], pa.int32())
                cells = [pa.ListArray.from_arrays(ends, pa.concat_arrays([x.slice(i, size)])) for x in rest]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tolist()], pa.list_(pa.int64())), pa.array([m[i : i + size].tobytes()]), *cells], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            m = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
            code = batch.column(0).dictionary_encode()
            order = np.argsort(code.indices.to_numpy(), kind="stable")
            ends = np.cumsum(np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary)))
            for k, at in zip(code.dictionary.to_pylist(), np.split(order, ends[:-1])):
                held.setdefault(k, []).append((ids[at], m[at], [batch.column(3 + j).take(pa.array(at)) for j in range(len(more))]))
            count += batch.num_rows
            if count >= size:
                for k, parts in held.items():
                    yield from made(k, parts)
                held, count = {}, 0
        for k, parts in held.items():
            yield from made(k, parts)

    kinds = "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in picked.schema.fields[3:])
    return picked.mapInArrow(run, "key string, ids array<long>, matrix binary" + kinds)


def _first(i: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries (query, item, score) of each query i, best first; ties to the smaller item."""
    by = np.lexsort((item, -score, i))
    i, item, score = i[by], item[by], score[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], item[keep], score[keep]


def _heads(s: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_first` of a matrix of queries and items, of its finite scores."""
    s = np.where(np.isfinite(s), s, -np.inf)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
    i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    return _first(i, item[j], s[i, j], k)


class _Best:
    """The k best entries so far of each query of the blocks that a task meets, so that a task sends k on, not each block.

    What is held is bounded: past HELD entries all are sent on, and the ranking that follows sees to the rest.
    """

    def __init__(self, k: int):
        self.k, self.held, self.count = k, {}, 0

    def add(self, q_ids: np.ndarray, s: np.ndarray, items: np.ndarray, tag: int = 0) -> None:
        self.merge(q_ids, _heads(s, items, self.k), tag)

    def merge(self, q_ids: np.ndarray, new: tuple[np.ndarray, np.ndarray, np.ndarray], tag: int = 0) -> None:
        """Takes in entries as `_heads` gives them."""
        key = (q_ids.tobytes(), tag)
        old = self.held.get(key)
        if old is not None:
            self.count -= len(old[1][0])
            new = _first(*(np.concatenate(x) for x in zip(old[1], new)), self.k)
        self.held[key] = (q_ids, new)
        self.count += len(new[0])

    def full(self) -> bool:
        return self.count > HELD

    def rows(self, tagged: bool = False):
        for (_, tag), (q_ids, (i, items, score)) in self.held.items():
            cells, names = [pa.array(q_ids[i]), pa.array(items), pa.array(score)], ["query_id", "item_id", "score"]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(np.full(len(i), tag, np.int32))] if tagged else cells, names=[*names, "tag"] if tagged else names)
        self.held, self.count = {}, 0


def exact_scores(vectors: DataFrame, queries: DataFrame, k: int | None, item: str = "item_id", vector: str = "vector", exclude_self: bool = True, places: int = PLACES, on: list[str] | None = None) -> DataFrame:
    """query_id, item_id, score: inner products of a stated query set (query_id, vector) and all vectors, or with `on` those
    that are equal in these columns (a null equals nothing).

    Both sides are packed where they lie into blocks of at most QUERY_BLOCK and ITEM_BLOCK rows, and each two blocks (of one
    key) are a product of matrices; a task sends on only its k best of a query and key. So what is dealt out grows with
    queries and blocks, not with pairs, a hot key is many rows in DEAL parts, and no vector passes the driver. Without k all
    pairs come.
    """

    def run(batches):
        best = _Best(k or 0)
        for batch in batches:
            for q_ids, q_matrix, own_ids, matrix in zip(*batch.columns):
                ids, items = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, own_ids))
                q, v = (np.frombuffer(x.as_buffer()).reshape(len(n), -1) for x, n in ((q_matrix, ids), (matrix, items)))
                s = np.round(q @ v.T, places)
                if exclude_self:
                    s[ids[:, None] == items] = -np.inf
                if k is None:
                    i, j = np.nonzero(np.isfinite(s))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(items[j]), pa.array(s[i, j])], names=["query_id", "item_id", "score"])
                    continue
                best.add(ids, s, items)
                if best.full():
                    yield from best.rows()
        yield from best.rows()

    on = on or []
    own = _blocks(vectors, item, vector, on, ITEM_BLOCK)
    asked = _blocks(queries, "query_id", "vector", on, QUERY_BLOCK).select("key", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    if on:
        deal = F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))
        met = own.withColumn("_part", F.pmod(F.xxhash64("ids"), F.lit(DEAL)).cast("int")).join(asked.withColumn("_part", deal), ["key", "_part"])
    else:
        met = own.drop("key").crossJoin(asked.drop("key"))  # a stated query set and all rows, in blocks
    return met.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(run, "query_id long, item_id long, score double")


def masked_search(vectors: DataFrame, queries: DataFrame, k: int, draws: str, share: str, places: int = PLACES) -> DataFrame:
    """query_id, draw, rank, item_id, score: each query's k best items in each draw, of those whose number for the draw (an
    array `draws` of an item's, as many for each) is below the query's `share`. Pairs stay within their blocks."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for ids, matrix, drawn, q_ids, q_matrix, q_share in zip(*batch.columns):
                qi, vi, s = _products(ids, matrix, q_ids, q_matrix, places)
                u = drawn.values.flatten().to_numpy(zero_copy_only=False).reshape(len(vi), -1)
                least = q_share.values.to_numpy(zero_copy_only=False)
                for d in range(u.shape[1]):
                    best.add(qi, np.where(u[:, d] < least[:, None], s, -np.inf), vi, d)
                if best.full():
                    yield from best.rows(True)
        yield from best.rows(True)

    asked = _blocks(queries, "query_id", "vector", [], QUERY_BLOCK, [share])
    met = _met(_blocks(vectors, "item_id", "vector", [], ITEM_BLOCK, [draws]), asked).select("ids", "matrix", draws, "q_ids", "q_matrix", f"q_{share}")
    found = met.mapInArrow(run, "query_id long, item_id long, score double, draw int")
    return rank_by(found, ["query_id", "draw"], F.desc("score"), F.asc("item_id"), k=k).select("query_id", "draw", "rank", "item_id", "score")


def _met(own: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block of items beside each block of a stated query set, whose columns begin with q_."""
    return own.drop("key").crossJoin(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns if c != "key"]))


def _products(ids, matrix, q_ids, q_matrix, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, item ids and the rounded products of two blocks, those of an item with itself at -inf."""
    qi, vi = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, ids))
    q, v = (np.frombuffer(x.as_buffer()).reshape(len(n), -1) for x, n in ((q_matrix, qi), (matrix, vi)))
    s = np.round(q @ v.T, places)
    s[qi[:, None] == vi] = -np.inf
    return qi, vi, s


def group_search(vectors: DataFrame, queries: DataFrame, k: int, group: str, item: str = "item_id", vector: str = "vector", places: int = PLACES) -> DataFrame:
    """query_id, rank, group_id, item_id, score: each query's k best groups (an integer column), each by its best item; ties
    go by the smaller item, then by the smaller group.

    A block sends on its own k best groups only: a group that is among the k best of all is among those of the block that
    holds its best item, as k others would else be better there. A query isn't its own item; a null group is none.
    """

    def run(batches):
        for batch in batches:
            for ids, matrix, groups, q_ids, q_matrix in zip(*batch.columns):
                qi, vi, s = _products(ids, matrix, q_ids, q_matrix, places)
                g = groups.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((vi, g))
                g, vi, s = g[order], vi[order], s[:, order]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                best = np.maximum.reduceat(s, starts, axis=1)
                at = np.where(s == np.repeat(best, np.diff(np.append(starts, len(g))), axis=1), np.arange(len(g)), len(g))
                first = np.minimum.reduceat(at, starts, axis=1)
                top = np.lexsort((np.broadcast_to(g[starts], best.shape), -best), axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(qi)), top.shape[1]), top.ravel()
                keep = np.isfinite(best[i, j])
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(g[starts][j]), pa.array(vi[first[i, j]]), pa.array(best[i, j])], names=["query_id", "group_id", "item_id", "score"])

    rows = vectors.select(item, vector, F.col(group).cast("long").alias("_group")).where("_group IS NOT NULL")
    met = _met(_blocks(rows, item, vector, [], ITEM_BLOCK, ["_group"]), _blocks(queries, "query_id", "vector", [], QUERY_BLOCK))
    found = met.select("ids", "matrix", "_group", "q_ids", "q_matrix").mapInArrow(run, "query_id long, group_id long, item_id long, score double")
    best = found.groupBy("query_id", "group_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("neg"))).alias("_b"))
    rows = best.select("query_id", "group_id", (-F.col("_b.neg")).alias("item_id"), F.col("_b.score").alias("score"))
    return rank_by(rows, ["query_id"], F.desc("score"), F.asc("group_id"), k=k).select("query_id", "rank", "group_id", "item_id", "score")


def group_means(vectors: DataFrame, queries: DataFrame, k: int, group: str, item: str = "item_id", vector: str = "vector", places: int = PLACES) -> DataFrame:
    """query_id, rank, group_id, score: each query's k best groups (an integer column) by the mean, to 8 places, of their items'
    rounded scores; ties go by the smaller group. A query isn't its own item; a null group is none.

    Rows are sorted by group over range partitions, so a block holds whole groups but for its first and last. It sends on its
    k best whole ones, and sums and counts of those two for each query, which are added up; no group has to fit a task.
    """

    def run(batches):
        for batch in batches:
            for ids, matrix, groups, q_ids, q_matrix in zip(*batch.columns):
                qi, vi, s = _products(ids, matrix, q_ids, q_matrix, places)
                g = groups.values.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                there = np.isfinite(s)
                n = np.add.reduceat(there.astype(np.int64), starts, axis=1)
                sums = np.add.reduceat(np.where(there, s, 0.0), starts, axis=1)
                own = g[starts]
                with np.errstate(invalid="ignore", divide="ignore"):
                    means = np.where(n > 0, np.round(sums / n, 8), -np.inf)
                ends = sorted({0, len(starts) - 1})
                whole = means.copy()
                whole[:, ends] = -np.inf
                i, found, _ = _heads(whole, np.arange(len(own)), k)
                pi, pj = (x.ravel() for x in np.meshgrid(np.arange(len(qi)), ends, indexing="ij"))
                i, j = np.concatenate([i, pi]), np.concatenate([found, pj])
                keep = n[i, j] > 0
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(own[j]), pa.array(sums[i, j]), pa.array(n[i, j])], names=["query_id", "group_id", "s", "n"])

    rows = vectors.select(item, vector, F.col(group).cast("long").alias("_group")).where("_group IS NOT NULL")
    rows = rows.repartitionByRange("_group", item).sortWithinPartitions("_group", item)
    met = _met(_blocks(rows, item, vector, [], ITEM_BLOCK, ["_group"]), _blocks(queries, "query_id", "vector", [], QUERY_BLOCK))
    found = met.select("ids", "matrix", "_group", "q_ids", "q_matrix").mapInArrow(run, "query_id long, group_id long, s double, n long")
    means = found.groupBy("query_id", "group_id").agg(F.round(F.sum("s") / F.sum("n"), 8).alias("score"))
    return rank_by(means, ["query_id"], F.desc("score"), F.asc("group_id"), k=k).select("query_id", "rank", "group_id", "score")


def global_depth(vectors: DataFrame, queries: DataFrame, targets: DataFrame, item: str = "item_id", vector: str = "vector", places: int = PLACES) -> DataFrame:
    """query_id, item_id, score, above, before of targets (query_id, item_id, score): how many items of all score more for the
    query, and how many come before the target in its full ranking (ties by the smaller item).

    The full ranking is never made: each block of items counts against the few targets of each query (a bounded number, as
    of a ranking's head; they ride in the query's block), and counts are summed. A query isn't its own item.
    """

    def run(batches):
        for batch in batches:
            for ids, matrix, q_ids, q_matrix, q_targets in zip(*batch.columns):
                qi, vi, s = _products(ids, matrix, q_ids, q_matrix, places)
                lists = q_targets.values
                cut = lists.offsets.to_numpy()
                flat = lists.values
                t_score, t_item = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("score", "item_id"))
                of = np.repeat(np.arange(len(qi)), np.diff(cut))
                t_score, t_item = t_score[cut[0] : cut[-1]], t_item[cut[0] : cut[-1]]
                above, before = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                for q in range(len(qi)):
                    own = slice(cut[q] - cut[0], cut[q + 1] - cut[0])
                    above[own] = (s[q] > t_score[own, None]).sum(1)
                    before[own] = above[own] + ((s[q] == t_score[own, None]) & (vi < t_item[own, None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(qi[of]), pa.array(t_item), pa.array(t_score), pa.array(above), pa.array(before)], names=["query_id", "item_id", "score", "above", "before"])

    few = targets.groupBy("query_id").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), F.col("item_id").cast("long").alias("item_id"))).alias("targets"))
    asked = _blocks(queries.select("query_id", "vector").join(few, "query_id"), "query_id", "vector", [], QUERY_BLOCK, ["targets"])
    met = _met(_blocks(vectors, item, vector, [], ITEM_BLOCK), asked).select("ids", "matrix", "q_ids", "q_matrix", "q_targets")
    counted = met.mapInArrow(run, "query_id long, item_id long, score double, above long, before long")
    return counted.groupBy("query_id", "item_id", "score").agg(F.sum("above").alias("above"), F.sum("before").alias("before"))


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, **kw) -> DataFrame:
    return top_items(exact_scores(vectors, queries, k, **kw), k)


def prefilter_search(vectors: DataFrame, queries: DataFrame, k: int | None, on: list[str], places: int = PLACES) -> DataFrame:
    """Queries rank only the items that share their filter columns."""
    return top_items(exact_scores(vectors, queries, k, places=places, on=on), k)


def postfilter_search(vectors: DataFrame, queries: DataFrame, depth: int, k: int, on: list[str]) -> DataFrame:
    """The `depth` best of all items first, of which those that pass the filter stay: it may leave fewer than k."""
    top = exact_search(vectors, queries, depth).drop("rank")
    return top_items(kept(top, vectors, queries, on), k)


def kept(scores: DataFrame, items: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    wide = scores.join(queries.select("query_id", *[F.col(c).alias(f"_q{c}") for c in on]), "query_id").join(items.select("item_id", *on), "item_id")
    for c in on:
        wide = wide.where(F.col(c) == F.col(f"_q{c}"))
    return wide.select("query_id", "item_id", "score")


def rrf(rankings: list[tuple[DataFrame, float]], k: int = 60, cut: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sums of weight / (k + rank) over the rankings that hold an item."""
    out = None
    for ranking, weight in rankings:
        part = ranking.select("query_id", "item_id", (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return top_items(out.groupBy("query_id", "item_id").agg(F.round(F.sum("s"), 9).alias("score")), cut)


def weighted_rrf(text: DataFrame, visual: DataFrame, text_weight: float, visual_weight: float, k: int = 60, cut: int | None = None) -> DataFrame:
    """Fusion with provenance: both ranks and scores stay; ties go by text rank, then visual rank (a missing one counts as
    10^9), then item."""
    side = lambda df, n: df.select("query_id", "item_id", F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score"))
    both = side(text, "text").join(side(visual, "visual"), ["query_id", "item_id"], "full")
    part = lambda n, w: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(f"{n}_rank")), F.lit(0.0))
    both = both.withColumn("score", F.round(part("text", text_weight) + part("visual", visual_weight), 9))
    far = lambda n: F.coalesce(f"{n}_rank", F.lit(10**9))
    return rank_by(both, ["query_id"], F.desc("score"), far("text"), far("visual"), F.asc("item_id"), k=cut)


def rerank(base: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The `depth` first of a ranking in the order of an outside score; those without one come last."""
    wide = base.where(F.col("rank") <= depth).join(scores.select("query_id", "item_id", F.col("score").alias("other")), ["query_id", "item_id"], "left")
    ranked = rank_by(wide.withColumnRenamed("rank", "base_rank"), ["query_id"], F.desc_nulls_last("other"), F.asc("item_id"))
    return ranked.select("query_id", "rank", "item_id", F.col("other").alias("score"), "base_rank")


def metadata_ranking(queries: DataFrame, items: DataFrame, on: list[str], k: int) -> DataFrame:
    """Items that pass the filter, in the order of id, score 1. Only the first k + 1 of each value can be needed (a query isn't
    its own item), so no more of them meet the queries."""
    first = rank_by(items.select("item_id", *on).dropna(subset=on), on, F.asc("item_id"), out="_place", k=k + 1).drop("_place")
    met = first.join(queries.select("query_id", *on), on).where("query_id <> item_id")
    return top_items(met.select("query_id", "item_id", F.lit(1.0).alias("score")), k)


def strategies(parts: dict[str, DataFrame]) -> DataFrame:
    """Rankings under the name of their strategy, as one relation."""
    out = None
    for name, ranking in parts.items():
        part = ranking.select(F.lit(name).alias("strategy"), "query_id", "rank", "item_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def knn_graph(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Edges src, dst of each query's k nearest others."""
    return exact_search(vectors, queries, k).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), "rank")

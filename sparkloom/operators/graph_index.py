"""Graph search over vectors: a neighbour graph of each shard of the items, and a beam search of blocks of queries in every shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .retrieval import PLACES, _Best, _blocks, _first, _heads, _met, rank_by, top_items

#: Items of one shard at most, give or take the hash: its vectors and edges are about 6 MB at 64 dimensions.
SHARD = 1 << 13
#: Rows of a shard's products that a task holds at once, queries of one block, and items of each query that a hop follows.
STEP, ASKED, FOLLOWED = 512, 1024, 64


def _groups(batches, by: int = 0) -> Iterator[pa.Table]:
    """Rows of one key after another, from batches sorted by that column; a key's rows are a shard at most."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(by).to_numpy()
        ends = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for x, y in zip([0, *ends], [*ends, len(keys)]):
            if held and keys[x] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[x]
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _meet(k: int):
    """For mapInArrow over (key, node, vector) sorted by key: each node's k best others of its key, as edges."""

    def run(batches):
        src, dst, score = [], [], []
        for g in _groups(batches):
            ids = g.column(1).to_numpy()
            ids, at = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            v = g.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(g.num_rows, -1)[at]  # numbers stay in their buffers
            for x in range(0, len(ids), STEP):
                s = np.round(v[x : x + STEP] @ v.T, PLACES)
                s[np.arange(len(s)), np.arange(x, x + len(s))] = -np.inf
                i, other, best = _heads(s, ids, k)
                src.append(ids[x + i])
                dst.append(other)
                score.append(best)
            if len(src) >= 256:
                yield _edges(src, dst, score)
                src, dst, score = [], [], []
        if src:
            yield _edges(src, dst, score)

    return run


def _edges(src, dst, score):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(score))], names=["src", "dst", "score"])


_EDGE = "src long, dst long, score double"


def _sharded(items: DataFrame) -> tuple[DataFrame, int]:
    """key, node, vector of items (item_id, vector), dealt to shards by a hash of their id, and the number of shards."""
    vectors = items.where("item_id IS NOT NULL AND vector IS NOT NULL").select(F.col("item_id").cast("long").alias("node"), "vector")
    shards = max(1, -(-vectors.count() // SHARD))
    return vectors.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("key"), "node", "vector"), shards


def neighbour_graph(items: DataFrame, k: int = 16) -> DataFrame:
    """src, dst, score, rank: the k nearest others of each item (item_id, vector) in its shard.

    Items are dealt to shards of about SHARD by a hash; in each, all meet in products of STEP rows. So a graph's cost for an item
    doesn't grow with the data, each vector is dealt out once, and `graph_search` asks every shard.
    """
    vectors, shards = _sharded(items)
    edges = vectors.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(_meet(k), _EDGE)
    return stored(rank_by(edges, ["src"], F.desc("score"), F.asc("dst"), k=k), "graph")


def _packed(entries: int):
    """For mapInArrow over (key, node, vector, near, hash) sorted by key: a shard's ids, its matrix, each item's neighbours as places
    in the shard, filled up with -1, and the places of its first `entries` items by hash."""

    def run(batches):
        for g in _groups(batches):
            ids, at = np.unique(g.column(1).to_numpy(), return_index=True)
            g = g.take(pa.array(at))
            v, near = g.column(2).combine_chunks(), g.column(3).combine_chunks()
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            many, flat = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), near.flatten().to_numpy(zero_copy_only=False)
            table = np.full((len(ids), max(1, int(many.max(initial=0)))), -1, np.int32)
            place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            rows = np.repeat(np.arange(len(ids)), many)
            columns = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            table[rows, columns] = np.where(ids[place] == flat, place, -1)  # an edge out of the shard is none
            gates = np.argsort(g.column(4).to_numpy(), kind="stable")[:entries]
            yield pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([m.tobytes()]), pa.array([table.tobytes()]), pa.array([gates.tolist()], pa.list_(pa.int64()))], names=["ids", "matrix", "near", "gates"])

    return run


def _walk(v: np.ndarray, near: np.ndarray, gates: np.ndarray, q: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (-1: none) and scores of the `beam` best items that each query's search over a shard's graph holds at its end.

    own: the query's own place, or -1. Each hop follows the FOLLOWED best items of a query's beam that weren't followed yet.
    """
    seen = np.zeros((len(q), len(v) + 1), bool)  # the last column stands for no item
    seen[:, -1] = seen[np.arange(len(q)), own] = True
    at = np.broadcast_to(gates, (len(q), len(gates))).copy()
    score = np.where(seen[np.arange(len(q))[:, None], at], -np.inf, q @ v[gates].T)
    seen[:, gates] = True
    done = np.isneginf(score)

    def cut(at, score, done):
        if score.shape[1] <= beam:
            return at, score, done
        best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(x, best, 1) for x in (at, score, done))

    at, score, done = cut(at, score, done)
    out_at, out_score = np.full((len(q), beam), -1), np.full((len(q), beam), -np.inf)
    live = np.arange(len(q))  # queries that hold an item not yet followed
    while True:
        ended = done.all(1)
        if ended.any():
            out_at[live[ended], : at.shape[1]], out_score[live[ended], : at.shape[1]] = at[ended], score[ended]
            live, at, score, done = live[~ended], at[~ended], score[~ended], done[~ended]
        if not len(live):
            return np.where(np.isneginf(out_score), -1, out_at), out_score
        ahead = np.argsort(np.where(done, np.inf, -score), axis=1, kind="stable")[:, :FOLLOWED]
        open_ = ~np.take_along_axis(done, ahead, 1)
        np.put_along_axis(done, ahead, True, axis=1)
        new = np.where(open_[:, :, None], near[np.take_along_axis(at, ahead, 1)], -1).reshape(len(live), -1)
        new.sort(axis=1)
        fresh = ~seen[live[:, None], new]  # -1 is the last column
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        i, j = np.nonzero(fresh)
        seen[live[i], new[i, j]] = True
        s = np.full(new.shape, -np.inf)
        s[i, j] = np.einsum("ij,ij->i", v[new[i, j]], q[live[i]])
        at, score, done = cut(np.concatenate([at, new], 1), np.concatenate([score, s], 1), np.concatenate([done, ~fresh], 1))


def graph_search(items: DataFrame, queries: DataFrame, graph: DataFrame, k: int, beam: int = 64, entries: int = 256, seed: int = 5) -> DataFrame:
    """The k best items of each query (query_id, vector) that a beam search over the graph finds, without the query's own.

    The graph is that of `neighbour_graph` of the same items, so its edges lie within shards. A shard's vectors and edges, in both
    directions, are one row, and so is a block of queries; where two such rows meet, a task searches the shard's graph for all of
    the block. A search begins at the best of `entries` items first by hash and holds the `beam` best items met so far; it ends
    when no query holds an item that isn't followed. A task sends on its k best of a query, of all shards that it meets.
    """
    vectors, shards = _sharded(items)
    back = rank_by(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), ["src"], F.desc("score"), F.asc("dst"), k=32).select("src", "dst")
    near = graph.select("src", "dst").unionByName(back).distinct().groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("near"))  # k and 32 at most
    rows = vectors.join(near, "node", "left").select("key", "node", "vector", "near", F.xxhash64("node", F.lit(seed)).alias("hash"))
    packed = rows.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(_packed(entries), "ids array<long>, matrix binary, near binary, gates array<long>")
    asked = _blocks(queries, "query_id", "vector", [], ASKED)

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for ids, matrix, near, gates, q_ids, q_matrix in zip(*batch.columns):
                vi, gate, qi = (x.values.to_numpy(zero_copy_only=False) for x in (ids, gates, q_ids))
                v, q = (np.frombuffer(x.as_buffer()).reshape(len(n), -1) for x, n in ((matrix, vi), (q_matrix, qi)))
                place = np.minimum(np.searchsorted(vi, qi), len(vi) - 1)
                at, score = _walk(v, np.frombuffer(near.as_buffer(), np.int32).reshape(len(vi), -1), gate, q, np.where(vi[place] == qi, place, -1), max(beam, k))
                i, j = np.nonzero(at >= 0)
                found = _first(i, vi[at[i, j]], np.round(score[i, j], PLACES), k)
                best.merge(qi, found)
                if best.full():
                    yield from best.rows()
        yield from best.rows()

    met = _met(stored(packed.withColumn("key", F.lit("")), "shards"), stored(asked, "asked"))
    found = met.select("ids", "matrix", "near", "gates", "q_ids", "q_matrix").mapInArrow(run, "query_id long, item_id long, score double")
    return top_items(found, k)


def recalls(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact ranking's items that a query found."""
    hits = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))

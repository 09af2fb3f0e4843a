"""Inverted lists of product codes: codebooks trained for each part of a vector, packed codes, tables of products, a re-rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .retrieval import ITEM_BLOCK, PLACES, QUERY_BLOCK, _Best, _blocks, _met, dot, rank_by, top_items

#: Vectors, first by hash, on which codebooks and lists are fitted.
SAMPLE = 16_384
#: Codes of 6 bits that one long holds.
IN_LONG = 10
#: Rows whose distances to all centres are held at once.
STEP = 2048


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means; a centre that loses all its points stands where it was."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].astype(np.float64)
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[a : a + STEP] @ c.T).argmin(1) for a in range(0, len(x), STEP)])
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], minlength=len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def codebooks(items: DataFrame, parts: int, bits: int = 6, rounds: int = 12, seed: int = 3) -> DataFrame:
    """part, code, centre: k-means of each part of the sample's vectors, each part in a task of its own."""
    width = F.floor(F.size("vector") / parts).cast("int")
    sample = items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(SAMPLE)
    slices = sample.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda b: F.slice("vector", b * width + 1, width))).alias("part", "v"))

    def fit(key, t):
        t = t.sort_by("item_id")
        c = _lloyd(np.array(t.column("v").to_pylist(), np.float64), 1 << bits, rounds, seed)
        return pa.table({"part": pa.array([key[0].as_py()] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()), "centre": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return slices.groupBy("part").applyInArrow(fit, "part int, code int, centre array<double>")


def coarse_lists(items: DataFrame, lists: int, rounds: int = 10, seed: int = 3) -> DataFrame:
    """list, centre: k-means of the sample's vectors, of bounded size."""
    sample = items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(SAMPLE).select(F.lit(0).alias("one"), "item_id", "vector")

    def fit(key, t):
        c = _lloyd(np.array(t.sort_by("item_id").column("vector").to_pylist(), np.float64), lists, rounds, seed)
        return pa.table({"list": pa.array(range(len(c)), pa.int32()), "centre": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return sample.groupBy("one").applyInArrow(fit, "list int, centre array<double>")


def _books(books: DataFrame) -> np.ndarray:
    """parts x codes x width; their number is fixed by parts and bits. A part with fewer codes repeats its last."""
    rows = sorted((r["part"], r["code"], r["centre"]) for r in books.collect())
    by = [[c for p, _, c in rows if p == part] for part in range(rows[-1][0] + 1)] if rows else []
    most = max(map(len, by), default=0)
    return np.array([b + [b[-1]] * (most - len(b)) for b in by])


def pack(codes: np.ndarray) -> np.ndarray:
    """Codes of 6 bits (rows x parts), IN_LONG to a long."""
    rows, parts = codes.shape
    out = np.zeros((rows, -(-parts // IN_LONG)), np.int64)
    for b in range(parts):
        out[:, b // IN_LONG] |= codes[:, b].astype(np.int64) << (6 * (b % IN_LONG))
    return out


def code_at(packed: Column, part: Column) -> Column:
    """The code of a part (from 0) of packed codes, in the plan."""
    word = F.get(packed, F.floor(part / IN_LONG).cast("int"))
    return F.call_function("shiftright", word, (F.pmod(part, F.lit(IN_LONG)) * 6).cast("int")).bitwiseAND(F.lit(63)).cast("int")


def unpack(packed: np.ndarray, parts: int) -> np.ndarray:
    """parts x rows: the codes of packed rows."""
    return np.stack([(packed[:, b // IN_LONG] >> (6 * (b % IN_LONG))) & 63 for b in range(parts)])


def encode(items: DataFrame, books: np.ndarray, lists: np.ndarray) -> DataFrame:
    """item_id, list, codes of every item: the list of its nearest centre, each part's nearest code, packed."""
    held = items.sparkSession.sparkContext.broadcast((books, lists))  # fixed by parts, bits and lists

    def run(batches):
        books, lists = held.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            near = ((lists * lists).sum(1) - 2 * v @ lists.T).argmin(1)
            codes = np.stack([((c * c).sum(1) - 2 * v[:, p * c.shape[1] : (p + 1) * c.shape[1]] @ c.T).argmin(1) for p, c in enumerate(books)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(pack(codes).tolist(), pa.list_(pa.int64()))], names=["item_id", "list", "codes"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "vector").mapInArrow(run, "item_id long, list int, codes array<long>")


def enough_probes(items: DataFrame, lists: np.ndarray, k: int = 10, share: float = 0.95, rows: int = 2048, seed: int = 3) -> int:
    """The fewest probed lists that hold that share of the k nearest of each of a few sampled items among the sample."""
    v = np.array([r["vector"] for r in items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(rows).select("vector").collect()], np.float64)
    away = (lists * lists).sum(1) - 2 * v @ lists.T
    place = np.argsort(np.argsort(away, 1, kind="stable"), 1, kind="stable")  # of each list for each row
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, 1)[:, : min(k, len(v) - 1)]
    held = np.sort(np.take_along_axis(place, away.argmin(1)[near], 1).ravel())
    return int(held[min(len(held) - 1, int(np.ceil(share * len(held))) - 1)]) + 1 if len(held) else 1


def build(items: DataFrame, parts: int = 32, bits: int = 6, lists: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The stored index of all items, and its codebooks and centres; lists: about the root of the items, 4,096 at most."""
    n = items.count()
    lists = lists or int(min(4096, max(1, round(n**0.5))))
    books = _books(codebooks(items, parts, bits))
    centres = np.array([r["centre"] for r in coarse_lists(items, lists).orderBy("list").collect()])  # lists x dimensions
    return stored(encode(items, books, centres), "codes"), books, centres


def search(items: DataFrame, queries: DataFrame, index: tuple[DataFrame, np.ndarray, np.ndarray], k: int, probes: int, rerank: int = 100) -> DataFrame:
    """The k best items of each query by true products among the `rerank` best by codes in the probed lists.

    Codes are sorted by list over range partitions and packed into blocks of ITEM_BLOCK items at most, queries into blocks of
    vectors. Where two blocks meet, the task makes the queries' tables of products, which are never rows, sums looked-up
    products for the lists that a query probes, and sends on its `rerank` best of a query.
    """
    codes, books, centres = index
    held = items.sparkSession.sparkContext.broadcast((books, centres))  # fixed by parts, bits and lists

    def run(batches):
        books, lists = held.value
        width, best = books.shape[2], _Best(rerank)
        for batch in batches:
            for ids, packed, of, q_ids, q_matrix in zip(*batch.columns):
                vi, own, qi = (x.values.to_numpy(zero_copy_only=False) for x in (ids, of, q_ids))
                q = np.frombuffer(q_matrix.as_buffer()).reshape(len(qi), -1)
                near = np.argsort((lists * lists).sum(1) - 2 * q @ lists.T, axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(qi), len(lists)), bool)
                np.put_along_axis(probed, near, True, axis=1)
                tables = np.stack([q[:, p * width : (p + 1) * width] @ c.T for p, c in enumerate(books)])
                each = unpack(np.frombuffer(packed.as_buffer(), np.int64).reshape(len(vi), -1), len(books))
                s = np.full((len(qi), len(vi)), -np.inf)
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
                for x, y in zip(starts, [*starts[1:], len(own)]):
                    rows = np.flatnonzero(probed[:, own[x]])
                    if len(rows):
                        s[rows, x:y] = np.round(sum(t[rows][:, each[p, x:y]] for p, t in enumerate(tables)), PLACES)
                s[qi[:, None] == vi] = -np.inf
                best.add(qi, s, vi)
                if best.full():
                    yield from best.rows()
        yield from best.rows()

    rows = codes.select("item_id", F.col("list").cast("long").alias("list"), "codes").repartitionByRange("list", "item_id").sortWithinPartitions("list", "item_id")
    met = _met(_blocks(rows, "item_id", "codes", [], ITEM_BLOCK, ["list"], np.int64), _blocks(queries, "query_id", "vector", [], QUERY_BLOCK))
    found = met.select("ids", "matrix", "list", "q_ids", "q_matrix").mapInArrow(run, "query_id long, item_id long, score double")
    best = rank_by(found, ["query_id"], F.desc("score"), F.asc("item_id"), k=rerank).select("query_id", "item_id")
    true = best.join(items.select("item_id", "vector"), "item_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    return top_items(true.select("query_id", "item_id", F.round(dot("vector", "_q"), PLACES).alias("score")), k)

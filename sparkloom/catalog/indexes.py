"""Indexes over the table embeddings: a neighbour graph, trained product codes, partial indexes beside a global one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..operators import graph_index as G
from ..operators import partial_index as X
from ..operators import product_codes as P
from ..operators import retrieval as R
from ..sources.shared import stored
from .vector import K, PAIRS, asked, items

#: Lists and probes of the global and of each partial index, and rounds of their training.
GLOBAL_LISTS, GLOBAL_PROBES, PARTIAL_LISTS, PARTIAL_PROBES, ROUNDS = 12, 4, 3, 2, 2


def _found(t, ranking):
    """The ranking with `exact`: whether the exact one of the same depth holds the item."""
    exact = R.exact_search(items(t), asked(t), K).select("query_id", "item_id", F.lit(True).alias("exact"))
    return ranking.join(exact, ["query_id", "item_id"], "left").select("query_id", "rank", "item_id", "score", F.coalesce("exact", F.lit(False)).alias("exact"))


@query("VEC8")
def graph_search(t):
    """Beam search over a neighbour graph; no SQL, as the graph is approximate: tests hold its recall against brute force."""
    every = items(t)
    return _found(t, G.graph_search(every, asked(t), G.neighbour_graph(every), K))


@query("VEC10")
def trained_codes(t):
    """32 parts of 64 trained codes in trained lists, the 100 best by codes ranked anew; no SQL, as fits are in floating point."""
    every = items(t)
    index = P.build(every)
    return _found(t, P.search(every, asked(t), index, K, P.enough_probes(every, index[2])))


def _lists_sql(name: str, by: str, lists: int, rounds: int) -> str:
    """CTE <name>_near: vec_id, key, list, k, over the lists of each key."""
    out = f"{name}_e AS (SELECT vec_id, {by} AS key, embedding::DOUBLE[] AS ev FROM embeddings), {name}0 AS (SELECT key, r - 1 AS list, ev AS pv FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sha256('17:' || vec_id)) AS r FROM {name}_e) WHERE r <= {lists})"
    near = lambda k: f"SELECT e.vec_id, e.key, e.ev, s.list, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(e.ev, s.pv), 6) DESC, s.list) AS k FROM {name}_e e JOIN {name}{k} s USING (key)"
    for k in range(rounds):
        out += f", {name}{k + 1} AS (SELECT key, list, list(m ORDER BY i) AS pv FROM (SELECT key, list, i, avg(ev[i]) AS m FROM (SELECT * FROM ({near(k)}) WHERE k = 1), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY key, list)"
    return out + f", {name}_near AS ({near(rounds)})"


_PARTIAL_SQL = f"""WITH {_lists_sql('g', '0', GLOBAL_LISTS, ROUNDS)}, {_lists_sql('p', 'label', PARTIAL_LISTS, ROUNDS)}, {PAIRS},
f AS (SELECT 'global' AS strategy, x.* FROM pairs x JOIN g_near i ON i.vec_id = x.item_id AND i.k = 1 JOIN g_near a ON a.vec_id = x.query_id AND a.k <= {GLOBAL_PROBES} AND a.list = i.list WHERE x.label = x.qlabel
  UNION ALL SELECT 'partial', x.* FROM pairs x JOIN p_near i ON i.vec_id = x.item_id AND i.k = 1 JOIN p_near a ON a.vec_id = x.query_id AND a.k <= {PARTIAL_PROBES} AND a.list = i.list WHERE x.label = x.qlabel)
SELECT strategy, label, query_id, rank::INT AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 10"""


def _indexes(t):
    """(strategy, label, ranking, files read) of each predicate, a fixed few, for both indexes."""
    every, q = items(t).withColumn("whole", F.lit(0)), asked(t).withColumn("whole", F.lit(0))
    labels = sorted(r["label"] for r in every.select("label").where("label is not null").distinct().collect())
    for strategy, by, lists, probes in (("global", "whole", GLOBAL_LISTS, GLOBAL_PROBES), ("partial", "label", PARTIAL_LISTS, PARTIAL_PROBES)):
        centres = X.lists_by(every, by, lists, ROUNDS)
        index = X.write_index(every, centres, by, ["list"] if by == "whole" else ["label", "list"])
        probed = stored(X.nearest(q, centres, by, "query_id", probes).select("query_id", "list"), "probed")  # for all labels at once
        for label in labels:
            yield strategy, label, *X.pruned_search(index, q, probed, "label", label, K, by == "label")


@query("VEC25 PLN2", _PARTIAL_SQL)
def partial_and_global(t):
    """Rankings of stored indexes: one for each label, whose folders alone are read, and one of all with a filter."""
    out = None
    for strategy, label, ranking, _ in _indexes(t):
        part = ranking.select(F.lit(strategy).alias("strategy"), F.lit(label).alias("label"), "query_id", "rank", "item_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query("VEC25 VEC26")
def index_costs(t):
    """Files and bytes that each label's queries read from either index, and their recall; no SQL, as bytes are Parquet's."""
    exact = R.prefilter_search(items(t), asked(t), K, ["label"])
    out = None
    for strategy, label, ranking, files in _indexes(t):
        recall = G.recalls(ranking, exact.join(asked(t).where(F.col("label") == label).select("query_id"), "query_id")).agg(F.round(F.avg("recall"), 6).alias("recall"))
        read = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
        part = read.crossJoin(recall).select(F.lit(strategy).alias("strategy"), F.lit(label).alias("label"), "files", "bytes", "recall")  # a row each
        out = part if out is None else out.unionByName(part)
    return out

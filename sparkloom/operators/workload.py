"""Workloads: documents, queries and judgments from facets, samples of them, evidence packets; and their audits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .facets import seeded


def facet_documents(items: DataFrame, item: str, text: str, facets: list[str]) -> DataFrame:
    """doc_id, clip_id, doc_type, text: each item's text and a statement of each facet, first of equal doc_ids kept."""
    own = F.struct(F.concat(F.col(item).cast("string"), F.lit("_text")).alias("doc_id"), F.lit("text").alias("doc_type"), F.col(text).alias("text"))
    said = [F.struct(F.concat_ws("_", F.col(item).cast("string"), F.lit(f)).alias("doc_id"), F.lit("facet").alias("doc_type"), F.concat(F.lit(f"{f} is "), F.col(f).cast("string")).alias("text")) for f in facets]
    rows = items.select(F.col(item).alias("clip_id"), F.explode(F.array(own, *said)).alias("d")).select("d.doc_id", "clip_id", "d.doc_type", "d.text").where("text IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("clip_id").alias("clip_id"), F.min_by("doc_type", "clip_id").alias("doc_type"), F.min_by("text", "clip_id").alias("text"))


def combinations(long: DataFrame, a: str, b: str, least: int = 2, most: int = 220) -> DataFrame:
    """value_a, value_b, support of two facets' values on one item, of support `least` at least, the `most` most frequent."""
    x = long.where(F.col("facet") == a).select("item_id", F.col("value").alias("value_a"))
    y = long.where(F.col("facet") == b).select("item_id", F.col("value").alias("value_b"))
    return x.join(y, "item_id").groupBy("value_a", "value_b").agg(F.countDistinct("item_id").alias("support")).where(F.col("support") >= least).orderBy(F.desc("support"), "value_a", "value_b").limit(most)


def emit_queries(combos: DataFrame, prefix: str, pattern: str, *values: str) -> DataFrame:
    """combos with query_no, query_id and query_text, numbered in the order of support, then values."""
    no = F.row_number().over(Window.orderBy(F.desc("support"), *values))  # combos are capped
    return combos.withColumn("query_no", no).withColumn("query_id", F.concat(F.lit(prefix), F.lpad(F.col("query_no").cast("string"), 4, "0"))).withColumn("query_text", F.format_string(pattern, *[F.col(v) for v in values]))


def qrels(long: DataFrame, queries: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """query_id, item_id, relevance 3: items that hold the value of each facet (facet: the column of its value)."""
    out = None
    for facet, column in wanted.items():
        hit = long.where(F.col("facet") == facet).select("item_id", F.col("value").alias(column)).join(queries.select("query_id", column), column).select("query_id", "item_id").distinct()
        out = hit if out is None else out.join(hit, ["query_id", "item_id"])
    return out.withColumn("relevance", F.lit(3))


def pair_tests(long: DataFrame, predicate: str, relevance: str, low: int, high: int) -> DataFrame:
    """predicate and relevance value pairs whose strict positives (both hold) lie in [low, high], with both counts, the phi
    coefficient, the share of the predicate's items that are relevant, and whether one decides the other."""
    n = long.select("item_id").distinct().count()
    p = long.where(F.col("facet") == predicate).select("item_id", F.col("value").alias("p"))
    r = long.where(F.col("facet") == relevance).select("item_id", F.col("value").alias("r"))
    both = p.join(r, "item_id").groupBy("p", "r").agg(F.count("*").alias("strict"))
    wide = both.join(p.groupBy("p").agg(F.count("*").alias("np")), "p").join(r.groupBy("r").agg(F.count("*").alias("nr")), "r")
    x, a, b = F.col("strict").cast("double"), F.col("np").cast("double"), F.col("nr").cast("double")
    phi = (x * n - a * b) / F.nullif(F.sqrt(a * b * (n - a) * (n - b)), F.lit(0.0))
    return wide.where(F.col("strict").between(low, high)).select("p", "r", "strict", F.col("np").alias("filtered"), F.col("nr").alias("semantic"), F.round(phi, 6).alias("phi"), F.round(x / a, 6).alias("containment"), ((F.col("strict") == F.col("np")) | (F.col("strict") == F.col("nr"))).alias("degenerate"))


def packets(queries: DataFrame, ranking: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """query_id, evidence (rank, item_id, text of the k first, in order), context: the texts as one; k bounds a packet."""
    top = ranking.where(F.col("rank") <= k).join(texts.select("item_id", "text"), "item_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "text"))).alias("evidence"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", "evidence", F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("["), e["rank"].cast("string"), F.lit("] "), e["text"])), "\n").alias("context"))


def subset(parts: dict[str, DataFrame], items: DataFrame) -> dict[str, DataFrame]:
    """The parts of a workload that stand on the given items: qrels of them, and queries with any such qrel."""
    q = parts["qrels"].join(items.select("item_id"), "item_id", "left_semi")
    return {"items": items, "qrels": q, "queries": parts["queries"].join(q.select("query_id").distinct(), "query_id", "left_semi")}


def merge_shards(shards: list[DataFrame], ident: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The last shard's row of each id, and ids whose values differ between shards."""
    rows = None
    for n, s in enumerate(shards):
        part = s.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    conflicts = rows.groupBy(ident).agg(F.countDistinct(value).alias("values")).where("values > 1")
    return rows.groupBy(ident).agg(F.max_by(value, "_n").alias(value)), conflicts


def first_share(rows: DataFrame, share: float, order: list[str]) -> DataFrame:
    """The first floor(share n) of rows (_h: a hash in hex) in an order that begins with the hash.

    Rows are counted by the hash's first four digits, 65,536 cells of near equal size whose counts come to the driver; all
    cells before the one in which the share ends are taken whole, and only that one is put in order.
    """
    cell = F.substring("_h", 1, 4)
    counts = sorted((r["c"], r["n"]) for r in rows.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect())
    left, last = int(share * sum(n for _, n in counts)), None
    for c, n in counts:
        if n > left:
            last = c
            break
        left -= n
    if last is None:
        return rows
    return rows.where(cell < last).unionByName(rows.where(cell == last).orderBy(*order).limit(left))


def inject(docs: DataFrame, dose: float, phrase: Column, seed: str, item: str = "item_id", text: str = "text") -> DataFrame:
    """docs where floor(dose n) documents, first by hash, have a phrase at their end: larger doses hold smaller ones."""
    cut = first_share(docs.select(item, seeded(seed, item).alias("_h")), dose, ["_h", item]).select(item, F.lit(True).alias("_in"))
    return docs.join(cut, item, "left").withColumn(text, F.when(F.col("_in"), F.concat(F.col(text), F.lit(" "), phrase)).otherwise(F.col(text))).withColumn("injected", F.coalesce("_in", F.lit(False))).drop("_in")


def containing(docs: DataFrame, passages: DataFrame, doc_id: str, text: str, item_id: str, passage: str, block: int = 4 << 20) -> DataFrame:
    """doc_id, item_id of each document and each passage that stands in its text as a string.

    The passages are a stated set of queries. They come to the driver in blocks of about `block` characters; each block is an
    automaton that reads every text once, so the work is one scan for a block, and no window of a text is dealt out. Null
    texts and passages hold nothing; an empty passage stands in every text; equal passages are all found; repeated rows of
    docs give repeated rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", passages.schema[item_id].dataType)])
    own = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(ids: dict[str, list]) -> DataFrame:
        def run(batches):
            import ahocorasick

            known = ahocorasick.Automaton()
            for p, items in ids.items():
                if p:
                    known.add_word(p, items)
            known.make_automaton()
            always = ids.get("", [])
            for batch in batches:
                rows, found = [], []
                for i, t in enumerate(batch.column(1)):
                    hit = {id(x): x for _, x in known.iter(t.as_py())} if len(known) else {}
                    for item in [*always, *(y for x in hit.values() for y in x)]:
                        rows.append(i)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, out_type)], names=["doc_id", "item_id"])

        out_type = to_arrow_type(schema["item_id"].dataType)
        return own.mapInArrow(run, schema)

    blocks, ids, size = None, {}, 0
    for r in passages.where(F.col(passage).isNotNull()).select(F.col(item_id), F.col(passage).alias("_p")).toLocalIterator():
        if size + len(r["_p"]) > block and ids:
            blocks, ids, size = scan(ids) if blocks is None else blocks.unionByName(scan(ids)), {}, 0
        ids.setdefault(r["_p"], []).append(r[0])
        size += len(r["_p"])
    if ids:
        blocks = scan(ids) if blocks is None else blocks.unionByName(scan(ids))
    return spark.createDataFrame([], schema) if blocks is None else blocks


def channel_lift(docs: DataFrame, gold: DataFrame, entities: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each entity of a short lexicon, from one pass: its degree, the share of documents that mention it (`naive`) or do so
    without a negation (`affirmed`); the negated share of mentions; and by how much either channel lifts the share of gold
    documents above that of all; recall is that of the affirmed channel. Shares of nothing are null."""
    from ..functions.text import affirmed

    flags = [F.struct(F.lit(e).alias("entity"), F.col("_t").rlike(f"(?i)({e})").alias("n"), affirmed("_t", e).alias("a")) for e in entities]
    rows = docs.select(F.col(doc_id).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t")).select("_d", F.explode(F.array(*flags)).alias("x"))
    known = gold.select(F.col(doc_id).alias("_d")).distinct().withColumn("_g", F.lit(True))
    rows = rows.select("_d", "x.*").join(known, "_d", "left").withColumn("g", F.coalesce("_g", F.lit(False)))
    n, g = F.count("*"), F.count_if("g")
    c = rows.groupBy("entity").agg(n.alias("n"), g.alias("gold"), *[F.count_if(w).alias(k) for k, w in (("naive", F.col("n")), ("aff", F.col("a")), ("ng", F.col("n") & F.col("g")), ("ag", F.col("a") & F.col("g")))])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    base = F.col("gold") / F.col("n")
    lift = lambda a, b: F.when(F.col("gold") > 0, share(a, b) - base)
    out = {"degree_naive": F.col("naive") / F.col("n"), "degree_affirmed": F.col("aff") / F.col("n"), "negated_share": 1 - share("aff", "naive"), "base_rate": base, "lift_naive": lift("ng", "naive"), "lift_affirmed": lift("ag", "aff"), "recall": share("ag", "gold")}
    return c.select("entity", *[F.round(v, 6).alias(k) for k, v in out.items()])


def gate(df: DataFrame, **tests: Column) -> DataFrame:
    """gate, failures, passed: how many rows fail each test (null fails), in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return counts.unpivot("_n", list(tests), "gate", "failures").select("gate", "failures", (F.col("failures") == 0).alias("passed"))


def missing_extra(want: DataFrame, have: DataFrame, ident: str) -> DataFrame:
    """id, side of what is missing from `have` and what it has too much."""
    a, b = want.select(ident).distinct(), have.select(ident).distinct()
    return a.join(b, ident, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, ident, "left_anti").withColumn("side", F.lit("extra")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    b = b.select(*a.columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def same_by(a: DataFrame, b: DataFrame, by: str, out: str) -> DataFrame:
    """by, out: whether both tables hold the same rows as often, in any order of rows and columns; null cells are alike."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        raise ValueError("the tables' columns differ")
    side = lambda df, n: df.select(*cols, F.lit(n).alias("_n"))
    counts = side(a, 1).unionByName(side(b, -1)).groupBy(*cols).agg(F.sum("_n").alias("_n"))
    return counts.groupBy(by).agg((F.count_if(F.col("_n") != 0) == 0).alias(out))


def complete_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the keys' values (few of each) that don't occur."""
    grid = None
    for k in keys:
        own = cells.select(k).distinct()
        grid = own if grid is None else grid.crossJoin(F.broadcast(own))
    return grid.join(cells.select(*keys).distinct(), keys, "left_anti")


def vector_gate(vectors: DataFrame, vector: str, dims: int, low: float = 0.995, high: float = 1.005) -> DataFrame:
    from .retrieval import norm

    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return gate(vectors, shape=F.size(vector) == dims, finite=finite, unit=norm(vector).between(low, high))


def confusion(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Counts and rates of two booleans."""
    g, p = F.col(gold), F.col(pred)
    t = df.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return t.select(*by, "tp", "fp", "fn", "tn", F.round(rate("tp", "fp"), 9).alias("precision"), F.round(rate("tp", "fn"), 9).alias("recall"), F.round(rate("tn", "fp"), 9).alias("specificity"), F.round((rate("tp", "fn") + rate("tn", "fp")) / 2, 9).alias("balanced"))

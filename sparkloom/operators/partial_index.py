"""A partial index for each predicate beside one global index with a filter, both as stored, partitioned vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_folder, stored
from .retrieval import PLACES, dot, exact_scores, top_items


def lists_by(items: DataFrame, by: str, lists: int, rounds: int, seed: str = "17") -> DataFrame:
    """by, list, centre of spherical k-means within each predicate's items: the first centres are the first by hash."""
    keyed = items.select(by, "item_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    order = Window.partitionBy(by).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col("item_id").cast("string")), 256))
    centres = keyed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= lists).select(by, (F.col("_r") - 1).alias("list"), F.col("vector").alias("centre"))
    for _ in range(rounds):
        own = keyed.join(nearest(keyed, centres, by, "item_id", 1).select("item_id", "list"), "item_id")
        dims = own.select(by, "list", F.posexplode("vector").alias("i", "x")).groupBy(by, "list", "i").agg(F.avg("x").alias("m"))
        centres = stored(dims.groupBy(by, "list").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")), "centres")
    return centres


def nearest(rows: DataFrame, centres: DataFrame, by: str, ident: str, n: int) -> DataFrame:
    """ident, list, k: the n nearest of the predicate's lists."""
    all_lists = centres.groupBy(by).agg(F.collect_list(F.struct("list", "centre")).alias("all"))
    scored = rows.join(all_lists, by).select(ident, F.array_sort(F.transform("all", lambda c: F.struct((-F.round(dot("vector", c["centre"]), PLACES)).alias("d"), c["list"].alias("list")))).alias("s"))
    return scored.select(ident, F.posexplode(F.slice("s", 1, n)).alias("k", "x")).select(ident, "x.list", (F.col("k") + 1).alias("k"))


def write_index(items: DataFrame, centres: DataFrame, by: str, folders: list[str]) -> DataFrame:
    """Items stored in folders by the columns named, `list` among them: the nearest of the lists of their own `by`."""
    own = items.join(nearest(items, centres, by, "item_id", 1).select("item_id", "list"), "item_id").withColumns({f"_{c}": F.col(c) for c in folders})
    folder = shared_folder(items.sparkSession, "index")
    own.repartition(*folders).write.partitionBy(*[f"_{c}" for c in folders]).parquet(folder)
    return items.sparkSession.read.parquet(folder)


def pruned_search(index: DataFrame, queries: DataFrame, probed: DataFrame, by: str, value, k: int, partial: bool) -> tuple[DataFrame, DataFrame]:
    """The ranking of the queries that ask for by = value, and the files that it reads with their sizes.

    probed: query_id, list. Folders are pruned before the scan: a partial index's by predicate and probed lists, a global
    one's by probed lists only, the predicate being a filter on rows. Lists are a fixed few. Items and queries of a list meet
    in blocks, whose products send on each query's k best alone: pairs are never rows, and a list is many blocks.
    """
    asked = queries.where(F.col(by) == value).select("query_id", "vector").join(probed, "query_id")
    lists = sorted(r["list"] for r in asked.select("list").distinct().collect())
    read = index.where(F.col("_list").isin(lists))
    read = read.where(F.col(f"_{by}") == value) if partial else read
    files = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    met = exact_scores(read.where(F.col(by) == value).select("item_id", "vector", F.col("_list").alias("list")), asked, k, on=["list"])
    return top_items(met, k), files

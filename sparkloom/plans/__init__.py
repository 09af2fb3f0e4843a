"""What is composed of several operators: strategies of filtered retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import retrieval


def filtered_strategies(items: DataFrame, queries: DataFrame, on: list[str], depth: int, k: int, lexical: DataFrame | None = None, fused: int | None = None) -> DataFrame:
    """B0 metadata alone, B1 lexical (if given), B2 vectors, B3 post-filter over `depth`, B4 pre-filter, B5 both fused
    (the `fused` first; else all that either holds)."""
    meta = retrieval.metadata_ranking(queries, items, on, k)
    pre = retrieval.prefilter_search(items, queries, k, on)
    parts = {"B0": meta, "B2": retrieval.exact_search(items, queries, k), "B3": retrieval.postfilter_search(items, queries, depth, k, on), "B4": pre}
    if lexical is not None:
        parts["B1"] = lexical
    parts["B5"] = retrieval.rrf([(meta if lexical is None else lexical, 1.0), (pre, 1.0)], cut=fused)
    return retrieval.strategies(parts)

"""Sinks: result folders, vector files, and receipts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def guard(df: DataFrame, path: str, overwrite: bool) -> None:
    """Fails where a folder holds anything and overwriting isn't asked for."""
    p, fs = _fs(df, path)
    if not overwrite and fs.exists(p) and len(fs.listStatus(p)):
        raise FileExistsError(path)


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A small text file through Hadoop's file systems, so that any store takes it."""
    write_bytes(df, path, text.encode())


def write_bytes(df: DataFrame, path: str, raw: bytes) -> None:
    p, fs = _fs(df, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def write_results(df: DataFrame, folder: str, overwrite: bool = False, manifest: dict | None = None) -> None:
    """folder/parquet, folder/csv, folder/manifest.json and folder/README.md of a result."""
    guard(df, folder, overwrite)
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{folder}/parquet")
    back = df.sparkSession.read.parquet(f"{folder}/parquet")
    back.write.mode(mode).csv(f"{folder}/csv", header=True)
    facts = {"columns": back.dtypes, "rows": back.count(), "sha256": receipt(back), **(manifest or {})}
    write_text(df, f"{folder}/manifest.json", json.dumps(facts, indent=1, sort_keys=True))
    write_text(df, f"{folder}/README.md", "\n".join(["| column | type |", "|---|---|", *[f"| {c} | {t} |" for c, t in back.dtypes], "", f"{facts['rows']} rows"]) + "\n")


def receipts(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, receipt: a hash of each group's rows as a multiset, from sums of the rows' hashes.

    Sums are made in each partition before anything is dealt out, so neither order nor partitions matter, no row is sorted,
    and a receipt of a whole table (by nothing) costs one row a task. A null isn't any text.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x01")) for c in sorted(df.columns)]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.select(*by, row.alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), *[part(i).alias(f"p{i}") for i in range(4)])
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "p0", "p1", "p2", "p3")]), 256).alias("receipt"))


def receipt(df: DataFrame) -> str:
    """The receipt of a whole table."""
    return receipts(df, []).first()["receipt"]


def write_vectors(df: DataFrame, folder: str, ident: str, vector: str, payload: list[str]) -> None:
    """folder/vectors: ident and little-endian bytes (length, then floats) of each vector; folder/payload: JSON lines."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = [None if v is None else np.int32(len(v)).tobytes() + np.asarray(v, "<f4").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "bytes"])

    df.select(F.col(ident).cast("string").alias("id"), vector).mapInArrow(encode, "id string, bytes binary").write.mode("overwrite").parquet(f"{folder}/vectors")
    df.select(F.col(ident).alias("id"), *payload).write.mode("overwrite").json(f"{folder}/payload")

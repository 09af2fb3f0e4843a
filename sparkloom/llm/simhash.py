"""SimHash fingerprints of word shingles, and their links by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, lean

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words_in: int = 3, seed: int = 42) -> int:
    """Unsigned 64 bits: bit b is set if set in over half of the shingles' XXH64; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n, h = max(1, len(words) - words_in + 1), xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*[words[i:] for i in range(words_in)])) if len(words) >= words_in else [b" ".join(words)]
    totals = np.zeros(64, np.int64)
    hashes = np.fromiter((h(s, seed) for s in shingles), "<u8", n)
    for at in range(0, n, 1 << 14):
        totals += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_in: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's bits as a long) of each row; a null text has no words."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_in, seed) for t in batch.column(2)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("<i8"))], names=["doc_id", "th", "fp"])

    own = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("th"), own.alias("text")).mapInArrow(lean(run), "doc_id long, th long, fp long")


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if k else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints fp that differ in at most `radius` (3 at most) bits, by multi-index hashing.

    Of two halves of 32 bits one differs in at most radius // 2 = 1 bit. Each fingerprint stands in the table of each half
    under that half; it looks up its half and the 32 halves one bit away, and whole distances verify what it meets. A pair
    is met from both sides; the smaller one's lookup is kept, and of two halves that would both find it, the first.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    balls = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)]) if radius > 1 else F.array(F.lit(0).cast("long"))
    table = distinct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _half(F.col("fp"), k).alias("half")) for k in (0, 1)])).alias("s"), F.col("fp").alias("b")).select("s.k", "s.half", "b")
    asks = distinct.select(F.col("fp").alias("a"), F.explode(balls).alias("flip"), F.lit(0).alias("k")).unionByName(distinct.select(F.col("fp").alias("a"), F.explode(balls).alias("flip"), F.lit(1).alias("k")))
    asks = asks.select("a", "k", F.when(F.col("k") == 0, _half(F.col("a"), 0)).otherwise(_half(F.col("a"), 1)).bitwiseXOR(F.col("flip")).alias("half"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near0 = F.bit_count(_half(apart, 0)) <= radius // 2
    met = asks.join(table, ["k", "half"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & ((F.col("k") == 0) | ~near0))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text", words_in: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), group (the group's smallest fingerprint as a long), component_id and text_hash of
    each row.

    Rows link where fingerprints differ in at most `radius` bits, and groups are what links reach; component_id is the
    group's smallest doc_id. Equal fingerprints are one node, so copies make no pairs. Null and empty texts share
    fingerprint zero, linked like any other. Null doc_ids are carried, and are component_id only in a group without others.
    Repeated rows are repeated in the result; an empty table gives none; other columns are left out.
    """
    fps = cut(fingerprints(docs, doc_id, text, words_in, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(links(nodes.select("fp"), radius))  # node, root; only of nodes that have links
    grouped = cut(nodes.join(reach, nodes["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("group")))
    least = cut(grouped.groupBy("group").agg(F.min("least").alias("component_id")))
    of = grouped.select("fp", "group").join(least, "group")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "group", "component_id", F.col("th").alias("text_hash"))


def keep_one(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text", grouped: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of near duplicates, one with the smallest doc_id; all columns stay.

    Of texts that share that doc_id, the one of the smallest hash stays, and one row of rows alike in both. A null doc_id
    stands for its group only if it has no other. `grouped`: near duplicates of another kind than these.
    """
    found = near_duplicates(docs, radius, doc_id, text) if grouped is None else grouped
    rows = found.groupBy("group", "doc_id", "component_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min(F.struct("text_hash", "n", "doc_id")).alias("p"))
    picks = cut(first.select(F.col("p.doc_id").alias("_pick"), F.col("p.text_hash").alias("_pick_hash"), F.col("p.n").alias("_rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name of docs clashes
    same = F.col("_row")[doc_id].cast("long").eqNullSafe(F.col("_pick")) & (F.xxhash64(F.col("_row")[text].cast("string")) == F.col("_pick_hash"))
    once = rows.join(picks.where("_rows = 1"), same, "left_semi")
    again = rows.join(picks.where("_rows > 1"), same)
    one = again.groupBy("_pick", "_pick_hash").agg(F.min_by("_row", F.xxhash64(F.to_json(F.struct("_row")))).alias("_row"))
    return once.unionByName(one.select("_row")).select("_row.*")

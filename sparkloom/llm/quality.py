"""Quality rules: base counts of words and repeats, and compression bands."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut, lean

_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"

#: From so many bytes on: the least and the greatest ratio of compressed to plain bytes of a whole document. Short texts
#: compress badly and vary much, so their bands are wide; prose of any language lies well within at each length.
BANDS = ((0, 0.20, 1.60), (128, 0.28, 1.20), (256, 0.36, 0.95), (1024, 0.32, 0.80), (4096, 0.26, 0.74), (16384, 0.22, 0.72))
#: From FITTED bytes on, the least ratio is fitted to the corpus too where a class has SUPPORT texts: FAR times the quartiles'
#: distance below the lower quartile, the usual bound of what lies far out. It only ever narrows a band.
FITTED, SUPPORT, FAR = 128, 200, 3.0
_HIGH = bytes(range(0x80, 0x100))
#: Bytes of a chunk, whose band is that of its length; a document fails if over OUTSIDE of its bytes are in chunks outside.
CHUNK, OUTSIDE = 4096, 0.25


def band(size: int) -> tuple[float, float]:
    """The least and the greatest ratio for so many bytes."""
    return next((low, high) for at, low, high in reversed(BANDS) if size >= at)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of so many words which the text holds twice or more. Exact: a hash of windows is only
    trusted to say that none repeats, else windows are numbered by doubling."""
    n = len(words)
    if n <= window:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    h = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - window + 1 + k].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    grams, width = ids, 1
    while width < window:  # window need not be a power of two: the last step overlaps
        step = min(width, window - width)
        pairs = grams[: len(grams) - step] * (grams.max() + 1) + grams[step:]
        grams, width = np.unique(pairs, return_inverse=True)[1], width + step
    twice = np.flatnonzero(np.bincount(grams)[grams] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = len(raw) - len(raw.translate(None, _SPACE))
    return len(words), len(text) - space, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def ratios(raw: bytes, zip_) -> tuple[float | None, float | None, float | None, float]:
    """Whole ratio, least and greatest ratio of its chunks, the last of which may be shorter, and the share of its bytes in
    chunks whose ratio lies outside the band for their length."""
    if not raw:
        return None, None, None, 0.0
    whole = len(zip_(raw)) / len(raw)
    chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
    each = [len(zip_(c)) / len(c) for c in chunks] if len(chunks) > 1 else [whole]
    outside = sum(len(c) for c, r in zip(chunks, each) if not band(len(c))[0] <= r <= band(len(c))[1]) / len(raw)
    return whole, min(each), max(each), outside


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: int = 3, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Of each whole document: doc_id, the base counts and base_failed, ratio, least_chunk, greatest_chunk, outside, the stated
    band for its length (least, most), and its class: size (whole binary logarithm of its bytes) and script (0, 1, 2: under a
    tenth, under half, more of its bytes are beyond ASCII)."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        for batch in batches:
            rows = []
            for text_ in batch.column(1):
                s = text_.as_py() or ""
                raw = s.encode("utf-8", "surrogatepass")
                counts = base_counts(s)
                base = counts[0] < least_words or 100 * counts[4] > most_repeated * counts[0]
                beyond = len(raw) - len(raw.translate(None, _HIGH))
                rows.append((*counts, base, *ratios(raw, zip_), *band(len(raw)), len(raw).bit_length() - 1, (10 * beyond >= len(raw)) + (2 * beyond >= len(raw))))
            types = [*[pa.int64()] * 5, pa.bool_(), *[pa.float64()] * 6, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "least_chunk", "greatest_chunk", "outside", "least", "most", "size", "script"]
    kinds = ["long"] * 6 + ["boolean"] + ["double"] * 6 + ["int"] * 2
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(lean(run), ", ".join(map(" ".join, zip(names, kinds))))


def fences(measured: DataFrame, far: float = FAR, support: int = SUPPORT) -> DataFrame:
    """size, script, fence: the least ratio of each class of length and script that has `support` texts: the lower quartile less
    `far` times the quartiles' distance.

    All texts count. Quartiles are those of ratios in thousandths (4 at most), so a class is a bounded number of cells that are
    counted where rows lie, and reruns agree. If over a quarter of a class is repetitive, its quartiles part and the fence falls.
    """
    cells = measured.where((F.col("ratio").isNotNull()) & (F.col("size") >= FITTED.bit_length() - 1)).groupBy("size", "script", F.least(F.floor(F.col("ratio") * 1000), F.lit(4000)).alias("cell")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("size", "script")
    sums = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("cell"))) / 1000
    q = sums.where(F.col("all") >= support).groupBy("size", "script").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    return q.select("size", "script", (F.col("q1") - far * (F.col("q3") - F.col("q1"))).alias("fence"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: int = 3, least_words: int = 20, most_repeated: int = 30, far: float = FAR, support: int = SUPPORT) -> DataFrame:
    """Of each whole document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio,
    least_chunk, greatest_chunk, outside (share of bytes in chunks outside their band), least, most (the limits of its ratio),
    band_failed and kept.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of them in repeated windows. band_failed:
    the whole text's zstandard ratio lies outside its limits, or over a quarter of its bytes are in chunks that lie outside the
    stated band for their length. The limits are those of the stated band for the text's length; the lower one is raised to the
    corpus's own fence for texts of its length and script, if that is higher. kept: neither. A null text has no words, so it
    fails; repeated rows are repeated; an empty table gives none; other columns are left out.
    """
    measured = cut(measures(docs, doc_id, text, level, least_words, most_repeated))
    limits = F.broadcast(fences(measured, far, support))  # a row for each binary logarithm of a length and script: 93 at most
    found = measured.join(limits, ["size", "script"], "left").withColumn("least", F.greatest("least", "fence"))
    failed = F.coalesce(~F.col("ratio").between(F.col("least"), F.col("most")), F.lit(False)) | (F.col("outside") > OUTSIDE)
    return found.withColumn("band_failed", failed).withColumn("kept", ~F.col("base_failed") & ~failed).drop("size", "script", "fence")

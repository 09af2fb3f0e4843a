"""Language ID: text likelihoods, declared languages, address suffixes and host priors in one posterior."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, lean

#: Hashed byte n-grams of a model, and the evidence that a text gives at most, in n-grams: neighbours depend on each other.
CELLS, MOST = 1 << 16, 200.0


def _grams(text: str) -> np.ndarray:
    """Cells of the 3-grams of the bytes of each word's letters, with a blank at both ends; digits and marks part words."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    keep = letter | np.append(letter[1:], False)  # a letter, or what stands before one
    b = np.where(letter, raw, 0x20).astype(np.uint32)[keep]
    b = np.append(b, np.uint32(0x20))
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    h = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1]) * np.uint32(0x01000193) ^ b[2:]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(16)


def train(docs: DataFrame, text: Column, lang: Column, per_language: int = 2000, alpha: float = 0.2) -> tuple[list[str], np.ndarray]:
    """All declared languages, in order of name, and the logs of their n-gram shares, CELLS x languages.

    Of each language about `per_language` rows are read, by a hash of their texts, so the fit is bounded; executors count
    n-grams, and one row of counts for each language comes to the driver.
    """
    rows = docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return [], np.zeros((CELLS, 0), np.float32)
    names = sorted(r["lang"] for r in counts)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.coalesce(rate[F.col("lang")], F.lit(0.0)) * (1 << 20))

    def tally(batches):
        totals = {}
        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.setdefault(l, np.zeros(CELLS, np.int64))
                totals[l] += np.bincount(_grams(t), minlength=CELLS)
        for l, c in totals.items():
            cells = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(c[cells])], names=["lang", "cell", "n"])

    table = np.full((CELLS, len(names)), alpha)
    place = {l: k for k, l in enumerate(names)}
    for r in sample.mapInArrow(lean(tally), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        np.add.at(table, (r.column(1).to_numpy(), [place[x] for x in r.column(0).to_pylist()]), r.column(2).to_numpy())
    return names, np.log(table / table.sum(0)).astype(np.float32)


def text_evidence(docs: DataFrame, text: Column, model: tuple[list[str], np.ndarray], out: str = "_ll") -> DataFrame:
    """docs with `out`: for each language the log likelihood of the whole text, its n-grams weighing MOST in sum at most,
    then that of no language (n-grams at random); null where a text has no letters. The model's size is fixed and small."""
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table))

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        logs, rows = shared.value, []
        for t in texts:
            g = _grams(t) if t else ()
            if not len(g):
                rows.append(None)
                continue
            total = np.zeros(len(names))
            for at in range(0, len(g), 1 << 16):
                total += logs[g[at : at + (1 << 16)]].sum(0, dtype=np.float64)
            rows.append((np.append(total / len(g), -math.log(CELLS)) * min(len(g), MOST)).tolist())
        return pd.Series(rows, dtype=object)

    return docs.withColumn(out, score(text.cast("string")))


def address_parts(host: Column) -> tuple[Column, Column, Column]:
    """suffix, domain (last two labels) and host of a host name, lower-cased; the name itself if it has no dots; null: ""."""
    host = F.lower(F.coalesce(host.cast("string"), F.lit("")))
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The first part of the html element's lang attribute, lower-cased."""
    return F.nullif(F.lower(F.regexp_extract(html.cast("string"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def _best(scores: Column, names: list[str]) -> Column:
    """The first language of the greatest score; null scores: null (Spark holds that an element of a list isn't, so ask)."""
    return F.when(scores.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(scores, F.array_max(scores)).cast("int")))


def identify(docs: DataFrame, evidence: DataFrame, names: list[str], declared: Column, host: Column, weight: float = 10.0, trust: float = 50.0, least: float = 0.5) -> DataFrame:
    """evidence (a frame with _ll and the columns behind `declared` and `host`) with language, confidence and rejected.

    Counts over all rows, by groups: how often each declared language meets each language that texts alone suggest, and
    how often hosts, their domains, their suffixes and all hosts do. Of all counts a row's own is taken away, so that no text
    says the same thing twice and a host of one page doesn't confirm itself. A host's prior is its counts and `weight` times
    the prior of its domain, which leans on its suffix's, and that on the counts of all. A declaration's likelihood is its
    share among rows of a language, with `trust` rows of belief that it is right. Log prior, log likelihood of the declaration
    and that of the text add up to the posterior. Rejected: a text without letters; one that is likelier to be in no
    language; a posterior under `least`. `docs` is what the counts are taken over: the evidence, cut where it is narrow.
    """
    n, none = len(names), "-"
    if not n:
        return evidence.withColumn("language", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0)).withColumn("rejected", F.lit(True)).drop("_ll")
    known = F.when(declared.isin(*names), declared).otherwise(F.lit(none))
    suffix, domain, name = address_parts(host)
    text_only = _best(F.slice("_ll", 1, n), names)
    seen = docs.select(known.alias("d"), suffix.alias("s"), domain.alias("o"), name.alias("h"), text_only.alias("l")).where("l IS NOT NULL")
    counts = cut(seen.groupBy("h", "o", "s", "d", "l").agg(F.count("*").alias("c")))
    told = {(r["d"], r["l"]): r["c"] for r in counts.groupBy("d", "l").agg(F.sum("c").alias("c")).collect()}  # languages squared at most
    totals = [float(sum(c for (_, l), c in told.items() if l == x)) for x in names]
    belief = lambda d: [1.0 if d == none else 0.9 if d == x else 0.1 / max(1, n - 1) for x in names]
    schema = "_d string, _told array<double>, _belief array<double>"
    declarations = evidence.sparkSession.createDataFrame([(d, [float(told.get((d, x), 0)) for x in names], belief(d)) for d in [*names, none]], schema)
    sums = [F.sum(F.when(F.col("l") == x, F.col("c")).otherwise(0)).cast("double").alias(f"n{k}") for k, x in enumerate(names)]
    level = lambda by, key: counts.groupBy(*by).agg(F.array(*sums).alias(key))
    hosts = level(["h", "o", "s"], "_ch").join(level(["o", "s"], "_co"), ["o", "s"]).join(level(["s"], "_cs"), "s")
    hosts = cut(hosts.select(F.col("h").alias("_h"), "_ch", "_co", "_cs"))
    zeros = F.array(*[F.lit(0.0)] * n)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a lambda's variable is formed once, a column in a lambda again and again
    less = lambda c, own: F.zip_with(F.coalesce(c, zeros), own, lambda x, o: F.greatest(x - o, F.lit(0.0)))

    def leaned(own: Column, above: Column) -> Column:
        of = lambda c, rows: F.zip_with(c, above, lambda x, p: (x + weight * p) / (rows + weight))
        return let(own, lambda c: let(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), lambda rows: of(c, rows)))

    def posterior(own: Column, every: Column) -> Column:
        prior = leaned(every, F.array(*[F.lit(1.0 / n)] * n))
        for key in ("_cs", "_co", "_ch"):
            prior = leaned(less(F.col(key), own), prior)
        says = F.zip_with(F.zip_with(less(F.col("_told"), own), F.col("_belief"), lambda x, y: x + trust * y), every, lambda x, c: F.log(F.greatest(x / (c + trust), F.lit(1e-6))))
        texts = F.coalesce(F.slice("_ll", 1, n), zeros)
        return F.zip_with(F.zip_with(prior, says, lambda x, y: F.log(F.greatest(x, F.lit(1e-300))) + y), texts, lambda x, y: x + y)

    guess = F.coalesce(F.array_position(F.slice("_ll", 1, n), F.array_max(F.slice("_ll", 1, n))).cast("int"), F.lit(0))
    own = let(guess, lambda g: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i == g).cast("double")))
    joined = evidence.withColumn("_host", name).join(hosts, F.col("_host") == F.col("_h"), "left")
    joined = joined.withColumn("_known", known).join(F.broadcast(declarations), F.col("_known") == F.col("_d"), "left")  # languages and one more, as rows
    post = let(own, lambda o: let(less(F.array(*[F.lit(x) for x in totals]), o), lambda every: posterior(o, every)))
    joined = joined.withColumn("_post", post).withColumn("_top", F.array_max("_post"))
    share = 1.0 / F.aggregate(F.transform("_post", lambda p: F.exp(p - F.col("_top"))), F.lit(0.0), lambda a, b: a + b)
    noise = F.element_at("_ll", n + 1) > F.array_max(F.slice("_ll", 1, n))
    out = joined.withColumn("language", _best(F.col("_post"), names)).withColumn("confidence", share)
    out = out.withColumn("rejected", F.col("_ll").isNull() | F.coalesce(noise, F.lit(True)) | (F.col("confidence") < least))
    return out.drop("_ll", "_host", "_h", "_ch", "_co", "_cs", "_known", "_d", "_told", "_belief", "_post", "_top")


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """doc_id, declared, host, language, confidence, rejected of each whole document.

    A null or letterless text is rejected; a null or unknown declaration says nothing; a null host is a host of its own.
    Repeated rows are repeated; an empty table gives none; other columns are left out.
    """
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{declared}`").cast("string").alias("declared"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    model = train(picked, F.col("text"), F.col("declared"))
    narrow = cut(text_evidence(picked, F.col("text"), model).drop("text"))
    return identify(narrow, narrow, model[0], F.col("declared"), F.col("host"))


def identify_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, declared (the markup's language), host, language, confidence, rejected of each page, from its text without
    elements; the address gives host and suffix. Nulls and repeats as for documents."""
    text = F.regexp_replace(F.regexp_replace(F.col(f"`{html}`").cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&[a-zA-Z0-9#]{1,32};", " ")
    picked = pages.select(F.col(f"`{page_id}`").alias("page_id"), markup_language(F.col(f"`{html}`")).alias("declared"), url_host(F.col(f"`{url}`")).alias("host"), text.alias("text"))
    model = train(picked, F.col("text"), F.col("declared"))
    narrow = cut(text_evidence(picked, F.col("text"), model).drop("text"))
    return identify(narrow, narrow, model[0], F.col("declared"), F.col("host"))


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """docs without the documents whose language is rejected; all columns stay. Texts are read twice, and never dealt out
    by host unless the table of host priors is too large to be broadcast."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text_, declared_, host_ = F.col("_row")[text], F.col("_row")[declared].cast("string"), F.col("_row")[host].cast("string")
    model = train(named, text_, declared_)
    scored = text_evidence(named, text_, model)
    return identify(scored, scored, model[0], declared_, host_).where("NOT rejected").select("_row.*")

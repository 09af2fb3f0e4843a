"""Sources: canonical workloads, manifests, archives, markup, nested records. Parsing runs on executors."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections import Counter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s = T.StringType()
MAP = T.MapType(_s, _s)

#: The schemas of the canonical relations, so that no read infers.
SCHEMAS = {
    "clips": T.StructType([*[T.StructField(c, _s) for c in ("clip_id", "dataset_id", "source_split", "subset", "video_stem", "media_type", "media_path")], T.StructField("duration_sec", T.DoubleType()), T.StructField("media_exists", T.BooleanType())]),
    "documents": T.StructType([T.StructField(c, _s) for c in ("doc_id", "clip_id", "dataset_id", "doc_type", "text", "lang", "source")]),
    "metadata": T.StructType([*[T.StructField(c, _s) for c in ("clip_id", "dataset_id", "facet_name", "facet_value", "facet_source")], T.StructField("confidence", T.DoubleType())]),
    "queries": T.StructType([*[T.StructField(c, _s) for c in ("query_id", "query_text", "task", "difficulty")], *[T.StructField(c, MAP) for c in ("metadata_filter", "semantic_filter", "qrel_filter")], T.StructField("positive_count", T.IntegerType())]),
    "qrels": T.StructType([*[T.StructField(c, _s) for c in ("query_id", "target_id", "target_type")], T.StructField("relevance", T.IntegerType())]),
}


def load_workload(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five canonical relations: three Parquet tables, queries as JSON lines, judgments as tab-separated text."""
    out = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in ("clips", "documents", "metadata")}
    out["queries"] = read_jsonl(spark, f"{folder}/queries.jsonl", SCHEMAS["queries"])
    out["qrels"] = spark.read.schema(SCHEMAS["qrels"]).csv(f"{folder}/qrels.tsv", sep="\t", header=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines give no rows."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_many(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files that a pattern names, each row with its file's name as source_file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(pattern).withColumn("source_file", F.col("_metadata.file_name"))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, **options)


def read_relations(spark: SparkSession, path: str, schema: T.StructType, column: str, keep: list[str]) -> DataFrame:
    """A large CSV file of relations, filtered as it is read."""
    return spark.read.schema(schema).csv(path, header=True).where(F.col(column).isin(keep))


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """source_file, member and the columns (strings) of all CSV members of zip archives, UTF-8 with or without a mark."""
    fields = ", ".join(f"`{c}` string" for c in columns)

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for name, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in sorted(z.namelist()):
                        if member.lower().endswith(".csv"):
                            rows = list(csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8-sig", newline="")))
                            yield pd.DataFrame({"source_file": name.rsplit("/", 1)[-1], "member": member, **{c: [r.get(c) for r in rows] for c in columns}}, index=range(len(rows)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"source_file string, member string, {fields}")


def read_zipped_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """source_file, member, record of all JSON members of zip archives; a list gives a row for each element."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for name, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in sorted(z.namelist()):
                        if member.lower().endswith(".json"):
                            got = json.loads(z.read(member).decode("utf-8-sig"))
                            rows = got if isinstance(got, list) else [got]
                            yield pd.DataFrame({"source_file": name.rsplit("/", 1)[-1], "member": member, "raw": [json.dumps(r) for r in rows]}, index=range(len(rows)))

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_file string, member string, raw string")
    return rows.select("source_file", "member", F.from_json("raw", schema).alias("record"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows of an XML element, with its file's path."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("source_path", F.col("_metadata.file_path"))


def _under(text: str) -> ElementTree.Element:
    """A text's root below another element, so that a path from the start finds it."""
    above = ElementTree.Element("above")
    above.append(ElementTree.fromstring(text))
    return above


def xml_text(c: Column | str, path: str) -> Column:
    """The text of the first element at a path of names, or of an attribute at its end ("/a/@b"); "" without one."""
    of, _, attr = path.partition("/@")

    def texts(raw: pd.Series) -> pd.Series:
        def first(text):
            if text is None:
                return None
            found = _under(text).findall(f".{of}")
            values = (e.get(attr) for e in found) if attr else ("".join(e.itertext()) for e in found)
            return next((v for v in values if v is not None), "")

        return raw.map(first)

    return F.pandas_udf(texts, "string")(c)


def xml_count(c: Column | str, path: str) -> Column:
    """The number of elements at a path of names."""
    return F.pandas_udf(lambda raw: raw.map(lambda text: None if text is None else len(_under(text).findall(f".{path}"))).astype("Int32"), "int")(c)


def _marks(labels: DataFrame, raw: str, element: str, frame: str, label: str, dropped: str | None) -> DataFrame:
    """labels without `raw`, with a row for each frame and label of a text: frame, label and their number n. Each text is parsed
    once, in batches; a null text or one without elements has no row, and one that isn't XML fails."""
    path = f".{element}"
    rest = [c for c in labels.columns if c != raw]

    def counts(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found: Counter = Counter()
            if text is not None:
                found.update((e.get(frame), e.get(label)) for e in _under(text).findall(path) if dropped is None or e.get(dropped) != "False")
            out.append([{"frame": f, "label": x, "n": n} for (f, x), n in found.items()])
        return pd.Series(out)

    marks = F.pandas_udf(counts, "array<struct<frame:string,label:string,n:long>>")
    rows = labels.select(*rest, F.explode(marks(F.col(raw))).alias("_x"))
    return rows.select(*rest, F.col("_x.frame").cast("int").alias("frame"), F.col("_x.label").alias("label"), F.col("_x.n").alias("n"))


def frame_counts(labels: DataFrame, raw: str, ident: str, element: str, frame: str, label: str, dropped: str | None = None) -> DataFrame:
    """ident, frame, label, n of XML labels (element: a path of names; frame, label, dropped: attributes), elements whose
    `dropped` attribute is "False" left out."""
    rows = _marks(labels.select(ident, raw), raw, element, frame, label, dropped)
    return rows.groupBy(ident, "frame", "label").agg(F.sum("n").alias("n"))


def read_by_folder(spark: SparkSession, path: str) -> DataFrame:
    """value, category, source_path: lines of all text files below a path; the category is the name of a file's own folder
    (after "name=", where the folder is a partition's), with escapes undone."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("source_path", F.col("_metadata.file_path"))
    name = r"^[A-Za-z_][A-Za-z0-9_]*="
    plain = lambda c: F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    own = plain(F.regexp_extract("source_path", r"([^/]+)/[^/]*$", 1))  # an address is escaped, and a partition's name once more
    return rows.withColumn("category", F.when(own.rlike(name), plain(F.regexp_replace(own, name, ""))).otherwise(own))


def category_counts(labels: DataFrame, category: str, raw: str, ident: str, element: str, frame: str, label: str, dropped: str | None = None) -> DataFrame:
    """category, frame, label, n, files, most: labels of all files of a category by frame, how many files hold them, and the
    most of a label in any frame of the category."""
    of = labels.select(F.struct(category, ident).alias("_of"), raw)
    counts = frame_counts(of, raw, "_of", element, frame, label, dropped)
    rows = counts.groupBy(F.col(f"_of.{category}").alias("category"), "frame", "label").agg(F.sum("n").alias("n"), F.countDistinct(f"_of.{ident}").alias("files"))
    most = rows.groupBy("category", "label").agg(F.max("n").alias("most"))
    return rows.join(most, ["category", "label"]).select("category", "frame", "label", "n", "files", "most")


ACTIVITY = "struct<activity:string,act2:map<string,double>,act3:map<string,double>>"


def activity_names(records: DataFrame, raw: str) -> DataFrame:
    """records with `activity`: the name in act2, else in act3, else the flat one, of nested records in JSON or flow style."""
    quoted = F.regexp_replace(raw, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    parsed = F.from_json(quoted, ACTIVITY)
    name = lambda m: F.try_element_at(F.map_keys(parsed[m]), F.lit(1))
    return records.withColumn("activity", F.coalesce(name("act2"), name("act3"), parsed["activity"]))


def read_tracks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """clips, documents and facets of nested tracks {track: {frames, boxes, nl}} in one JSON object."""
    schema = "map<string,struct<frames:array<string>,boxes:array<array<double>>,nl:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("clip_id", "t"))
    clips = rows.select("clip_id", F.size("t.frames").alias("n_frames"), F.try_element_at("t.frames", F.lit(1)).alias("first_frame"))
    docs = rows.select("clip_id", F.posexplode("t.nl").alias("no", "text")).select(F.concat_ws("_", "clip_id", F.col("no").cast("string")).alias("doc_id"), "clip_id", "text")
    parts = F.split(F.col("first_frame"), "/")
    facets = clips.select("clip_id", F.explode(F.map_from_arrays(F.array(F.lit("scene"), F.lit("camera")), F.array(F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3))))).alias("facet", "value")).where("value IS NOT NULL")
    return {"clips": clips, "documents": docs, "facets": facets}


def frames_by_video(listing: DataFrame, path: str = "path") -> DataFrame:
    """video, n_frames, frames (sorted) of a list of files video/frame; a video's frames are bounded by its length."""
    rows = listing.select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("video"), F.col(path).alias("p"))
    return rows.groupBy("video").agg(F.count("*").alias("n_frames"), F.array_sort(F.collect_list("p")).alias("frames"))


class TableStore:
    """What a vector database's adapter offers, over a table of this engine: load, statistics, filtered search, upsert."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def load(self, rows: DataFrame, partition_by: list[str] | None = None, overwrite: bool = True) -> None:
        writer = rows.write.mode("overwrite" if overwrite else "append").format("parquet")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(self.name)
        self.spark.sql(f"ANALYZE TABLE {self.name} COMPUTE STATISTICS")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        from ..operators.retrieval import exact_search

        rows = self.rows() if where is None else self.rows().where(where)
        return exact_search(rows, queries, k)

    def count(self, where: Column) -> int:
        return self.rows().where(where).count()


def landed_revisions(spark: SparkSession, path: str) -> DataFrame:
    """page, day, edits of landed pages of a revision service: JSON lines {page, revisions: [{timestamp}]}."""
    schema = "page string, revisions array<struct<timestamp:string>>"
    rows = spark.read.schema(schema).json(path).select("page", F.explode("revisions").alias("r"))
    return rows.groupBy("page", F.to_date(F.substring("r.timestamp", 1, 10)).alias("day")).agg(F.count("*").alias("edits"))


def landed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, commit, old, new, hashes and chunk changes of landed revision pairs (doc_id, commit, old, new)."""
    from ..functions.text import chunk_paragraphs, front_matter_stripped

    rows = spark.read.schema("doc_id string, commit string, old string, new string").json(path)
    for c in ("old", "new"):
        rows = rows.withColumn(c, front_matter_stripped(c)).withColumn(f"{c}_sha256", F.sha2(c, 256)).withColumn(f"{c}_chunks", chunk_paragraphs(c))
    return rows.withColumn("changed_chunks", F.size(F.array_except("old_chunks", "new_chunks")) + F.size(F.array_except("new_chunks", "old_chunks")))

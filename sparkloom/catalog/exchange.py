"""Sources and sinks: tables are written in a format to the shared folder, and what the reader gives back is held against them."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import query
from ..sources import readers as S
from ..sources import writers as N
from ..sources.shared import shared_folder


def _folder(df, name: str) -> str:
    return shared_folder(df.sparkSession, name)


@query("SRC1 SRC2", """SELECT 'q' || item_id AS query_id, text AS query_text, 'en' AS lang_filter, (SELECT count(*) FROM documents d WHERE d.lang = 'en' AND d.doc_id % 40 = b.item_id % 40) AS judged,
(SELECT count(*) FROM documents) AS clips, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS facets FROM benchmark b""")
def canonical_workload(t):
    """The five canonical relations from their files; queries are JSON lines with blank lines among them."""
    docs, asked = t("documents"), t("benchmark")
    folder, none = _folder(docs, "workload"), F.lit(None).cast("string")
    clips = docs.select(F.concat(F.lit("c"), "doc_id").alias("clip_id"), F.col("source").alias("dataset_id"), *[none.alias(c) for c in ("source_split", "subset", "video_stem", "media_type", "media_path")], F.lit(1.0).alias("duration_sec"), F.lit(True).alias("media_exists"))
    texts = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("c"), "doc_id").alias("clip_id"), F.col("source").alias("dataset_id"), F.lit("text").alias("doc_type"), "text", "lang", "source")
    facets = docs.where("lang IS NOT NULL").select(F.concat(F.lit("c"), "doc_id").alias("clip_id"), F.col("source").alias("dataset_id"), F.lit("lang").alias("facet_name"), F.col("lang").alias("facet_value"), none.alias("facet_source"), F.lit(1.0).alias("confidence"))
    for name, rows in (("clips", clips), ("documents", texts), ("metadata", facets)):
        rows.write.parquet(f"{folder}/{name}.parquet")
    line = F.to_json(F.struct(F.concat(F.lit("q"), "item_id").alias("query_id"), F.col("text").alias("query_text"), F.create_map(F.lit("lang"), F.lit("en")).alias("metadata_filter")))
    asked.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(f"{folder}/queries.jsonl")
    hits = docs.where("lang = 'en'").select("doc_id", (F.col("doc_id") % 40).alias("m")).join(asked.select("item_id", (F.col("item_id") % 40).alias("m")), "m")
    hits.select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.concat(F.lit("c"), "doc_id").alias("target_id"), F.lit("clip").alias("target_type"), F.lit(1).alias("relevance")).write.csv(f"{folder}/qrels.tsv", sep="\t", header=True)
    w = S.load_workload(docs.sparkSession, folder)
    judged = w["qrels"].join(w["clips"], F.col("target_id") == F.col("clip_id"), "left_semi").groupBy("query_id").agg(F.count("*").alias("judged"))
    totals = w["clips"].agg(F.count("*").alias("clips")).join(F.broadcast(w["metadata"].agg(F.count("*").alias("facets"))))  # one row each
    out = w["queries"].join(judged, "query_id", "left").join(F.broadcast(totals))
    return out.select("query_id", "query_text", F.col("metadata_filter")["lang"].alias("lang_filter"), F.coalesce("judged", F.lit(0)).alias("judged"), "clips", "facets")


@query("SRC3", "SELECT s_nationkey, count(*) AS suppliers, true AS named FROM supplier GROUP BY s_nationkey")
def files_by_pattern(t):
    """Rows of all files that a pattern names, each with its file's name."""
    folder = _folder(t("supplier"), "many")
    t("supplier").repartition(5, "s_nationkey").write.parquet(folder)
    rows = S.read_many(t("supplier").sparkSession, f"{folder}/part-*.parquet")
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.bool_and(F.col("source_file").startswith("part-")).alias("named"))


@query("SRC4 SRC11", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def csv_relations(t):
    """A large CSV file of relations, filtered as it is read."""
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    folder = _folder(c, "relations")
    c.write.csv(folder, header=True)
    return S.read_relations(c.sparkSession, folder, c.schema, "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("SRC5 SRC6", """SELECT 'a.csv' AS member, n_nationkey::VARCHAR AS id, n_name AS name, 0 AS n_tags FROM nation UNION ALL SELECT 'b.json', r_regionkey::VARCHAR, r_name, 2 FROM region""")
def zipped_members(t):
    """CSV and JSON members of an archive; it is made here of two tables of fixed, small size."""
    spark = t("nation").sparkSession
    folder, held = _folder(t("nation"), "zip"), io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        rows = t("nation").select("n_nationkey", "n_name").collect()  # 25 rows
        z.writestr("a.csv", "﻿id,name\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows))
        z.writestr("b.json", json.dumps([{"id": r[0], "name": r[1], "tags": ["x", "y"]} for r in t("region").select("r_regionkey", "r_name").collect()]))  # 5 rows
    N.write_bytes(t("nation"), f"{folder}/all.zip", held.getvalue())
    csv = S.read_zipped_csv(spark, f"{folder}/all.zip", ["id", "name"]).select("member", "id", "name", F.lit(0).alias("n_tags"))
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    records = S.read_zipped_json(spark, f"{folder}/all.zip", schema)
    return csv.unionByName(records.select("member", F.col("record.id").cast("string").alias("id"), "record.name", F.size("record.tags").alias("n_tags")))


@query("SRC7 SRC8", """SELECT l_orderkey AS id, l_linenumber % 3 AS frame, l_linestatus AS label, count(*) AS n, max(total) AS boxes FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem) WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber % 3, l_linestatus""")
def markup_frames(t):
    """Labels in XML, one text for each order: boxes counted by frame and label, those marked incorrect left out."""
    box = F.format_string('<box frame="%d" kind="%s" is_correct="%s"/>', (F.col("l_linenumber") % 3).cast("int"), "l_linestatus", F.when(F.col("l_returnflag") == "R", "False").otherwise("True"))
    raw = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("<annotations>"), F.array_join(F.collect_list(box), ""), F.lit("</annotations>")).alias("raw"))  # an order has few lines
    folder = _folder(raw, "markup")
    raw.write.parquet(folder)
    raw = raw.sparkSession.read.schema(raw.schema).parquet(folder)
    counts = S.frame_counts(raw, "raw", "id", "//box", "frame", "kind", "is_correct")
    return counts.join(raw.select("id", S.xml_count("raw", "//box").cast("long").alias("boxes")), "id")


@query("SRC9", """WITH b AS (SELECT o_orderpriority AS category, l_orderkey AS id, l_linenumber % 3 AS frame, l_linestatus AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT category, frame, label, count(*) AS n, count(DISTINCT id) AS files FROM b GROUP BY ALL) SELECT *, max(n) OVER (PARTITION BY category, label) AS most FROM g""")
def folder_categories(t):
    """Labels in XML that lies in a folder for each category: the category is read from the path, not from the rows."""
    box = F.format_string('<box frame="%d" kind="%s"/>', (F.col("l_linenumber") % 3).cast("int"), "l_linestatus")
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    texts = rows.groupBy("o_orderkey", "o_orderpriority").agg(F.concat(F.format_string('<annotations id="%d">', F.first("l_orderkey")), F.array_join(F.collect_list(box), ""), F.lit("</annotations>")).alias("value"))  # an order has few lines
    folder = _folder(texts, "categories")
    texts.select("value", F.col("o_orderpriority").alias("category")).write.partitionBy("category").text(folder)
    raw = S.read_by_folder(t("orders").sparkSession, folder)
    return S.category_counts(raw.withColumn("id", S.xml_text("value", "/annotations/@id")), "category", "value", "id", "//box", "frame", "kind")


@query("SRC10", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'u' || user_id ELSE 'flat' END AS activity FROM events""")
def activity_records(t):
    """Names in nested records: act2, else act3, else the flat one, in flow style or JSON."""
    e = t("events").select("event_id", "event_type", "user_id")
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string("{ act2: { %s: 1.0 }, activity: \"no\" }", "event_type")).when(F.col("event_id") % 3 == 1, F.format_string('{"act3": {"u%d": 0.5}}', "user_id")).otherwise(F.lit('{"activity": "flat"}'))
    return S.activity_names(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "activity")


@query("SRC12", """SELECT 't' || n_nationkey AS clip_id, 2 AS n_frames, 'S0' || n_regionkey AS scene, 'c' || n_nationkey AS camera, 2::BIGINT AS texts FROM nation""")
def nested_tracks(t):
    """Clips, texts and facets of tracks in one JSON object, made here of a table of fixed, small size."""
    n = t("nation")
    folder = _folder(n, "tracks")
    tracks = {f"t{r.n_nationkey}": {"frames": [f"./S0{r.n_regionkey}/c{r.n_nationkey}/img1/{k}.jpg" for k in (1, 2)], "boxes": [[1, 2, 3, 4]], "nl": [r.n_name, "x"]} for r in n.collect()}  # 25 rows
    N.write_text(n, f"{folder}/tracks.json", json.dumps(tracks))
    out = S.read_tracks(n.sparkSession, f"{folder}/tracks.json")
    wide = out["facets"].groupBy("clip_id").pivot("facet", ["scene", "camera"]).agg(F.first("value"))
    return out["clips"].join(wide, "clip_id").join(out["documents"].groupBy("clip_id").agg(F.count("*").alias("texts")), "clip_id").select("clip_id", "n_frames", "scene", "camera", "texts")


@query("SRC19", """SELECT o_custkey::VARCHAR AS page, CAST(o_orderdate AS DATE) AS day, count(*) AS edits FROM orders GROUP BY ALL""")
def landed_edits(t):
    """Edits by page and day, of landed pages of a revision service."""
    o = t("orders").select(F.col("o_custkey").cast("string").alias("page"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'12:00:00'Z'").alias("timestamp")).alias("r"))
    folder = _folder(o, "revisions")
    o.groupBy("page").agg(F.collect_list("r").alias("revisions")).write.json(folder)
    return S.landed_revisions(o.sparkSession, folder)


@query("SRC20", r"""WITH p AS (SELECT doc_id, text AS old, '---' || chr(13) || chr(10) || 'lang: ' || coalesce(lang, '') || chr(13) || chr(10) || '---' || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10)) || chr(10) || 'more' AS new FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(replace(old, chr(13) || chr(10), chr(10)), '(?s)^---\n.*?\n---\n', '')) AS old, trim(regexp_replace(replace(new, chr(13) || chr(10), chr(10)), '(?s)^---\n.*?\n---\n', '')) AS new FROM p)
SELECT doc_id::VARCHAR AS doc_id, sha256(old) AS old_sha256, sha256(new) AS new_sha256 FROM n""")
def landed_revision_pairs(t):
    """Old and new texts of revisions with their hashes, of landed JSON lines; the new ones come with front matter and CRLF."""
    end = F.lit("\r\n")
    new = F.concat(F.lit("---\r\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\r\n---\r\n"), F.replace(F.col("text"), F.lit("\n"), end), F.lit("\nmore"))
    rows = t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("c").alias("commit"), F.col("text").alias("old"), new.alias("new"))
    folder = _folder(rows, "pairs")
    rows.write.json(folder)
    return S.landed_pairs(rows.sparkSession, folder).select("doc_id", "old_sha256", "new_sha256")


@query("SNK1 SNK3", """SELECT o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total, 3 AS files, true AS guarded FROM orders GROUP BY 1""")
def result_folder(t):
    """A result as Parquet, CSV, a manifest and a page, read back from both; a second write without leave fails."""
    r = t("orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    spark, folder = r.sparkSession, _folder(r, "result")
    N.write_results(r, folder, manifest={"query": "result_folder"})
    try:
        N.guard(r, folder, False)
        guarded = False
    except FileExistsError:
        guarded = True
    csv = spark.read.schema(r.schema).csv(f"{folder}/csv", header=True)
    facts = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.get_json_object("value", "$.rows").cast("int").alias("rows"), F.get_json_object("value", "$.query").alias("query"))
    files = facts.select((F.lit(2) + (F.col("query") == "result_folder").cast("int")).alias("files"))  # one row
    return spark.read.parquet(f"{folder}/parquet").join(csv, ["priority", "orders", "total"], "left_semi").join(F.broadcast(files)).withColumn("guarded", F.lit(guarded))


@query("SNK2", """SELECT vec_id, label, len(embedding)::INT AS dims, 4 * (len(embedding) + 1) AS bytes FROM embeddings""")
def vector_files(t):
    """Vectors as bytes of a length and floats beside a payload of JSON lines, read back."""
    e = t("embeddings")
    folder, spark = _folder(e, "vectors"), e.sparkSession
    N.write_vectors(e, folder, "vec_id", "embedding", ["label"])
    v = spark.read.parquet(f"{folder}/vectors").select(F.col("id").cast("long").alias("vec_id"), F.length("bytes").alias("bytes"), F.conv(F.hex(F.substring("bytes", 1, 1)), 16, 10).cast("int").alias("low"))
    p = spark.read.schema("id long, label int").json(f"{folder}/payload")
    return v.join(p, F.col("vec_id") == F.col("id")).select("vec_id", "label", F.col("low").alias("dims"), "bytes")

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources import readers as S
from sparkloom.sources import writers as N


def test_canonical_workload(spark, tmp_path):
    for n in ("clips", "documents", "metadata"):
        spark.createDataFrame([], S.SCHEMAS[n]).write.parquet(f"{tmp_path}/{n}.parquet")
    (tmp_path / "queries.jsonl").write_text('{"query_id": "q1", "metadata_filter": {"a": "b"}, "positive_count": 3}\n\n  \n{"query_id": "q2"}\n')
    (tmp_path / "qrels.tsv").write_text("query_id\ttarget_id\ttarget_type\trelevance\nq1\tc1\tclip\t3\n")
    w = S.load_workload(spark, str(tmp_path))
    assert [(r.query_id, r.metadata_filter) for r in w["queries"].collect()] == [("q1", {"a": "b"}), ("q2", None)]
    assert w["qrels"].first().relevance == 3 and w["clips"].count() == 0


def test_files_by_name_and_manifest(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/a")
    assert S.read_many(spark, f"{tmp_path}/a/*.parquet").select("source_file").distinct().count() == 1
    (tmp_path / "m.csv").write_text("rel,x\nkeep,1\ndrop,2\nkeep,3\n")
    schema = T.StructType([T.StructField("rel", T.StringType()), T.StructField("x", T.IntegerType())])
    assert S.read_manifest(spark, f"{tmp_path}/m.csv", schema).count() == 3
    assert [r.x for r in S.read_relations(spark, f"{tmp_path}/m.csv", schema, "rel", ["keep"]).collect()] == [1, 3]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.csv", "﻿id,v\n1,x\n2,y\n")
        z.writestr("b.json", json.dumps([{"id": 1, "tags": ["p", "q"]}, {"id": 2, "tags": []}]))
    rows = S.read_zipped_csv(spark, f"{tmp_path}/z.zip", ["id", "v"]).collect()
    assert [(r.member, r.id, r.v) for r in rows] == [("d/a.csv", "1", "x"), ("d/a.csv", "2", "y")]
    got = S.read_zipped_json(spark, f"{tmp_path}/z.zip", T._parse_datatype_string("id int, tags array<string>")).select("record.*").collect()
    assert [(r.id, r.tags) for r in got] == [(1, ["p", "q"]), (2, [])]


def test_markup(spark, tmp_path):
    xml = '<annotations><track label="car"><box frame="1" is_correct="True" kind="car"/><box frame="1" is_correct="False" kind="car"/><box frame="2" kind="bus"/></track><name>x</name></annotations>'
    df = spark.createDataFrame([("v", xml)], "id string, raw string")
    r = df.select(S.xml_text("raw", "/annotations/name").alias("n"), S.xml_count("raw", "//box").alias("c")).first()
    assert (r.n, r.c) == ("x", 3)
    got = S.frame_counts(df, "raw", "id", "//box", "frame", "kind", "is_correct").collect()
    assert sorted((r.frame, r.label, r.n) for r in got) == [(1, "car", 1), (2, "bus", 1)]
    (tmp_path / "a.xml").write_text("<root><row><id>1</id></row><row><id>2</id></row></root>")
    assert S.read_xml(spark, f"{tmp_path}/a.xml", "row", T.StructType([T.StructField("id", T.IntegerType())])).count() == 2


def test_nested_records(spark, tmp_path):
    df = spark.createDataFrame([("{ act2: { walk: 1.0 } }",), ('{"act3": {"run": 1.0}}',), ('{"activity": "flat"}',)], "raw string")
    assert [r.activity for r in S.activity_names(df, "raw").collect()] == ["walk", "run", "flat"]
    (tmp_path / "t.json").write_text(json.dumps({"t1": {"frames": ["./S01/c003/img1/1.jpg", "./S01/c003/img1/2.jpg"], "boxes": [[1, 2, 3, 4]], "nl": ["a red car", "a car"]}}))
    out = S.read_tracks(spark, f"{tmp_path}/t.json")
    assert out["clips"].first().n_frames == 2 and out["documents"].count() == 2
    assert {r.facet: r.value for r in out["facets"].collect()} == {"scene": "S01", "camera": "c003"}
    frames = S.frames_by_video(spark.createDataFrame([("v/2.jpg",), ("v/1.jpg",), ("w/1.jpg",)], "path string"))
    assert {r.video: r.frames for r in frames.collect()} == {"v": ["v/1.jpg", "v/2.jpg"], "w": ["w/1.jpg"]}


def test_landed_services(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"page": "p", "revisions": [{"timestamp": "2024-01-01T01:00:00Z"}, {"timestamp": "2024-01-01T02:00:00Z"}]}\n')
    assert S.landed_revisions(spark, f"{tmp_path}/r.json").first().edits == 2
    (tmp_path / "p.json").write_text(json.dumps({"doc_id": "d", "commit": "c", "old": "x" * 50, "new": "y" * 50}) + "\n")
    assert S.landed_pairs(spark, f"{tmp_path}/p.json").first().changed_chunks == 2


def test_table_store(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(10)], "item_id long, vector array<float>, grp int")
    store = S.TableStore(spark, "vectors_of_test")
    store.load(rows, ["grp"])
    asked = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.item_id for r in store.search(asked, 2, F.col("grp") == 0).orderBy("rank").collect()] == [8, 6] and store.count(F.col("grp") == 1) == 5
    spark.sql("DROP TABLE vectors_of_test")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, None)], "id int, v array<float>, p string")
    N.write_results(df.select("id", "p"), f"{tmp_path}/out")
    with pytest.raises(FileExistsError):
        N.write_results(df.select("id", "p"), f"{tmp_path}/out")
    N.write_results(df.select("id", "p"), f"{tmp_path}/out", overwrite=True)
    assert json.loads((tmp_path / "out/manifest.json").read_text())["rows"] == 2
    assert N.receipt(df.select("id", "p")) == N.receipt(df.select("p", "id").orderBy(F.desc("id"))) != N.receipt(df.select("id", "p").limit(1))
    N.write_vectors(df, f"{tmp_path}/vec", "id", "v", ["p"])
    raw = {r.id: r.bytes for r in spark.read.parquet(f"{tmp_path}/vec/vectors").collect()}
    assert raw["1"].hex() == "020000000000803f00000040" and raw["2"] is None


def test_streams(spark, tmp_path):
    from sparkloom.streaming import versions as V

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = V.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, V.windowed_counts(events).collect()))
    ups = stream.selectExpr("user_id AS doc_id", "event_id AS version", "event_type AS kind")
    q = ups.writeStream.foreachBatch(V.publish_batches("published_of_test")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.user_id: r.m for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.doc_id: r.version for r in spark.table("published_of_test").collect()} == want
    spark.sql("DROP VIEW published_of_test")
    for side in "ab":
        spark.sql(f"DROP TABLE IF EXISTS published_of_test_{side}")

"""XML labels parsed once a text, in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.sources import readers as S


def test_labels_counts_and_attributes(spark):
    xml = '<a id="7"><box frame="1" kind="x"/><t><box frame="1" kind="x" ok="False"/><box frame="2" kind="y" ok="True"/></t>n<b>m</b></a>'
    df = spark.createDataFrame([(1, xml), (2, "<a/>"), (3, None)], "id int, raw string").repartition(1)
    counts = S.frame_counts(df, "raw", "id", "//box", "frame", "kind", "ok")
    assert "xpath" not in counts._jdf.queryExecution().optimizedPlan().toString()  # which sets up a parser for each text and path
    assert sorted(map(tuple, counts.collect())) == [(1, 1, "x", 1), (1, 2, "y", 1)]
    got = df.select("id", S.xml_count("raw", "//box").alias("n"), S.xml_text("raw", "/a/@id").alias("a"), S.xml_text("raw", "/a").alias("t"), F.col("raw")).orderBy("id").collect()
    assert [(r.n, r.a, r.t) for r in got] == [(3, "7", "nm"), (0, "", ""), (None, None, None)]

import random

import corpus_pipeline
from sparkloom.llm import catalog, pii, simhash

from .helpers import docs, prose
from .test_language import text


def corpus():
    rng = random.Random(6)
    rows = [(i, text(l, 50 + rng.randrange(80), i), l, f"s{i % 4}") for i in range(50) for l in ("en", "de")]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    rows += [(500 + i, rows[3][1], "en", "s9") for i in range(4)]
    rows += [(600, rows[4][1] + " mail me a.b@c.org", "en", "s1"), (601, None, "en", "s1"), (602, "12 34", "en", "s1"), (603, text("en", 60, 999) + " at x.y@z.net and +1 (555) 555-1234", "en", None), (603, prose(3), "en", None)]
    return rows


def test_each_stage_acts_and_all_columns_stay(spark, tmp_path):
    rows = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, folder = docs.columns, str(tmp_path)
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], folder)
        out.write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frames[-1].columns == columns
    named, alone, clean, mixed, packed = frames[1:]
    assert {r.doc_id for r in docs.join(named, "doc_id", "left_anti").collect()} == {601, 602}
    assert alone.where("doc_id >= 500 AND doc_id < 600").count() == 0 and alone.where("doc_id = 3").count() == 1
    assert simhash.near_duplicates(alone).select("group").distinct().count() == alone.count()
    assert clean.count() == alone.count() and clean.where("text LIKE '%@%'").count() == 0
    assert sum(r.n_email + r.n_phone for r in pii.digest(pii.spans(clean)).collect()) == 0
    assert mixed.count() > 0 and mixed.join(clean, ["doc_id", "text"], "left_anti").count() == 0
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}

    docs.write.parquet(f"{folder}/documents.parquet")
    whole = corpus_pipeline.run(spark, folder)
    key = lambda d: sorted(str((r.doc_id, r.piece, r.length, r.ids_crc32)) for r in d.collect())
    assert key(whole) == key(packed)


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = catalog.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]


def test_no_name_of_a_column_clashes(spark):
    """Rows keep columns of any name where copies are dealt out and where one of each group stays."""
    from sparkloom.llm import jaccard, mixing, simhash

    names = ["_k", "_t", "_copies", "_rows", "_copy", "_pick", "_pick_hash", "_row", "_place", "key", "size", "node", "group", "component_id", "text_hash"]
    rows = [(k // 2, prose(30 + 20 * (k // 2), k // 2), "en", f"s{k % 2}") for k in range(12)] + [(0, prose(30, 0), "en", "s0")]
    df = docs(spark, rows).select("doc_id", "text", "source").selectExpr("*", *[f"concat('v', doc_id, '{n}') AS `{n}`" for n in names])
    mixed = mixing.mix(df, weights=[3.0, 1.0], share=1.5, most=2.0, max_copies=2)
    repeated = mixing.repeat_rows(df, mixed)
    assert repeated.columns == df.columns and repeated.count() == mixed.selectExpr("sum(copies)").first()[0]
    assert all(r[n] == f"v{r.doc_id}{n}" for r in repeated.collect() for n in names)
    for grouped in (None, jaccard.near_duplicates(df)):
        kept = simhash.keep_one(df, grouped=grouped)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(6))
        assert all(r[n] == f"v{r.doc_id}{n}" for r in kept.collect() for n in names)

import duckdb

from sparkloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, seq long, start long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, "cy", "first"), (3, 1, None, "who"), (3, 1, "cy", ""),
    (None, 0, "dee", "no id"), (None, 1, "eve", "none"), (4, 0, "é日", "ünï"), (4, 1, "x", "y"),
]


def test_renderings_equal_the_sql(spark):
    df = table(spark, ROWS)
    got = chat.rotate(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.SQL).df()
    show = lambda x: "~" if str(x) in ("None", "nan", "<NA>") else str(int(x)) if isinstance(x, float) else str(x)
    canon = lambda d: sorted(tuple(map(show, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert canon(got) == canon(want)


def test_masks_cover_own_texts_alone(spark):
    rows = chat.rotate(table(spark, ROWS)).collect()
    for key in {(r.conv_id, r.perspective) for r in rows}:
        own = sorted((r for r in rows if (r.conv_id, r.perspective) == key), key=lambda r: r.seq)
        whole = "".join(r.rendered for r in own)
        assert [r.seq for r in own] == list(range(len(own)))
        for r in own:
            assert whole[r.start : r.start + len(r.rendered)] == r.rendered
            assert (r.mask_start is not None) == (r.role == "assistant") == (r.name == key[1])
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>") and whole[r.mask_start - 1] == "\n"
        assert whole.count("<|im_end|>") == len(own)
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (3, "cy"), (None, "dee"), (None, "eve"), (4, "é日"), (4, "x")}


def test_empty_table(spark):
    assert chat.rotate(table(spark, [])).count() == 0


def test_plan_runs_no_python(spark):
    plan = chat.rotate(table(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

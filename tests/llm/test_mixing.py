import random

from sparkloom.llm import mixing

from .helpers import docs, prose


def rows():
    rng = random.Random(2)
    out = [(i, "w " * rng.choice([1, 2, 3, 10, 200]), "en", rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    return out + [(700, None, "en", "a"), (701, "", "en", "b"), (702, "tiny", "en", "z"), (5, "again " * 7, "en", "a"), (None, "x y", "en", "b"), (703, "w " * 50, "en", "c"), (703, "w " * 50, "en", "c")]


def expected(data, weights=(3, 1, 2), share=1.5, most=2):
    total = {}
    for _, text, _, source in data:
        total[source] = total.get(source, 0) + len((text or "").split())
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(total.values()), set()
    while True:
        level = (goal - sum(most * total[s] for s in full)) / sum(w[s] for s in order if s not in full)
        new = {s for s in order if most * total[s] <= w[s] * level}
        if new == full:
            return total, {s: most * total[s] if s in full else w[s] * level for s in order}
        full = new


def test_targets_and_taken_words(spark):
    data = rows()
    df = docs(spark, data)
    got = mixing.mix(df, [3.0, 1.0, 2.0]).collect()
    total, target = expected(data)
    assert len(got) == len(data)
    taken, longest = {}, {}
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 1), r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 4e-6 * 2 * total[s] + 1
    again = mixing.mix(df.repartition(7), [3.0, 1.0, 2.0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_are_an_exponential_tilt(spark):
    """r / (2 - r) is exp(lambda size): its log is in proportion to size within a source."""
    import math

    got = [r for r in mixing.mix(docs(spark, rows()), [3.0, 1.0, 2.0]).collect() if r.source == "a" and r["size"] and 0.01 < r.rate < 1.99]
    slopes = [math.log(r.rate / (2 - r.rate)) / r["size"] for r in got if r["size"] >= 10]
    assert max(slopes) - min(slopes) < 1e-3 * max(map(abs, slopes)) + 1e-6


def test_rows_repeat_as_they_are_taken(spark):
    df = docs(spark, [(1, "a"), (2, "b"), (2, "b"), (2, "c"), (3, "c"), (None, "d"), (4, None), (4, None), (4, None)])
    mixed = [(1, "a", 0), (2, "b", 2), (2, "b", 1), (2, "c", 0), (3, "c", 1), (None, "d", 2), (4, None, 0), (4, None, 1), (4, None, 0)]
    copies = spark.createDataFrame([(i, "src0", t, n) for i, t, n in mixed], "doc_id long, source string, text string, copies int").selectExpr("*", "xxhash64(text) AS text_hash")
    got = mixing.repeat_rows(df, copies)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("2", "b")] * 3 + [("3", "c")] + [("None", "d")] * 2 + [("4", "None")])


def test_the_repeated_rows_hold_the_words_of_the_mix(spark):
    """One doc_id with texts of very different sizes, and rows alike."""
    data = [(i % 7, prose(1 + 40 * (i % 5), i % 11), "en", "ab"[i % 2]) for i in range(120)]
    df = docs(spark, data)
    mixed = mixing.cut(mixing.mix(df, [3.0, 1.0, 2.0]))
    want = mixed.groupBy("source").sum("taken").collect()
    got = {}
    for r in mixing.repeat_rows(df, mixed).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {r[0]: r[1] for r in want}


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(docs(spark, []), [3.0, 1.0, 2.0]).count() == 0
    got = mixing.mix(docs(spark, [(1, None), (2, "")]), [3.0, 1.0, 2.0]).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, id string")


def exact(rows, k):
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)}
    out = {}
    for q in v:
        if q % 20 == 0:
            s = sorted(((-float(v[q] @ v[j]), j) for j in v if j != q))[:k]
            out[q] = [(j, -a) for a, j in s]
    return out


def test_recall_ranks_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    vectors = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 24))
    vectors[::7] *= 3  # norms differ: greatest inner product isn't least distance
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = ann.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    want = exact(rows, 20)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, top in want.items():
        own = sorted(mine[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        hits += len({j for _, j, _ in own} & {j for j, _ in top})
        for _, j, s in own:
            assert abs(s - float(np.float32(vectors[q]).astype(float) @ np.float32(vectors[j]).astype(float))) < 1e-9
    assert hits / (20 * len(want)) >= 0.9


def test_ties_repeats_and_invalid_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 0.0]), (120, [float("nan"), 1.0, 0.0]), (140, [float("inf"), 0.0, 0.0]), (160, []), (180, [1.0, 2.0]), (200, [0.5, 0.5, 0.0]), (200, [0.5, 0.5, 0.0]), (None, [1.0, 1.0, 1.0]), (61, [0.0, 1.0, 0.0])]
    got = ann.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 200}
    assert by[0] == list(range(1, 21)) and by[20] == [*range(20)] and by[40] == [*range(20)]
    assert by[200] == [*range(20)]


def test_fewer_candidates_than_asked(spark):
    rows = [(20 * i, [1.0, float(i)]) for i in range(1, 6)]
    got = ann.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    want = exact(rows, 20)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, k, j) for q, top in want.items() for k, (j, _) in enumerate(top, 1)}
    assert ann.search(frame(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.search(frame(spark, [(20, [1.0, 2.0])]), F.col("id") % 20 == 0).count() == 0


def test_large_lists_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "ASKS", 5)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))]
    got = ann.search(frame(spark, rows), F.col("id") % 20 == 0, k=5).collect()
    want = exact(rows, 5)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got)
    assert len(got) == 5 * len(want) and hits / len(got) >= 0.9


def test_scan_gives_up_far_pairs_early_and_keeps_near_ones():
    rng = np.random.default_rng(2)
    points, queries = rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    d = ((queries[:, None] - points) ** 2).sum(2)
    bounds = np.sort(d, 1)[:, 20]
    i, j = ann.scan(queries, points, bounds)
    kept = set(zip(i.tolist(), j.tolist()))
    near = {(a, b) for a in range(20) for b in np.argsort(d[a])[:20].tolist()}
    assert len(kept) <= 21 * 20 and len(near & kept) >= 0.97 * len(near)


def recall(spark, rows, want, k):
    got = ann.search(frame(spark, rows), F.col("id") % 20 == 0, k=k).collect()
    assert len(got) == k * len(want)
    return sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got) / len(got)


def test_recall_is_that_of_probed_lists_whatever_the_pilot(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 24)))]
    want = exact(rows, 20)
    monkeypatch.setattr(ann, "PILOT", 200)
    assert recall(spark, rows, want, 20) >= 0.9
    monkeypatch.setattr(ann, "COVER", 0.3)  # few lists: a pilot that is the whole table may not make up for them
    few = recall(spark, rows, want, 20)
    monkeypatch.setattr(ann, "PILOT", 4096)
    assert few < 0.8 and abs(recall(spark, rows, want, 20) - few) < 0.03


class Tight(ann.Index):
    """Bounds so narrow that the scan gives up all."""

    def bounds(self, queries, probed):
        return np.zeros(len(queries))


def test_queries_left_with_too_few_scan_again_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(ann, "Index", Tight)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 40)))]
    assert recall(spark, rows, exact(rows, 20), 20) >= 0.9


def test_ids_with_several_vectors_and_vectors_of_other_lengths(spark):
    """An id is one neighbour by its best vector, and one query; each length is searched for itself."""
    rng = np.random.default_rng(31)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60) for _ in range(1 + (i % 3 == 0))]
    rows += [(100 + i, rng.standard_normal(4).tolist()) for i in range(12)] + [(0, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for i, v in rows:
            for j, w in rows:
                if i == q and j != q and len(v) == len(w):
                    best[j] = max(best.get(j, -1e9), float(np.dot(v, w)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine}) == 5
        assert sum(m[1] == w[0] for m, w in zip(mine, want)) >= 4 and all(abs(best[m[1]] - m[2]) < 1e-9 for m in mine)

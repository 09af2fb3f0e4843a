import datetime
import hashlib
import random

from sparkloom.llm import catalog, patterns

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, part int, at long, id long, tag long, labels string"
T0 = datetime.datetime(2024, 1, 1)


def table(spark, rows, parts=3):
    """rows: (client_id, click_id, seconds or None, kind, value[, props])."""
    full = [(r[1], None if r[2] is None else T0 + datetime.timedelta(seconds=r[2]), T0, r[0], r[3], r[4], r[5] if len(r) > 5 else "{}", 7, 8, 9, 10, "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def whole_cents(v):
    import math

    return None if v is None or not math.isfinite(v) else math.floor(100.0 * v + 0.5)


def brute(rows):
    """The expression by backtracking over each start, loops as short as they can be."""
    out = []
    for client in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted({tuple(r) for r in rows if r[0] == client and r[2] is not None}, key=lambda r: (r[2], r[1] is not None, r[1] or 0, whole_cents(r[4]) is not None, whole_cents(r[4]) or 0))
        c = [whole_cents(r[4]) for r in own]

        def letters(i, start):
            got, fine = "", c[i] is not None and c[i - 1] is not None and own[i][2] - own[i - 1][2] <= 600
            if fine and own[i][3] == "purchase" and c[i] >= c[start]:
                got += "P"
            if fine and own[i][3] not in (None, "error") and c[i] != c[i - 1]:
                got += "D" if c[i] < c[i - 1] else "U"
            return got

        i, no = 0, 0
        while i < len(own):
            j, labels, end = i + 1, "A", None
            while c[i] is not None and j < len(own):
                got = letters(j, i)
                if "P" in got:
                    end, labels = j, labels + "P"
                    break
                if not got:
                    break
                labels, j = labels + got, j + 1
            if end is None:
                i += 1
                continue
            no += 1
            out.append((client, no, own[i][1], own[end][1], end - i + 1, sum(c[i : end + 1]), labels))
            i = end + 1
    return sorted(out, key=str)


def found(df, **how):
    return sorted((tuple(r) for r in patterns.match_rows(df, **how).collect()), key=str)


def made(n, seed, clients, calm):
    rng = random.Random(seed)
    kinds = ["view", "click", "signup", "purchase"] + ([] if calm else ["error", None])
    t, rows = 0, []
    for k in range(n):
        t += rng.choice([0, 1, 30, 599, 600]) if calm else rng.choice([0, 1, 60, 600, 601, 5000])
        v = rng.choice([None, float("nan"), 1.005, -2.0]) if not calm and rng.random() < 0.1 else round(rng.uniform(0, 50), 2)
        rows.append((rng.choice(clients), k, t, rng.choice(kinds), v))
    return rows


def test_matches_equal_backtracking(spark):
    rows = made(1500, 1, [1, 1, 1, 2, 3, None], False)
    rows += rows[::7] + [(1, 9000, None, "view", 1.0), (2, 9001, 10, "view", 5.0, "other"), (2, 9001, 10, "view", 5.0)]
    assert found(table(spark, rows)) == brute([(*r, "{}")[:6] for r in rows])


def test_long_runs_cross_pieces_and_partitions(spark):
    """Runs without a break over many pieces: every row may follow the one before it."""
    for seed, goals in ((2, 0.02), (3, 0.3)):
        rng, rows, t, v = random.Random(seed), [], 0, 5000
        for k in range(900):
            t, v = t + rng.randrange(1, 600), max(1, v + rng.choice([-700, -30, -1, 1, 25, 900]))
            rows.append((rng.choice([4, 4, 4, 5]) if k % 300 == 299 else 4, k, t, "purchase" if rng.random() < goals else "view", v / 100))
        want = brute([(*r, "{}") for r in rows])
        assert want
        for longest in (3, 64, 8192):
            assert found(table(spark, rows, 5), longest=longest) == want, (seed, longest)


def test_one_match_over_all_pieces(spark):
    rows = [(1, k, k, "view", (1000 - k) / 10) for k in range(400)] + [(1, 400, 400, "purchase", 100.0), (1, 401, 401, "purchase", 500.0)]
    got = found(table(spark, rows), longest=5)
    assert got == brute([(*r, "{}") for r in rows]) and got[0][4] == 401 and got[0][6] == "A" + "D" * 399 + "P"


def test_bounds_of_time_cents_and_kinds(spark):
    rows = [
        (1, 1, 0, "view", 1.0), (1, 2, 600, "purchase", 1.0), (2, 1, 0, "view", 1.0), (2, 2, 601, "purchase", 1.0), (3, 1, 0, "error", 2.0), (3, 2, 1, "purchase", 1.99), (3, 3, 2, "purchase", 2.0),
        (4, 1, 0, "purchase", 3.0), (4, 2, 1, "view", 3.0), (4, 3, 2, "purchase", 3.0), (5, 1, 0, "view", None), (5, 2, 1, "purchase", 1.0), (6, 1, 0, "view", 1.0), (6, 2, 1, None, 0.5), (6, 3, 2, "purchase", 9.0),
        (7, 1, 0, "view", 0.005), (7, 2, 0, "purchase", 0.01), (8, None, 0, "view", 1.0), (8, 5, 0, "purchase", 2.0),
    ]
    assert found(table(spark, rows)) == brute([(*r, "{}") for r in rows])


def test_one_client_of_all_rows_and_empty_tables(spark):
    rows = made(3000, 5, [7], True)
    assert found(table(spark, rows, 8)) == brute([(*r, "{}") for r in rows])
    assert found(table(spark, rows[:1])) == [] and found(table(spark, rows).limit(0)) == []


def test_the_query_hashes_labels(spark, tmp_path):
    rows = made(300, 6, [1, 2], False)
    table(spark, rows).select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").write.parquet(f"{tmp_path}/clicks.parquet")
    got = sorted(map(tuple, catalog.op12_row_patterns(spark, str(tmp_path)).select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256").collect()))
    assert got == sorted((*r[:6], hashlib.sha256(r[6].encode()).hexdigest()) for r in brute([(*r, "{}") for r in rows]))

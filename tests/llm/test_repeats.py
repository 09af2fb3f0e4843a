import hashlib
import random

import pytest

from sparkloom.llm import repeats

from .helpers import docs, prose


def brute(rows, length):
    """rows: (key, bytes) in the order of the corpus."""
    seen, out = set(), []
    for _, raw in rows:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    passage, base = prose(40, 77), prose(400, 5)
    out = [base, base, base.replace("alpha", "ALPHA", 3), prose(30, 1) + passage + prose(30, 2), passage, prose(3, 9) + passage[:150] + prose(20, 4) + passage[40:], "Ab " * 500, "Ab " * 300 + "x", "a" * 3000, "", "short", "é日本" * 200]
    out += [prose(rng.randrange(5, 60), 100 + i) + (passage if i % 3 == 0 else "") + prose(10, 500 + i) for i in range(40)]
    return out


@pytest.mark.parametrize("length", [100, 40, 7])
def test_against_brute_force(spark, length):
    texts = corpus()
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(spark, [(3 * i, t) for i, t in enumerate(texts)]), length).collect()}
    for i, want in enumerate(brute([(i, t.encode()) for i, t in enumerate(texts)], length)):
        r = got[3 * i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed


def test_nulls_repeated_rows_and_shared_ids(spark):
    a, b = prose(60, 1), prose(60, 2)
    got = repeats.remove_repeats(docs(spark, [(1, None), (2, a), (2, a), (5, a), (None, a + b), (7, b), (8, b), (8, prose(50, 3))])).collect()
    removed = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in got)
    assert removed == [(1, 0), (2, 0), (2, 0), (5, len(a)), (7, 0), (8, 0), (8, len(b)), (99, len(a) + len(b))]
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_triggers_hang_on_the_window_alone(monkeypatch):
    import numpy as np

    text = prose(300, 6).encode()
    alone = repeats.triggers(np.frombuffer(text, np.uint8), np.array([len(text)]), 100)
    shifted = repeats.triggers(np.frombuffer(b"#" * 777 + text, np.uint8), np.array([777, 777 + len(text)]), 100)
    mine = shifted[2] >= 777
    assert (alone[0] == shifted[0][mine]).all() and (alone[2] == shifted[2][mine] - 777).all() and (alone[3] == shifted[3][mine] - 777).all()
    assert (alone[3][:-1] + 1 == alone[2][1:]).all() and alone[2][0] == 0 and alone[3][-1] == len(text) - 100


def test_near_copies_with_edits(spark):
    """Windows that lie between two edits, and groups whose members share their left or their right side only."""
    rng = random.Random(3)
    base = prose(120, 50)
    texts = [base]
    for k in range(60):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(["x", "edited", "other words here", ""])
        texts.append(" ".join(words))
    texts += [prose(2, 900 + k) + " a line that very many texts hold, of some sixty bytes or so " + prose(2 + k % 5, 700 + k % 7) for k in range(80)]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(spark, list(enumerate(texts))).repartition(5)).collect()}
    for i, want in enumerate(brute([(i, t.encode()) for i, t in enumerate(texts)], 100)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def test_texts_beyond_a_piece(spark, monkeypatch):
    import numpy as np

    text = (prose(400, 6) + "a" * 700 + prose(300, 8)).encode()
    whole = repeats.triggers(np.frombuffer(text, np.uint8), np.array([len(text)]), 100)
    monkeypatch.setattr(repeats, "PLACE", 11)
    got = []
    for _, raw, ends, shift, low, end in repeats._pieces([b"short", text, text[:150]], 100):
        h, x, lo, hi = repeats.triggers(raw, ends, 100)
        of = np.searchsorted(ends, lo, "right")
        add = (shift - np.concatenate([[0], ends[:-1]]))[of]
        keep = (x + add >= low[of]) & (x + add < end[of])
        got += zip((x + add)[keep].tolist(), (lo + add)[keep].tolist(), (hi + add)[keep].tolist())
    starts = [s for _, a, b in got[: len(got)] for s in range(a, b + 1)]
    assert sorted(starts) == sorted([*range(len(text) - 99), *range(51)])
    assert all(0 <= x - b <= x - a <= 60 for x, a, b in got) and len(whole[0])


def test_orders_carry_over_partitions(spark):
    """Masks of a sorted column are those of one sequence, however it is cut into partitions."""
    rng = random.Random(4)
    wide = repeats.gram(100)
    strings = sorted({(b"t" * wide + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12)))) for _ in range(400)})
    rows = spark.createDataFrame([(s, b"", i, 0) for i, s in enumerate(strings)], "right binary, left binary, g long, place long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {bytes(r["right"]): r["m"] for r in repeats._ordered(rows, "right", "left", "m", 100).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for i, s in enumerate(strings):
        want, low = 0, 99
        for j in range(i + 1, len(strings)):
            low = min(low, int(repeats.common([strings[j - 1], strings[j]], 100)[1]) - wide)
            want |= 1 << low
        low = 99
        for j in range(i, 0, -1):
            low = min(low, int(repeats.common([strings[j - 1], strings[j]], 100)[1]) - wide)
            want |= 1 << low
        assert got[s] == want


def test_many_null_ids_are_told_apart_and_come_last(spark):
    """In the order of their texts' hashes; the greatest long is an id like others."""
    passage = prose(20, 77)
    texts = [prose(8, 100 + i) + passage + prose(8, 300 + i) for i in range(70)]
    rows = [(None, t) for t in texts] + [((1 << 63) - 1, passage), (None, texts[0])]
    df = docs(spark, rows)
    keyed = {bytes(r.raw).decode(): (r.t1, r.t2) for r in repeats._keyed(df, "doc_id", "text").collect()}
    order = [passage, *sorted(texts, key=keyed.__getitem__)]
    want = {t: w for t, w in zip(order, brute([(None, t.encode()) for t in order], 100))}
    got = repeats.remove_repeats(df, with_text=False).collect()
    assert sorted(((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)) == sorted([*want.values(), want[texts[0]]])
    assert [r.n_removed for r in got if r.doc_id == (1 << 63) - 1] == [0] and sum(r.doc_id is None for r in got) == 71

import random
from collections import defaultdict

import numpy as np

from sparkloom.llm import jaccard
from sparkloom.llm.shingles import shingle_set

from .helpers import docs, prose


def sets(texts, words_in=4):
    out = []
    for t in texts:
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({b" ".join(ws[i : i + words_in]) for i in range(len(ws) - words_in + 1)} if len(ws) >= words_in else {b" ".join(ws)} if ws else set())
    return out


def brute(ids, texts, percent=85):
    made = sets(texts)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if made[a] and made[b] and 100 * len(made[a] & made[b]) >= percent * len(made[a] | made[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), (min(least[find(k)]) if least[find(k)] else None) if s else i) for k, (i, s) in enumerate(zip(ids, made))), key=str)


def found(spark, rows, **how):
    return sorted((tuple(r) for r in jaccard.jaccard_components(docs(spark, rows).repartition(3), **how).collect()), key=str)


def changed(text, n, seed):
    rng, ws = random.Random(seed), text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def corpus():
    base, passage = prose(150, 1), prose(60, 2)
    texts = [changed(base, k % 4, k) for k in range(120)]
    texts += [prose(40, 100 + k) + " " + passage + " " + prose(30 + k % 50, 500 + k) for k in range(90)]
    texts += [passage + " " + prose(k % 12, 900 + k) for k in range(60)]
    texts += [None, "", " \t", "One", "one", "ONE two", "a b c", "a b c", "a b c d", "a b c d a b c d", prose(5000, 7), changed(prose(5000, 7), 60, 1), changed(prose(5000, 7), 200, 2), "x " * 3000]
    texts += [prose(20, 2000 + k % 7) + " " + prose(3, 3000 + k) for k in range(60)]
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    ids = [k * 3 % 10007 for k in range(len(texts))]
    want = brute(ids, texts)
    assert 5 < len({c for _, n, c in want if n}) < len(texts) - 50
    assert found(spark, list(zip(ids, texts))) == want


def test_small_blocks_and_frequent_shingles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    texts = corpus()
    ids = list(range(len(texts)))
    assert found(spark, list(zip(ids, texts)), block=16) == brute(ids, texts)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 0)
    assert found(spark, list(zip(ids, texts))[:200]) == brute(ids[:200], texts[:200])


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "z y x w"), (None, "z y x w"), (None, None), (9, None), (9, None), (2, "q r s t"), (None, "q r s t")]
    assert found(spark, rows) == brute([r[0] for r in rows], [r[1] for r in rows])
    assert found(spark, []) == []


def test_signatures_bound_overlap():
    rng = random.Random(1)
    for size in (1, 40, 300, 3000):
        a, b = shingle_set(prose(size, size), 4), shingle_set(changed(prose(size, size), size // 20, 3) + " " + prose(rng.randrange(size), 5), 4)
        x, y = (np.frombuffer(jaccard.signature(s), "<u8")[None] for s in (a, b))
        words = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(jaccard.fold(x, words) ^ jaccard.fold(y, words)).sum())
        true = len(np.setxor1d(a, b))
        assert apart <= true and (apart - true) % 2 == 0 and apart >= 0.4 * true


def test_every_linked_pair_shares_a_first_shingle():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 60, 2, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            last = np.unique(rng.choice(a, len(a) // 2))
            assert len(np.intersect1d(jaccard.prefix(a, 85, last), jaccard.prefix(b, 85, last)))

import random

import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.components import components

from .helpers import docs, prose


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, radius=3):
    root = {i: i for i in range(len(ids))}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(ids))]


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "Two words", "ÉTÉ Three WORDS here", prose(500), "a b c " * 400, "x\x1fy z w q"):
        assert simhash.fingerprint(text) == brute(text), text


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({f for b in base for n in range(5) for f in [b ^ sum(1 << x for x in rng.sample(range(64), n))]} | {0, 1, 7, 15, 2**64 - 1})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for radius in (0, 1, 2, 3):
        got = sorted((r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius).collect())
        want = sorted((min(x, y), max(x, y)) for i, x in enumerate(signed) for j, y in enumerate(signed[:i]) if (fps[i] ^ fps[j]).bit_count() <= radius)
        assert got == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 140)}, **{x: 200 for x in range(200, 209)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows():
    base = prose(300, 1)
    near = [base.replace("alpha", "alphb", 1), base + " tail"]
    return [(5, base), (3, near[0]), (9, near[1]), (9, near[1]), (4, prose(300, 2)), (7, None), (8, ""), (6, "Short text"), (11, "short TEXT"), (None, prose(80, 5)), (None, base), (12, "ünïcode wörds"), (4, prose(60, 8))]


def test_near_duplicates_against_brute_force(spark):
    data = rows()
    got = simhash.near_duplicates(docs(spark, data), 3).collect()
    fps = [brute(t) for _, t, *_ in data]
    of = groups(data, fps)
    want = []
    for k, (doc, *_) in enumerate(data):
        own = [d for j, (d, *_) in enumerate(data) if of[j] == of[k] and d is not None]
        want.append((doc, f"{fps[k]:016x}", min(own) if own else None))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    data = rows()
    df = docs(spark, data)
    kept = simhash.keep_one(df).collect()
    assert kept[0].asDict().keys() == set(df.columns)
    of = groups(data, [brute(t) for _, t, *_ in data])
    assert len(kept) == len(set(of))
    ids = sorted(str(r.doc_id) for r in kept)
    assert ids == sorted(map(str, [3, 4, 4, 6, 7, 12, None]))
    assert simhash.keep_one(docs(spark, [])).count() == 0

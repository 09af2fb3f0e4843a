import random

import corpus_pipeline
from sparkloom.llm import jaccard

from .helpers import docs, prose


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {b" ".join(words)} if words else set()


def alike(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def edited(text, edits, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(12)
    texts = [None, "", "One two", "one TWO", "a b c d e"]
    for k in range(25):
        base = prose(100 + 20 * (k % 5), k)
        texts += [base, base + " tail"] + [edited(base, e, rng) for e in (1, 2, 3, 6)]
    chain = prose(200, 999)  # each is alike the one before, not the first
    for _ in range(5):
        texts.append(chain)
        chain = edited(chain, 3, rng)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[5])]


def test_groups_against_brute_force(spark):
    rows = corpus()
    sets = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    want = sorted((str(i), str(min(x for x in g if x is not None))) for g in groups.values() for i in g)
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want and len(pairs) > 100
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_stage_drops_edited_copies(spark, tmp_path):
    """Copies of a similarity of 0.8 to 0.95, which differ in more than 3 bits of a fingerprint."""
    rng = random.Random(13)
    rows = [(2 * k + c, t) for k in range(40) for base in [prose(120, k)] for c, t in enumerate((base, edited(base, 2, rng)))]
    assert all(alike(brute(a), brute(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    kept = corpus_pipeline.remove_near_duplicates(spark, docs(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * k for k in range(40)]


def test_stage_takes_its_first_links_from_fingerprints(spark, tmp_path, monkeypatch):
    """The stage's groups by multi-index hashing reach the verification, edits that they miss are found, wrong groups change nothing."""
    import numpy as np
    import xxhash
    from pyspark.sql import functions as F

    from sparkloom.llm import simhash
    from sparkloom.llm.shingles import shingle_set

    rng, seen = random.Random(14), []
    rows = [(3 * k + c, t) for k in range(6) for base in [prose(400, k)] for c, t in enumerate((base, base + " end", edited(base, 8, rng)))]
    judged = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: seen.append(pairs) or judged(pairs, *a))
    table = docs(spark, rows)
    kept = corpus_pipeline.remove_near_duplicates(spark, table, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [3 * k for k in range(6)]
    node = {i: int(np.uint64(xxhash.xxh3_64_intdigest(shingle_set(t, 5).tobytes())).astype(np.int64)) for i, t in rows}
    want = {}
    for r in simhash.near_duplicates(table, words_in=5).collect():
        want.setdefault(r.group, set()).add(node[r.doc_id])
    pairs = {(r.a, r.b) for r in seen[0].collect()}
    want = [g for g in want.values() if len(g) > 1]
    assert want and all(tuple(sorted((min(g), n))) in pairs for g in want for n in g - {min(g)})
    one = table.select(F.xxhash64("text").alias("text_hash"), F.lit(1).cast("long").alias("group"))
    assert all(r.component_id == r.doc_id - r.doc_id % 3 for r in jaccard.near_duplicates(table, proposed=one).collect())

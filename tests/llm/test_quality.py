import math
import random
import re
from collections import Counter

from sparkloom.llm import quality

from .helpers import docs, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\n ", "one", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h " * 2, "x " * 100, prose(300), prose(40) + "\n" + prose(40), "line\nline\nline \n\n", "#*$%&|<> é日本 x\x1fy", "ab " * 3 + prose(50) + " ab" * 9]


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.quality(docs(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and not r.band_failed)


def test_bands_reject_repeats_and_noise_and_keep_prose(spark):
    rng = random.Random(5)
    words = [("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))) for _ in range(4000)]
    clean = [" ".join(rng.choice(words) for _ in range(n)) for n in (40, 200, 1500, 20000)]
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20)) for _ in range(400))
    import base64

    blob = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(200))
    cycle = " ".join(words[:30]) + " "
    part = clean[2] + " " + "zz yy xx " * 6000
    got = [r.band_failed for r in quality.quality(docs(spark, list(enumerate([*clean, noise, blob, cycle * 100, part])))).orderBy("doc_id").collect()]
    assert got[:4] == [False] * 4 and got[5:] == [True] * 3


def test_a_last_chunk_counts_and_so_do_texts_of_two_chunks(spark):
    rng = random.Random(6)
    words = [("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))) for _ in range(4000)]
    clean = " ".join(rng.choice(words) for _ in range(3000))
    texts = [clean[:4096] + "z" * 2500, clean[:6596], clean[:4096] + "z" * 700]
    got = [(r.outside, r.band_failed) for r in quality.quality(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == [(2500 / 6596, True), (0.0, False), (700 / 4796, False)]


def test_repeats_nulls_and_empty_table(spark):
    got = quality.quality(docs(spark, [(1, prose(50)), (1, prose(50)), (None, None)])).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 2
    assert quality.quality(docs(spark, [])).count() == 0


def test_fences_are_quartiles_of_classes(spark):
    """1,000 texts of one class and 150 of another: the first class's fence alone, and never below the stated band."""
    rng = random.Random(8)
    rows = [(10, 0, rng.gauss(0.5, 0.01)) for _ in range(990)] + [(10, 0, 0.05)] * 10 + [(12, 2, 0.4)] * 150 + [(3, 0, 1.5)] * 500 + [(11, 1, 0.3)] * 100 + [(11, 1, 0.6)] * 300
    got = {(r["size"], r.script): r.fence for r in quality.fences(spark.createDataFrame(rows, "size int, script int, ratio double")).collect()}
    own = sorted(math.floor(1000 * r) for s, _, r in rows if s == 10)
    q1, q3 = (own[math.ceil(len(own) * k / 4) - 1] / 1000 for k in (1, 3))
    assert set(got) == {(10, 0), (11, 1)}
    assert abs(got[10, 0] - (q1 - 3 * (q3 - q1))) < 1e-9 and abs(got[11, 1] - (0.3 - 3 * 0.3)) < 1e-9


def test_corpus_raises_the_lower_limit_for_its_own_lengths_and_scripts(spark):
    """Half repeated texts that the stated band lets pass fall beside 300 of prose; prose of another script stays."""
    rng = random.Random(9)
    latin, greek = (["".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(3000)] for a in ("etaoinshrdlu", "αβγδεζηθικλμ"))
    some = lambda words, n: [rng.choice(words) for _ in range(n)]
    half = [" ".join((some(latin, 12) * 4 + some(latin, 150))[:n] + some(latin, 1)) for n in (190, 198)]
    texts = [" ".join(some(latin, rng.randrange(190, 300))) for _ in range(300)] + [" ".join(some(greek, 150)) for _ in range(5)]
    rows = list(enumerate([*texts, *half, " ".join(some(latin, 20) * 2 + some(latin, 160))]))
    got = [r for r in quality.quality(docs(spark, rows), far=1.0).orderBy("doc_id").collect()]
    plain = [r for r in quality.quality(docs(spark, rows), support=10**6).orderBy("doc_id").collect()]
    assert not any(r.band_failed for r in plain)
    assert all(g.least >= p.least for g, p in zip(got, plain)) and {g.least for g in got[300:305]} == {p.least for p in plain[300:305]}
    assert all(r.band_failed for r in got[305:307]) and not any(r.band_failed for r in got[300:305])

import random

from sparkloom.llm import jaccard

from .helpers import docs, prose
from .test_jaccard import brute, changed, found
from .test_shingles import edited


def test_sets_that_wide_signatures_tell_apart_are_not_dealt(spark, monkeypatch):
    """Copies of seven edits (similarities of about 0.7) have room by narrow signatures, not by wide ones; links stay."""
    rng, base, dealt = random.Random(16), prose(400, 78), []
    rows = [(i, edited(base, 7, rng)) for i in range(80)] + [(100 + i, t) for i in range(4) for t in [prose(300, 200 + i // 2) + " end" * (i % 2)]]
    meet = jaccard._dealt

    def counted(tiles, more, *a):
        out = meet(tiles, more, *a)
        if "set" in more.columns:
            dealt.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", counted)
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(80)] + [(100, 100), (101, 100), (102, 102), (103, 102)]
    assert dealt and max(dealt) <= 8, dealt  # 80 at least if narrow ones deal them


def test_repeated_rows_and_null_ids_are_gathered_once(spark):
    rows = [(i, t) for i, t in ((None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "f g h i j k"))]
    table = docs(spark, rows).selectExpr("doc_id", "xxhash64(text) th", "text")
    asked = table.where("doc_id is null or doc_id = 5").distinct().selectExpr("doc_id d", "th t", "th node", "1L shared")
    got = jaccard._gathered(table, asked, 5).collect()
    assert sorted(len(r.set) for r in got) == [8, 16]


def test_small_blocks_of_wide_signatures_lose_nothing(spark, monkeypatch):
    base = prose(300, 5)
    texts = [changed(base, k % 12, k) for k in range(70)]
    monkeypatch.setattr(jaccard, "HELD", 1)
    assert found(spark, list(enumerate(texts)), block=16) == brute(list(range(70)), texts)

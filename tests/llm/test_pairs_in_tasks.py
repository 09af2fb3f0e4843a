import random

from sparkloom.llm import jaccard

from .helpers import docs, prose
from .test_shingles import alike, brute, edited


def test_near_copies_without_links_make_no_rows_for_pairs(spark, monkeypatch):
    """Texts of four edits link, most others of the same base do not, though signatures let them: rows stay as few as texts."""
    rng, base, made = random.Random(15), prose(400, 77), []
    rows = [(i, edited(base, 6 if i % 4 else 4, rng)) for i in range(80)]
    sets = [brute(t) for _, t in rows]
    pairs = [(a, b) for a in range(80) for b in range(a) if alike(sets[a], sets[b])]
    assert len(pairs) < 0.3 * 80 * 79 / 2
    root = list(range(80))
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    kept = jaccard.cut

    def counted(df):
        out = kept(df)
        if df.columns[:2] == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(root))
    assert made and max(made) <= 160, made

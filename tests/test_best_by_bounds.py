import random

import pytest

from sparkloom.operators import lexical as L
from sparkloom.operators import retrieval as R


@pytest.mark.parametrize("buckets", [1 << 18, 7])
def test_bounds_of_lengths_lose_none_of_the_best(spark, monkeypatch, buckets):
    """Fewer documents are scored to the end, and the ranking is that of all; repeated and null ids, ties and empty texts stay right."""
    monkeypatch.setattr(L, "BUCKETS", buckets)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    rows += [(300 + i, rows[i % 5][1]) for i in range(40)] + [(7, text(9)), (None, text(20)), (500, ""), (501, "w1")]
    docs = spark.createDataFrame(rows, "item_id long, text string")
    asked = spark.createDataFrame([(q, rows[q][1]) for q in range(6)] + [(6, "w1"), (7, "nowhere")], "query_id long, query_text string")
    every, some = L.tfidf_cosine(docs, asked), L.tfidf_cosine(docs, asked, 10)
    best = lambda scores: sorted(map(tuple, R.top_items(scores, 10).collect()))
    assert best(some) == best(every) and (buckets == 7 or some.count() < every.count())

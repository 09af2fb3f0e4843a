import itertools
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from sparkloom.llm import packing, tokens

from .helpers import docs, prose


def test_plans_hold_every_piece_and_fit():
    rng = random.Random(1)
    for trial in range(40):
        capacity = rng.choice([1, 2, 7, 50, 200])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 300, 3000])))
        plan = packing.pack_plan(counts, capacity)
        held = Counter()
        for items, m in plan:
            assert m > 0 and sum(items) <= capacity
            for x in items:
                held[x] += m
        assert held == counts
        bins, total = sum(m for _, m in plan), sum(k * v for k, v in counts.items())
        assert bins >= -(-total // capacity)
        if len(counts) > 20 and sum(counts.values()) > 1000:
            assert bins <= 1.05 * max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity)) + 1


def test_exact_complements_come_first():
    plan = packing.pack_plan({6: 2, 4: 1, 3: 1, 1: 1}, 10)
    assert sorted((tuple(sorted(i)), m) for i, m in plan) == [((1, 3, 6), 1), ((4, 6), 1)]


def test_index_of_sums_against_all_combinations():
    """Combinations are asked for and used up at random; the index finds one as long as any is left, and none that isn't."""
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.choice([5, 12, 24])
        c = [0] * (capacity + 1)
        for _ in range(rng.choice([2, 6, 30])):
            c[rng.randint(1, capacity - 1)] += 1
        index = packing.SumIndex(c, capacity)
        for _ in range(60):
            total = rng.randint(1, capacity - 1)
            own = [x for x in range(1, capacity) if c[x]]
            held = (rng.choice(own),) if own and rng.random() < 0.7 else ()
            left = Counter({x: c[x] for x in own}) - Counter(held)
            some = {n: [x for x in itertools.combinations_with_replacement(sorted(left), n) if sum(x) == total and not Counter(x) - left] for n in (1, 2, 3)}
            want = next((n for n in (1, 2, 3) if some[n]), None)
            got = index.fill(total, held)
            assert (got and len(got)) == want and (got is None or tuple(sorted(got)) in some[want])
            if got and rng.random() < 0.6:
                for x in got:
                    c[x] -= 1


def test_sequences_are_few_at_production_capacity():
    rng = random.Random(4)
    counts = Counter(min(2048, int(rng.lognormvariate(5.7, 0.9)) + 1) for _ in range(50000))
    bins, total = sum(m for _, m in packing.pack_plan(counts, 2048)), sum(k * v for k, v in counts.items())
    assert -(-total // 2048) <= bins <= 1.002 * -(-total // 2048) + 1


def test_piece_bounds():
    assert packing.piece_bounds(1, 4) == [(0, 1)] and packing.piece_bounds(4, 4) == [(0, 4)]
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)] and packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]


def test_packed_documents(spark):
    rows = [(i, prose(5 + 37 * i, i)) for i in range(12)] + [(20, None), (21, ""), (22, prose(900, 3)), (22, prose(900, 3)), (None, "x")]
    df = docs(spark, rows)
    args = tokens.public_paths()
    got = packing.pack(df, **args, capacity=64).toPandas()
    plain, want = Tokenizer.from_file(args["path"]), []
    for doc, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(-1 if doc is None else doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.piece_bounds(len(ids), 64))]
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.length.sum() <= 64 and list(seq.offset) == [0, *seq.length.cumsum()[:-1]]
    placed = packing.pack(df, **args, capacity=64)
    made = packing.sequences(placed, packing.token_pieces(df, **args, capacity=64)).collect()
    assert sum(len(r["ids"]) for r in made) == got.length.sum() and len(made) == got.sequence_id.nunique()
    assert packing.pack(docs(spark, []), **args).count() == 0

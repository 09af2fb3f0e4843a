import hashlib
import itertools
import random
import re
import zlib

from sparkloom.llm import catalog, repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, at long, k int, th string, first string, n long"
NONE = hashlib.sha256(b"").hexdigest()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, 8, 9, "t", "f", 1) for r in rows], SCHEMA).repartition(parts)


def exhaustive(inits, marks, most):
    """(cost, audit) over all edits with at most `most` inserts in a gap."""
    gaps = [g for n in range(most + 1) for g in itertools.product("ua", repeat=n)]
    best = None
    for letters in itertools.product(*[("D",) if m == "d" else ("K", "Ru", "Ra", "D") for m in marks]):
        for ins in itertools.product(gaps, repeat=len(inits) + 1):
            roles, audit, cost = "".join(ins[0]), "I" * len(ins[0]), 5 * sum(map(len, ins))
            for k, e in enumerate(letters):
                roles += {"K": inits[k], "D": "", "Ru": "u", "Ra": "a"}[e] + "".join(ins[k + 1])
                audit += e[0] + "I" * len(ins[k + 1])
                cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if marks[k] == "t" and e != "D" else 0)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def table_of_costs(inits, marks):
    """The same by relaxing (rows done, state) over and over until nothing falls."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, moved = {(0, 0): (0, "")}, True
    while moved:
        moved = False
        for (i, q), (c, a) in list(best.items()):
            for e in "KDuaUA":
                if e in "ua":
                    to, key = steps.get((q, e)), (c + 5, a + "I")
                    at = (i, to)
                elif i < len(inits):
                    late = 5 if marks[i] == "t" else 0
                    to = q if e == "D" else steps.get((q, inits[i] if e == "K" else e.lower()))
                    to = None if e != "D" and marks[i] == "d" else to
                    key, at = {"D": (c + 2, a + "D"), "K": (c + late, a + "K")}.get(e, (c + 1 + late, a + "R")), (i + 1, to)
                else:
                    continue
                if to is not None and (at not in best or key < best[at]):
                    best[at], moved = key, True
    return min(best[len(inits), q] for q in (0, 3) if (len(inits), q) in best)


def test_search_equals_all_edits_of_short_conversations():
    for n, most in ((0, 2), (1, 2), (2, 2), (3, 1)):
        for inits in itertools.product("sua ", repeat=n):
            for marks in itertools.product(".dt", repeat=n) if n < 3 else [random.Random(str(inits)).choices(".dt", k=3)]:
                (got,) = repair.repair("".join(inits), "".join(marks)).values()
                assert got == exhaustive(inits, marks, most) == table_of_costs(inits, marks), (inits, marks)


def test_blocks_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 30)
        inits, marks = "".join(rng.choices("suax", k=n)), "".join(rng.choices("....dt", k=n))
        (got,) = repair.repair(inits, marks).values()
        assert got == table_of_costs(inits, marks)


def brute(rows, damaged=False):
    """Each conversation's digest, row by row."""
    done = {}
    for conv, turn, role, text in rows:
        done.setdefault(conv, [])
        role, text, times = " " if role is None else role, " " if text is None else text, 1
        if not damaged:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            times, role = 2 if kind == 3 else 1, "user" if kind == 4 else role
        done[conv] += [(turn is not None, turn or 0, role, text)] * times
    out = {}
    for conv, own in done.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        inits = "".join(r[2][:1] or " " for r in own)
        turns = {r[1] for r in own if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = table_of_costs(inits, ["d" if f in ("blank", "duplicate") else "t" if f else "." for f in faults])
        said, i, state = [], 0, 0
        for e in audit:
            made = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            if e != "D":
                role, text = (made, "") if e == "I" else (own[i][2] if e == "K" else made, own[i][3])
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                said.append(f"{role}:{text}")
            i += e != "I"
        illegal = sum(inits[k : k + 2] not in ("su", "ua", "au") for k in range(len(inits) - 1))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello"), (2, 0, "assistant", "Alone."), (2, 5, "assistant", "Alone."), (3, None, "user", "First."), (3, 1, None, "Who."), (3, 1, "cy", ""), (3, None, "user", "First."),
    (None, 0, "user", "No id."), (None, None, "assistant", None), (4, 0, "é日", "ünï."), (4, 1, "", "y!\r\n\t"), (5, 3, None, None), (6, -2, "user", "x  "), (6, 9, "assistant", "Ok."),
]


def made(n, convs, seed):
    rng = random.Random(seed)
    return [(rng.choice(convs), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No!", "", None, "so", f"Word {rng.randrange(60)}."])) for _ in range(n)]


def check(spark, rows, parts, **how):
    df = table(spark, rows, parts)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.digest(df, df, repair.edits(df, **how)).collect()}
    assert got == brute(rows, damaged=True)


def test_digests_equal_brute_force(spark):
    check(spark, ROWS, 2)
    check(spark, made(400, [1, 2, 3, 4, 5, None], 2), 3)


def test_one_conversation_over_partitions_and_blocks(spark):
    rows = made(500, [9], 3)
    for longest in (3, 40):
        check(spark, rows + ROWS, 5, longest=longest)
    check(spark, rows, 4, longest_bytes=50)


def test_the_query_damages_rows(spark, tmp_path):
    rows = ROWS + [r for k in range(10, 60) for r in ((k, t, ("user", "assistant")[t % 2], f"Turn {t}. Done.") for t in range(6))] + [(70, 3, "user", "x.")]
    dropped = next(k for k in range(100, 200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in catalog.op11_repair(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got == want and want[dropped] == (0, 0, 0, 0, 0, 0, "", NONE)


def test_edits_carry_texts_and_an_empty_table_has_none(spark):
    got = sorted((r.at, r.k, r.edit, r.role, r.text) for r in repair.edits(table(spark, [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")], 1)).collect())
    assert [g[2:] for g in got] == [("D", "assistant", "A."), ("K", "user", "B."), ("R", "assistant", "C.")]
    empty = table(spark, []).limit(0)
    assert repair.digest(empty, empty, repair.edits(empty)).count() == 0

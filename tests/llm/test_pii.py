import hashlib
import random
import re

from sparkloom.llm import pii

from .helpers import docs, prose

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits(s)[::-1])) % 10 == 0


VALID = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(s), "phone": lambda s: 8 <= len(digits(s)) <= 15}


def brute(text):
    return [(k, m.start(), m.end()) for k, rx in BASE.items() for m in rx.finditer(text or "") if VALID[k](m[0])]


FIXED = [
    None, "", "mail a.b@c.d", "a@b.c_x@d.e", "a@b@c.d", "x@y", "é@b.co é", "1.2.3.4.5.6.7.8", "300.1.1.1.2.3", "0000255.1.1.000256", "9" * 400 + ".1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111",
    "41111111111111111111111", "+1 (988) 555-2485 x", "+12", "+1 ((((", "+1.2.3.4.5.6.7.8.9 +44-20-7946-0958.", "日本 1.2.3.4 日本 a@b.cd", "a" * 3000 + "@" + "b.c" * 900, "1 " * 3000, "1.1.1.1 " * 900, "+" * 50, "@" * 50,
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    texts = FIXED + ["".join(rng.choice(["a", "B", "1", "22", "4111111111111111", "@", ".", "-", " ", "+", "(", ")", "_", "é", "日"]) for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    got = {r.doc_id: r for r in pii.digest(pii.spans(docs(spark, list(enumerate(texts))))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t, listed, got[i])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))


def planted():
    """Known numbers behind a telling phrase, unseen ones behind the same, and the same shapes behind ordinary words."""
    rows = [(i, f"{prose(5, i)} please dial +1 (555) 555-{1000 + i} {prose(5, i + 99)}") for i in range(12)]
    rows += [(100 + i, f"{prose(5, i)} please dial 030 1234{560 + i} {prose(5, i)}") for i in range(3)]
    rows += [(200 + i, f"{prose(5, i)} serial number 030 9876{540 + i} and of the 12345678 {prose(3, i)}") for i in range(5)]
    rows += [(300 + i, f"of the +1 (555) 555-{2000 + i} and then of the day and of the night of the year of the sea") for i in range(6)]
    return rows


def test_contexts_discover_unseen_identifiers_and_leave_others(spark):
    got = {r.doc_id: r for r in pii.digest(pii.spans(docs(spark, planted()))).collect()}
    for i in range(3):
        text = dict(planted())[100 + i]
        at = text.index("030")
        assert got[100 + i].spans == f"phone:{at}:{at + 11}" and got[100 + i].n_phone == 0
    assert all(got[200 + i].spans == "" for i in range(5))


def test_a_second_round_finds_what_the_first_cannot(spark):
    """"please dial" is learnt from seeds and finds local numbers; those teach "extension:", which finds others."""
    rows = [(i, f"{prose(4, i)} please dial +1 (555) 555-{1000 + i} {prose(4, i + 99)}") for i in range(50)]
    rows += [(100 + i, f"{prose(4, i)} please dial 030 12345{60 + i} {prose(4, i + 50)}") for i in range(12)]
    rows += [(200 + i, f"{prose(4, i + 3)} extension:030 12345{60 + i} {prose(4, i + 70)}") for i in range(12)]
    rows += [(300 + i, f"{prose(4, i + 5)} extension:030 77755{10 + i} {prose(4, i + 20)}") for i in range(2)]
    rows += [(400, "order 030 9988776 was sent, order 030 9988775 too, and order 030 9988774 as well")]
    df = docs(spark, rows)
    found = pii.cut(pii.find(pii._keyed(df.select("doc_id", "text"), "doc_id", "text")))
    assert {r.value for r in pii.bootstrap(found, df).collect()} == {f"030 12345{60 + i}" for i in range(12)} | {"030 7775510", "030 7775511"}
    got = {r.doc_id: r for r in pii.digest(pii.spans(df)).collect()}
    assert got[300].n_spans == 1 and got[300].spans.startswith("phone:") and got[400].n_spans == 0


def accepted(spark, rows):
    df = docs(spark, rows)
    found = pii.cut(pii.find(pii._keyed(df.select("doc_id", "text"), "doc_id", "text")))
    got = pii.bootstrap(found, df)
    return set() if got is None else {r.value for r in got.collect()}


def test_a_pattern_of_few_seeds_never_confirms_itself(spark):
    rows = [(i, f"{prose(3, i)} reference +1 (555) 555-{1000 + i} {prose(3, i + 99)}") for i in range(22)]
    rows += [(100 + i, f"{prose(3, i)} reference 030 12345{10 + i % 30} {prose(3, i + 50)}") for i in range(78)]
    assert accepted(spark, rows) == set()


def test_a_chain_of_patterns_is_followed_to_its_end(spark):
    words = "amber birch cedar delta ember fjord grove heath inlet jetty".split()
    number = lambda k, j: f"030 55{'1234567890'[k]}6{'789'[j]}12"
    rows = [(i, f"{prose(3, i)} {words[0]} +1 (555) 555-{1000 + i} {prose(3, i + 99)}") for i in range(21)]
    for k in range(1, 11):
        rows += [(1000 * k + j, f"{prose(3, 7 * k + j)} {words[k - 1]} {number(k - 1, j)} {prose(3, k + j + 300)}") for j in range(3)]
        if k < 10:
            rows += [(1000 * k + 100 + i, f"{prose(3, 11 * k + i)} {words[k]} {number(k - 1, i % 3)} {prose(3, k + i + 600)}") for i in range(21)]
    assert accepted(spark, rows) == {number(k, j) for k in range(10) for j in range(3)}


def test_no_name_of_a_column_clashes(spark):
    names = ["_id", "_hash", "_clean", "_reach", "_s", "_d", "_t", "_row", "_own", "_base", "_maybe"]
    df = docs(spark, [(1, "mail a.b@c.de now"), (2, "nothing")]).select("doc_id", "text", "n_chars")
    wide = df.selectExpr("*", *[f"concat('v', doc_id, '{n}') AS `{n}`" for n in names])
    got = sorted(map(tuple, pii.redact(wide).collect()))
    assert got == [(1, "mail [EMAIL] now", 16, *[f"v1{n}" for n in names]), (2, "nothing", 7, *[f"v2{n}" for n in names])]


def test_redaction_keeps_columns_and_hides_all(spark):
    rows = planted() + [(401, "a.b@c.de and 4111111111111111"), (401, "a.b@c.de and 4111111111111111"), (402, None), (403, ""), (None, "x@y.zz é 1.2.3.4"), (404, "+1.2.3.4.5.6.7.8.9 x")]
    df = docs(spark, rows)
    got = pii.redact(df)
    assert got.columns == df.columns and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert [r.text for r in by[401]] == ["[EMAIL] and [CARD]"] * 2 and by[404][0].text == "[PHONE] x"
    assert by[None][0].text == "[EMAIL] é [IP]" and by[402][0].text is None and by[403][0].text == ""
    assert "030 1234" not in by[100][0].text and "030 9876" in by[200][0].text
    assert pii.redact(docs(spark, [])).count() == 0 and pii.spans(docs(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    r = pii.digest(pii.spans(docs(spark, [(1, text)]))).first()
    assert r.n_email == 3000 and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(text)).encode()).hexdigest()


def plain_redaction(text, spans):
    out, reach = [], 0
    for a, b, kind in sorted(spans):
        if a >= reach:
            out.append(text[reach:a] + f"[{kind.upper()}]")
        reach = max(reach, b)
    return "".join(out) + text[reach:]


def test_redaction_of_many_spans_keeps_all_text_between_them(spark):
    rng = random.Random(8)
    makes = [lambda i: f"u{i}@h{i}.org", lambda i: f"10.{i % 256}.3.4", lambda i: "4111 1111 1111 1111", lambda i: f"+44 20 7946 {i:04d}", lambda i: f"+1.2.3.4.5.6.7.{i:04d}"]
    made = lambda n: " ".join(f"{prose(2, i)} {rng.choice(makes)(i)} é" for i in range(n)) + " the end"
    texts = [made(n) for n in (1, 2, 3, 4, 5, 6, 9, 40)] + [made(4000)]
    df = docs(spark, list(enumerate(texts)))
    found = {r.doc_id: [(s["start"], s["end"], list(pii.KINDS)[s["kind"]]) for s in r.spans] for r in pii.spans(df).collect()}
    assert len(found[8]) >= 4000 and all(b > a for a, b, _ in found[8])
    for r in pii.redact(df).collect():
        assert r.text == plain_redaction(texts[r.doc_id], found[r.doc_id]) and r.n_chars == len(r.text)


def test_reach_is_the_greatest_end_of_all_earlier_spans(spark):
    rng = random.Random(9)
    lists = [[], [(0, 5)], [(0, 10000)] + [(i, i + 2) for i in range(1, 3000)]] + [sorted((a := rng.randrange(500), a + 1 + rng.randrange(90)) for _ in range(n)) for n in range(1, 60)]
    rows = [(i, [{"start": a, "end": b} for a, b in x]) for i, x in enumerate(lists)]
    got = spark.createDataFrame(rows, "i int, s array<struct<start:bigint,end:bigint>>").select("i", pii._reach(pii.F.col("s")).alias("r")).collect()
    for r in got:
        assert (r.r or []) == [max([0, *(b for _, b in lists[r.i][:k])]) for k in range(len(lists[r.i]))]

import math
import random

from pyspark.sql import functions as F

from sparkloom.llm import language

from .helpers import docs

PARTS = {"en": ["the", "thing", "ation", "ing", "with", "ough", "and"], "de": ["der", "sch", "und", "ung", "keit", "ich", "auf"], "fr": ["le", "eau", "que", "ment", "oux", "ère", "une"]}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rows = [(i, text(l, 60, i), l, f"{l}.example.org") for i in range(60) for l in PARTS for _ in [0]]
    return [(k, *r[1:]) for k, r in enumerate(rows)]


def test_held_out_accuracy_and_fusion(spark):
    held = [(1000 + i, text(l, 40, 1000 + i), None, "other.example.net") for i in range(20) for l in PARTS]
    wrong = [(2000 + i, text("de", 60, 5000 + i), "en", "de.example.org") for i in range(5)]
    odd = [(3000, None, "en", "en.example.org"), (3001, "", "en", None), (3002, "12345 !!! 678", "en", "en.example.org"), (3003, "กขฃค ฅฆงจ" * 30, None, "en.example.org"), (None, text("fr", 50, 9), "xx", None)]
    rows = corpus() + [(i, t, l, s) for i, (_, t, l, s) in zip(range(1000, 1060), held)] + wrong + odd
    got = {r.doc_id: r for r in language.identify_documents(docs(spark, rows)).collect()}
    want = {i: l for i, l in zip(range(1000, 1060), [l for i in range(20) for l in PARTS])}
    assert sum(got[i].language == l for i, l in want.items()) >= 57
    assert all(got[2000 + i].language == "de" for i in range(5))
    assert [got[i].rejected for i in (3000, 3001, 3002, 3003)] == [True] * 4
    assert not any(got[i].rejected for i in range(180)) and got[None].language == "fr"


def test_a_host_decides_where_the_text_is_silent(spark):
    """A word that no language knows: the host's prior remains."""
    rows = corpus() + [(5000, "mmm", None, "de.example.org"), (5001, "mmm", None, "fr.example.org")]
    got = {r.doc_id: r for r in language.identify_documents(docs(spark, rows)).collect()}
    assert got[5000].language == "de" and got[5001].language == "fr"


def brute_posterior(rows, names, weight=10.0, trust=50.0):
    """rows: (ll, declared, host); (language, confidence) of each by plain loops, a row's own counts left out."""
    n = len(names)
    best = lambda v: names[max(range(n), key=lambda k: (v[k], -k))]
    guess = [None if ll is None else best(ll[:n]) for ll, _, _ in rows]
    parts = [((h or "").lower().split(".")) for _, _, h in rows]
    levels = [[".".join(p[-k:]) for k in (1, 2, len(p))] for p in parts]
    out = []
    for i, (ll, d, _) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and guess[j] is not None]
        share = lambda rows_, above: [(sum(guess[j] == x for j in rows_) + weight * a) / (len(rows_) + weight) for x, a in zip(names, above)]
        prior = share(others, [1 / n] * n)
        for k in range(3):
            prior = share([j for j in others if levels[j][k] == levels[i][k] and levels[j][:k] == levels[i][:k]], prior)
        known = d if d in names else "-"
        post = []
        for k, x in enumerate(names):
            of = [j for j in others if guess[j] == x]
            same = sum((rows[j][1] if rows[j][1] in names else "-") == known for j in of)
            belief = 1.0 if known == "-" else 0.9 if known == x else 0.1 / max(1, n - 1)
            post.append(math.log(prior[k]) + math.log(max((same + trust * belief) / (len(of) + trust), 1e-6)) + (ll[k] if ll else 0.0))
        top = max(post)
        out.append((best(post), 1 / sum(math.exp(p - top) for p in post)))
    return out


def test_posterior_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.de", "b.de", "x.b.de", "c.org", "C.org", None, "localhost", "y.c.org"]
    rows = [(i, text(l := rng.choice(list(PARTS)), rng.randrange(0, 12), i), rng.choice([l, l, "en", None, "zz"]), rng.choice(hosts)) for i in range(150)] + [(200, None, "de", "a.de"), (201, "", None, None), (7, "the the", "en", "a.de"), (7, "the the", "en", "a.de")]
    df = docs(spark, rows)
    model = language.train(df, F.col("text"), F.col("lang"))
    lls = {(r.doc_id, r.text): r._ll for r in language.text_evidence(df.select("doc_id", "text"), F.col("text"), model).collect()}
    want = brute_posterior([(lls[i, t], l, h) for i, t, l, h in rows], model[0])
    got = language.identify_documents(df).collect()
    key = lambda i, l, h: (i, str(l), str(h))
    mine = sorted((key(i, l, h), w) for (i, _, l, h), w in zip(rows, want))
    theirs = sorted((key(r.doc_id, r.declared, r.host), (r.language, r.confidence)) for r in got)
    assert [k for k, _ in mine] == [k for k, _ in theirs]
    for (_, (lang, sure)), (_, (l, c)) in zip(mine, theirs):
        assert abs(sure - c) < 1e-6 and (lang == l or sure < 0.5 + 1e-6), [(k, a, b) for (k, a), (_, b) in zip(mine, theirs) if abs(a[1] - b[1]) > 1e-6]


def test_a_host_of_one_page_does_not_confirm_itself(spark):
    rows = corpus() + [(5000, text("de", 30, 1), None, "alone.example.net")]
    got = {r.doc_id: r for r in language.identify_documents(docs(spark, rows)).collect()}
    assert got[5000].language == "de"
    counts = brute_posterior([([0.0, 0.0, 0.0], None, "one.net"), ([9.0, 0.0, 0.0], None, "two.net")], ["de", "en", "fr"])
    assert abs(counts[1][1] - math.exp(9) * (1 / 3 * 10 + 1) / 11 / (math.exp(9) * (1 / 3 * 10 + 1) / 11 + 2 * (10 / 3) / 11)) < 0.1


def test_keep_identified_keeps_rows_and_columns(spark):
    df = docs(spark, corpus() + [(1, corpus()[1][1], "de", "x"), (1, corpus()[1][1], "de", "x"), (2, None), (3, "...")])
    got = language.keep_identified(df)
    assert got.columns == df.columns and got.count() == len(corpus()) + 2
    assert language.keep_identified(docs(spark, [])).count() == 0 and language.identify_documents(docs(spark, [])).count() == 0


def test_pages(spark):
    page = lambda l, i: (i, f"https://{l}.site.{ {'en': 'org', 'de': 'de', 'fr': 'fr'}[l] }/p/{i}", f'<!DOCTYPE html><html lang="{l}"><head><script>var x = "the the the";</script></head><body><p>{text(l, 40, i)}</p></body></html>')
    rows = [page(l, i) for i in range(30) for l in PARTS] + [(90, None, None), (91, "not a url", "<p></p>")]
    got = language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.language == r.declared for r in got if r.page_id < 30) and all(r.rejected for r in got if r.page_id >= 90)


def test_pages_with_repeats_clashing_columns_and_none(spark):
    schema = "page_id long, url string, html string, _ll string, host string, declared string, text string, l string"
    one = (5, "https://x.org/", f"<HTML data-x=1 lang='de-AT'><p>{text('de', 60, 3)}</p>", "a", "b", "c", "d", "e")
    got = language.identify_pages(spark.createDataFrame([one, one, (6, None, "<html lang=de>" + text("de", 50, 4), *"abcde"), (None, "", "", *"abcde")], schema)).collect()
    assert [r.declared for r in got if r.page_id == 5] == ["de", "de"] and len(got) == 4
    assert len({(r.language, r.confidence, r.rejected) for r in got if r.page_id == 5}) == 1 and [r.rejected for r in got if r.page_id is None] == [True]
    assert language.identify_pages(spark.createDataFrame([], schema)).count() == 0


def test_parts_of_addresses(spark):
    row = spark.createDataFrame([("https://u@Blog.Example.co.uk:80/x?y",)], "u string").select(language.url_host(F.col("u")).alias("h"))
    got = row.select(*[c.alias(n) for n, c in zip("sdh", language.address_parts(F.col("h")))]).first()
    assert (got.s, got.d, got.h) == ("uk", "co.uk", "blog.example.co.uk")


def test_every_declared_language_is_fitted(spark):
    """80 languages of their own syllables; the rarest would be past any 64 most declared."""
    rng = random.Random(21)
    parts = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for k in range(80)}
    made = lambda l, n: " ".join("".join(rng.choice(parts[l]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    langs = [l for k, l in enumerate(parts) for _ in range(12 if k < 70 else 6)]
    rows = [(i, made(l, 60), l, "h.example.org") for i, l in enumerate(langs)]
    rows += [(5000 + k, made(f"l{k:02d}", 60), None, "h.example.org") for k in range(70, 80)]
    got = {r.doc_id: r for r in language.identify_documents(docs(spark, rows)).collect()}
    assert all(got[i].language == l and not got[i].rejected for i, l in enumerate(langs))
    assert all(got[5000 + k].language == f"l{k:02d}" and not got[5000 + k].rejected for k in range(70, 80))
    assert language.keep_identified(docs(spark, rows)).count() == len(rows)

"""Each check of two worlds on facts made to fail it alone."""

from __future__ import annotations

import pytest

from sparkloom.operators import worlds as W

FACT = dict(fact_id=1, head="Aspirin", mid="Enzyme A", relation="treats", tail="Head-Ache", other="Gout", question="What does it treat?")


def run(spark, fact=None, edges=None, texts=None, aliases=(), more=()):
    f = {**FACT, **(fact or {})}
    facts = spark.createDataFrame([f, *more], "fact_id long, head string, mid string, relation string, tail string, other string, question string")
    if edges is None:
        edges = [("original", "Aspirin", "binds", "Enzyme A"), ("original", "Enzyme A", "treats", "Head-Ache"), ("counterfactual", "Aspirin", "binds", "Enzyme A"), ("counterfactual", "Enzyme A", "treats", "Gout")]
    e = spark.createDataFrame([(w, i, s, r, o) for w, s, r, o, i in [x if len(x) == 5 else (*x, 1) for x in edges]], "world string, fact_id long, subject string, relation string, object string")
    texts = [("a", "Enzyme A treats Gout."), ("b", "Enzyme A treats Gout")] if texts is None else texts
    t = spark.createDataFrame([("counterfactual", i, n, x) for n, x, i in [y if len(y) == 3 else (*y, 1) for y in texts]], "world string, fact_id long, form string, text string")
    a = spark.createDataFrame(list(aliases), "name string, alias string")
    return W.fact_checks(facts, e, t, a), f


def failed(spark, **kw):
    checks, _ = run(spark, **kw)
    row = next(r for r in checks.collect() if r.fact_id == 1).asDict()
    return {k for k, v in row.items() if k != "fact_id" and v != k.startswith("s")}


OTHERS = [dict(fact_id=2, head="x", mid="y", relation="z", tail="zzz", other="qqq", question="?")]
BASE = [("original", "Aspirin", "binds", "Enzyme A"), ("original", "Enzyme A", "treats", "Head-Ache"), ("counterfactual", "Aspirin", "binds", "Enzyme A"), ("counterfactual", "Enzyme A", "treats", "Gout")]


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, set()),
        (dict(texts=[("a", "It treats HEAD ache, they say"), ("b", "Enzyme A treats Gout at times")]), {"l1_surface"}),
        (dict(texts=[("a", "It treats migraine"), ("b", "It treats Gout")], aliases=[("head ache", "Migraine"), ("gout", "podagra"), (None, "x"), ("head ache", None)]), {"l2_alias"}),
        (dict(texts=[("a", "Gout treats Enzyme A"), ("b", "Enzyme A treats Gout")]), {"l3_inverse"}),
        (dict(texts=[("a", "x y"), ("a", "an ache: head-ache", 2)], more=OTHERS), {"l4_elsewhere"}),
        (dict(texts=[("a", "x y"), ("a", "an ache of the head", 2)], more=OTHERS), set()),
        (dict(fact=dict(question="Does it treat head ache?")), {"l5_prompt"}),
        (dict(edges=[*BASE, ("original", "Enzyme A", "stops", "Head-ache", 2), ("counterfactual", "Enzyme A", "stops", "head ache", 2)]), {"p1_path"}),
        (dict(edges=[*BASE, ("original", "Enzyme A", "treats", "Migraine", 2), ("counterfactual", "Enzyme A", "treats", "migraine", 2)], aliases=[("head ache", "Migraine")]), {"p2_renamed"}),
        (dict(edges=BASE[:3]), {"s1_size", "s2_tail", "s4_degree"}),
        (dict(edges=[*BASE[:3], ("counterfactual", "Enzyme A", "cures", "Gout")]), {"s2_tail"}),
        (dict(edges=[*BASE, BASE[3]]), set()),  # a repeated edge is one
        (dict(edges=[*BASE, ("original", "Enzyme A", "stops", "x", 2)]), {"s4_degree"}),
        (dict(texts=[("a", "one two three four five"), ("b", "one two three four")]), {"s3_tokens"}),
        (dict(texts=[], edges=[]), {"s1_size", "s2_tail", "s3_tokens", "s4_degree"}),
        (dict(fact=dict(tail=None, question=None)), set()),
        (dict(texts=[("a", None)]), set()),
    ],
)
def test_one_check_at_a_time(spark, kw, want):
    assert failed(spark, **kw) == want


def test_summary_counts_failures(spark):
    checks, _ = run(spark, fact=dict(question="head ache?"))
    got = {r.check: (r.facts, r.failures, r.passed) for r in W.summary(checks).collect()}
    assert got["l5_prompt"] == (1, 1, False) and got["l1_surface"] == (1, 0, True) and got["s1_size"] == (1, 0, True)

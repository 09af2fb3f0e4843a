"""What readers see of artifacts behind one manifest, whatever ends between two writes."""

from __future__ import annotations

import pytest

from sparkloom.operators import publication as P
from sparkloom.sources.shared import shared_folder

SCHEMA = "doc_id long, version long, payload string"


def rows(spark, version, ids=(1, 2)):
    return spark.createDataFrame([(i, version, f"{i}v{version}") for i in ids], SCHEMA)


@pytest.fixture
def target(spark):
    p = P.Publication(spark, shared_folder(spark, "pub"))
    for a in p.artifacts:
        p.stage(1, a, rows(spark, 1))
    p.publish(1)
    return p


def seen(p):
    return {a: sorted((r.doc_id, r.version, r.payload) for r in p.read(a).collect()) for a in p.artifacts}


OLD = {a: [(1, 1, "1v1"), (2, 1, "2v1")] for a in P.ARTIFACTS}
NEW = {a: [(1, 2, "1v2"), (2, 2, "2v2")] for a in P.ARTIFACTS}


def test_nothing_published(spark):
    p = P.Publication(spark, shared_folder(spark, "pub"))
    assert p.manifest().count() == 0


def test_half_a_publication_is_not_seen_and_can_be_resumed(spark, target):
    for n, a in enumerate(target.artifacts):
        target.stage(2, a, rows(spark, 2))
        assert seen(target) == OLD
        if n < 3:
            with pytest.raises(ValueError, match="2 documents"):
                target.publish(2)
    target.write_manifest(2, rows(spark, 2))  # and the driver is lost here
    assert seen(target) == OLD
    assert target.garbage("graph").count() == 2
    target.stage(2, "cache", rows(spark, 2))  # a retry leaves no repeated rows
    target.publish(2)
    assert seen(target) == NEW
    assert sorted(r.payload for r in target.garbage("cache").collect()) == ["1v1", "2v1"]


def test_one_document_moves_on_and_the_other_stays(spark, target):
    for a in target.artifacts:
        target.stage(2, a, rows(spark, 2, ids=(2,)))
    snapshot = target.manifest()
    target.publish(2)
    assert sorted((r.doc_id, r.version) for r in target.read("dense").collect()) == [(1, 1), (2, 2)]
    assert sorted((r.doc_id, r.version) for r in target.read("dense", snapshot).collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("bad", [[(1, 2, "x"), (1, 2, "x")], [(1, 2, "x"), (1, 3, "x")], [(1, 3, "x")], [(None, 2, "x")], []])
def test_documents_that_are_not_whole_stop_a_publication(spark, target, bad):
    for a in target.artifacts[:3]:
        target.stage(2, a, rows(spark, 2, ids=(1,)))
    target.stage(2, "cache", spark.createDataFrame(bad, SCHEMA))
    with pytest.raises(ValueError):
        target.publish(2)
    assert seen(target) == OLD


def test_break_even(spark):
    from sparkloom.operators.versioning import break_even

    e = spark.sql("SELECT 'd' AS domain, timestamp '2024-01-01' + make_interval(0, 0, 0, id) AS ts, 'p' AS protocol, 86400D AS seconds, id % 2 = 0 AS error FROM range(5)")
    e = e.unionByName(e.limit(1).selectExpr("'single' AS domain", "ts", "protocol", "seconds", "error"))
    r = break_even(e, [2.0], 20.0).collect()
    assert [(x.domain, x.updates_per_day, x.error_seconds, x.break_even_qps, x.errors_per_day, x.applicable) for x in r] == [("d", 1.25, 51840.0, 1.5e-05, 129600.0, True)]
    clean = break_even(e.selectExpr("domain", "ts", "protocol", "seconds", "false AS error"), [2.0], 20.0).collect()
    assert [(x.break_even_qps, x.errors_per_day, x.applicable) for x in clean] == [(None, 0.0, False)]

"""Folds on small documents whose answers are known."""

import datetime as dt
import random

import pytest

from caseloom.operators import limits, registry

MENTION = "doc_id long, start int, stop int, rank int, entity_type string, text string, confidence double"


def rows(spark, *m):
    return spark.createDataFrame([(1, a, a + len(t), n, k, t, c) for n, (a, k, t, c) in enumerate(m)], MENTION)


def test_similar_mentions_are_one_entity(spark):
    m = rows(spark, (0, "PARTY", "Acme Holdings", 0.8), (50, "PARTY", "Acme Holding", 0.6), (100, "PARTY", "Zeta", 0.9), (1500, "PARTY", "acme holdings", 0.7), (20, "COURT", "Acme Holdings", 0.5))
    got = {(r.entity_type, r.canonical): (r.occurrences, round(r.confidence, 6), r.chunks) for r in registry.merged(registry.resolve(m)).collect()}
    assert got == {("PARTY", "acme holdings"): (3, 0.7, [0, 1]), ("PARTY", "zeta"): (1, 0.9, [0]), ("COURT", "acme holdings"): (1, 0.5, [0])}
    assert {(r.text, r.n) for r in registry.fuzzy_clusters(m.filter("entity_type = 'PARTY'")).collect()} == {("Acme Holdings", 3), ("Zeta", 1)}


def test_every_entity_of_a_type_is_compared(spark):
    """A variant may carry a mention whose length is far from that of the canonical form; otherwise as by brute force."""
    m = rows(spark, (0, "PARTY", "Jonathan S", 0.8), (50, "PARTY", "Jonathan Smith", 0.8), (100, "PARTY", "Jonathan Smithson", 0.8))
    assert [(r.canonical, r.occurrences, r.variants) for r in registry.resolve(m).collect()] == [("jonathan s", 3, ["jonathan s", "jonathan smith", "jonathan smithson"])]
    r = random.Random(5)
    texts = ["".join(r.choice("abé𝒜") for _ in range(r.randint(0, 12))) for _ in range(300)]
    for threshold in (0.85, 0.7):
        entities = []
        for t in texts:
            score, _, e = max(((registry.similarity(t, "A", e), -e["entity"], e) for e in entities), default=(0, 0, None), key=lambda x: x[:2])
            own = e if score >= threshold else None
            if own is None:
                own = {"entity": len(entities), "entity_type": "A", "canonical": t, "variants": []}
                entities.append(own)
            own["variants"] += [t] * (t not in own["variants"])
        got = registry.resolve(rows(spark, *((i, "A", t, 0.8) for i, t in enumerate(texts))), threshold).collect()
        assert {(x.entity, x.canonical, tuple(x.variants)) for x in got} == {(e["entity"], e["canonical"], tuple(sorted(e["variants"]))) for e in entities}


def test_two_lists_and_overlaps(spark):
    a, b = rows(spark, (0, "A", "alpha beta", 0.6)), rows(spark, (0, "A", "alpha beta", 0.9), (2, "A", "pha", 0.9), (40, "A", "far", 0.1))
    assert [(r.text, r.confidence) for r in registry.merge_two(a, b).collect()] == [("alpha beta", 0.9), ("pha", 0.9), ("far", 0.1)]
    assert sorted(r.text for r in registry.without_overlaps(b).collect()) == ["alpha beta", "far"]


def test_references_look_back(spark):
    m = rows(spark, (0, "PARTY", "Ann Lee", 1.0), (10, "COURT", "High Court", 1.0), (20, "PARTY", "she", 1.0), (30, "COURT", "the court", 1.0), (40, "DATE", "the date", 1.0))
    assert [r.refers_to for r in registry.references(m).orderBy("start").collect()] == [None, None, "Ann Lee", "High Court", None]


def test_circuit_opens_waits_and_closes(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [(0, False), (1, False), (2, True), (70, True), (71, True), (72, True)]
    log = spark.createDataFrame([("u", at(s), n, ok) for n, (s, ok) in enumerate(calls)], "u string, ts timestamp, event_id int, success boolean")
    got = limits.circuit(log, "u", 2, 60.0, 2).orderBy("event_id").collect()
    assert [r.state for r in got] == ["closed", "closed", "open", "half_open", "half_open", "closed"] and [r.allowed for r in got] == [True, True, False, True, True, True]


def test_delay_follows_the_mean(spark):
    log = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 0, n), n, 300.0) for n in range(4)], "mode string, ts timestamp, event_id int, ms double")
    assert [r.delay_ms for r in limits.delays(log, "mode", 200.0).orderBy("event_id").collect()] == [0.0, 0.0, pytest.approx(10.0), pytest.approx(20.0)]


def test_batches_of_pages(spark):
    pages = spark.createDataFrame([(1, n, k) for n, k in enumerate(["high"] * 4 + ["low"] * 8)], "doc_id long, page int, complexity string")
    got = [r.batch for r in registry.page_batches(pages).orderBy("page").collect()]
    assert got == sorted(got) and [got.count(n) for n in range(4)] == [2, 4, 4, 2]

"""Graphs to their fixpoint, and the guard with its encodings, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import graph, obfuscation, scanners
from vigilframe.plans import rules
from vigilframe.plans.golden import CASES, OBFUSCATED


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reach(pairs, start):
    seen, front = {start}, [start]
    while front:
        x = front.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                front.append(b)
    return seen


def test_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)]
    got = {r.node: r.hops for r in graph.reachable(edges(spark, chain), spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(61)}
    assert graph.reachable(edges(spark, chain), spark.createDataFrame([(0,)], "node long"), hops=5).count() == 6
    assert {r.component for r in graph.labels(edges(spark, chain)).collect()} == {0}
    assert graph.on_cycles(edges(spark, [(i, i + 1) for i in range(150)])).count() == 0


def test_cycles(spark):
    """Two cycles, a way between them, ways in and out, a loop, and a cycle within a chain."""
    pairs = [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 20), (20, 21), (21, 20), (21, 30), (0, 1), (40, 40), (41, 42), (50, 51), (51, 52), (52, 51)]
    assert {r.node for r in graph.on_cycles(edges(spark, pairs)).collect()} == {1, 2, 3, 20, 21, 40, 51, 52}
    r = random.Random(3)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(55)]
    want = {x for x in range(40) if any(a == x and x in reach(pairs, b) for a, b in pairs)}
    assert {x.node for x in graph.on_cycles(edges(spark, pairs)).collect()} == want
    assert graph.on_cycles(edges(spark, [])).count() == 0


def test_every_encoding_is_found(spark):
    frame = spark.createDataFrame(list(OBFUSCATED) + [(-300, None, None)], "id long, text string, kind string")
    got = {r.id: {h.kind for h in r.hidden} for r in obfuscation.obfuscation(frame).collect()}
    assert all((k in got[i]) if k else not got[i] for i, _, k in OBFUSCATED) and got[-300] == set()
    kinds = {k for _, _, k in OBFUSCATED if k}
    assert kinds == {"base64", "hex", "rot13", "unicode_escape", "leetspeak", "zero_width", "concatenation", "charcode", "homoglyph"}


def test_the_default_guard_looks_into_encodings(spark):
    frame = spark.createDataFrame(list(OBFUSCATED), "id long, text string, kind string")
    got = {r.id: r for r in scanners.guard(frame).collect()}
    for i, _, kind in OBFUSCATED:
        names = {f.name for f in got[i].findings if f.scanner == "obfuscation"}
        assert (kind in names) if kind else not names
    assert not any(f.scanner == "obfuscation" for r in scanners.guard(frame, hidden=False).collect() for f in r.findings)
    assert got[-201].blocked and not got[-211].blocked


def test_guard_on_few_rules_and_many(spark):
    """The verdict on a text doesn't depend on which other rules are asked for."""
    frame = spark.createDataFrame([(i, t) for i, t, _ in CASES] + [(1, None), (2, "")], "id long, text string")
    whole = {r.id: sorted((f.name, f.start, f.stop) for f in r.findings if f.scanner == "pii") for r in scanners.guard(frame).collect()}
    few = {r.id: sorted((f.name, f.start, f.stop) for f in r.findings) for r in scanners.guard(frame, rules=rules.PII).collect()}
    assert whole == few and any(few.values())


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_blocked_terms(spark, n):
    texts = [(1, "Aaaa bb Straße"), (2, "xABx ab"), (3, ""), (4, None), (5, "a")]
    terms = ["", None, "AB", "a", "aaa", "straße", "zz", "bb s", "ab"][:n] + ["b"]
    got = {(r.id, r.term): r.n for r in scanners.blocked_terms(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), keep=("id",)).collect()}
    want = {(i, t.lower()): (x or "").lower().count(t.lower()) for i, x in texts for t in terms if t}
    assert got == {k: v for k, v in want.items() if v}


def test_spread_leaves_large_tables_alone(spark):
    assert scanners.spread(spark.range(100, numPartitions=64)).rdd.getNumPartitions() == 64
    assert scanners.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scanners.spread(spark.range(0).select(F.lit("x").alias("t"))).count() == 0

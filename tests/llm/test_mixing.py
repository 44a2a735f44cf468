"""Mixing at sizes where nothing is broadcast and with many sources."""

from collections import Counter

import numpy as np

from tracemill.llm import mixing


def drawn(df):
    return Counter((r.doc_id, r.source, r.text) for r in df.collect())


def test_same_mix_without_broadcasts(spark, monkeypatch):
    """Shuffled joins give the rows that broadcasts give, and texts pass two exchanges: to their decision and to their shard."""
    docs = spark.range(900).selectExpr("if(id % 50 = 0, null, id % 700) as doc_id", "concat('text', id % 700, repeat(' w', cast(id % 40 as int))) as text", "concat('s', id % 3) as source", "id as extra")
    with_broadcasts = mixing.mixed_documents(spark, docs, block_words=300, shards=7)
    want = drawn(with_broadcasts)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        mixed = mixing.mixed_documents(spark, docs, block_words=300, shards=7)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        got = drawn(mixed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and sum(got.values()) > 0
    assert sum("Exchange" in line and "Broadcast" not in line for line in plan.splitlines()) == 3  # rows, decisions, shards


def test_many_sources(spark, monkeypatch):
    """Few nodes of the tree on the driver where sources are many; every source near its target, no document above its limit."""
    monkeypatch.setattr(mixing, "TOP_QUOTAS", 5000)
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(5 + id % 7 as int)) as text", "concat('s', id % 2000) as source")
    got = mixing.mix_sources(spark, docs, block_words=10, shards=16).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size == r.size * 3 and sum(d["words"] for d in r.draws or []) == r.taken
    assert len(goal) == 2000 and all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    assert {d["shard"] for r in got for d in r.draws or []} == set(range(16))


def test_tree_of_many_shards():
    """Counts of every shard come one at a time, and their sums are the quotas; an empty list of sources is dealt too."""
    quotas = np.array([5, 0, 4000, 17, 100_000])
    total, n = np.zeros(5, np.int64), 0
    for counts in mixing.split_tree(quotas, 3000, 9):
        total, n = total + counts, n + 1
        assert 0 <= counts.sum() <= 36
    assert n == 3000 and (total == quotas).all()
    assert [c.tolist() for c in mixing.split_tree(np.array([], np.int64), 3, 1)] == [[], [], []]


def test_empty_documents_in_shards(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_documents(spark, docs, shards=3).count() == 0 == mixing.mix_sources(spark, docs, shards=3).count()

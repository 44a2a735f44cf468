"""Verdicts and best-of rows against the tables that they sum up."""

from collections import defaultdict

from tracemill.jobs import analysis, texts

SF = "/root/testdata/sf0.01"


def test_three_verdicts(spark):
    got = {r.pilot: (r.n, r.passes) for r in texts.verdicts(spark, SF).collect()}
    pairs = defaultdict(list)  # of model and embedding
    for r in analysis.vector_features(spark, SF).collect():
        pairs[r.model_name, r.embedding_model].append(r.n_transitions > 0)
    found = sum(100 * sum(x) / len(x) > 50 for x in pairs.values())
    significant = sum(r.significant for r in analysis.embedding_effects(spark, SF).collect())
    third = texts.verdict(spark, SF).first()
    assert got == {1: (found, found > 0), 2: (significant, significant > 0), 3: (third.models_with_signal, third.passes)}


def test_best_by_p(spark):
    tests = analysis.feature_tests(spark, SF).collect()
    n = {m: sum(r.model_name == m and r.note is None and r.p < 0.05 for r in tests) for m in {r.model_name for r in tests}}
    want = [(m, n[m], i) for i, m in enumerate(sorted(n, key=lambda m: (-n[m], m)), 1)]
    assert sorted((r.model_name, r.n_significant, r.place) for r in analysis.best_by_p(spark, SF).collect()) == sorted(want)

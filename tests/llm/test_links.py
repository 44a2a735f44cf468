"""Links that chance would leave: large families of edited copies against brute force."""

import random

import numpy as np

from tracemill.llm.minhash import near_duplicates


def components(texts, size, percent):
    """The smallest text number that each text reaches, by all pairs."""
    vocabulary, sets = {}, []
    for t in texts:
        w = t.split()
        sets.append({vocabulary.setdefault(tuple(w[i : i + size]), len(vocabulary)) for i in range(len(w) - size + 1)})
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(vocabulary), 4000):
        m = np.zeros((len(sets), 4000), np.float32)
        for i, s in enumerate(sets):
            m[i, [x - lo for x in s if lo <= x < lo + 4000]] = 1
        common += m @ m.T
    n = np.array([len(s) for s in sets])
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    least = np.arange(len(sets))
    while True:
        new = np.array([least[row].min() for row in linked])
        if (new == least).all():
            return least.tolist()
        least = new


def test_family_of_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(153)]

    def edited(words, places):
        out = list(words)
        for p in places:
            out[p] = f"e{rng.random()}"
        return out

    # each text is 0.6 to 0.79 alike to nearly all others; some have one partner at 0.8
    family = [edited(base, rng.sample(range(4, 149), 4)) for _ in range(1200)]
    family += [edited(w, [20 + k, 60 + k, 100 + k, 140 + k]) for k, w in enumerate(family[:5])]
    family += [edited(w, [20, 60, 100, 140]) for w in family[100:400]]
    rng.shuffle(family)
    texts = [" ".join(w) for w in family]
    want = components(texts, 4, 80)
    assert 300 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, docs, 4, 80).collect()}
    assert [got[i] for i in range(len(texts))] == want

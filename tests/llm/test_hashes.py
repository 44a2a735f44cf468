"""Words and passages that a sum of powers can't tell apart, and hashes of spans."""

from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tracemill.llm import kernels as K


def thue_morse(k, a="a", b="b"):
    word = a
    other = b
    for _ in range(k):
        word, other = word + other, other + word
    return word, other


WORDS = [thue_morse(10), thue_morse(11), thue_morse(12, "ab#", "ba#"), thue_morse(11, "########aaaaaaaa", "########bbbbbbbb")]


@pytest.mark.parametrize("pair", range(len(WORDS)))
def test_alternating_words(spark, pair):
    """Two long words, one the other's complement, in texts that are otherwise equal or have nothing else in common."""
    from tracemill.llm.decontaminate import find_matches, judged
    from tracemill.llm.minhash import near_duplicates
    from tracemill.llm.substring_dedup import repeated_words
    from tracemill.llm.suffix_dedup import repeated_bytes
    from tracemill.llm.token_output import encoder

    one, two = WORDS[pair]
    body = " ".join(f"w{i}" for i in range(34))
    made = [(1, f"{body} {one}"), (2, f"{body} {two}"), (3, one), (4, two)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    rows = lambda df, *c: Counter(tuple(r) for r in df.select(*c).collect())
    assert rows(repeated_words(spark, docs), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeated_words(made, 35))
    assert rows(repeated_bytes(spark, docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeated_bytes(made, 100))
    found = {r.doc_id: r.component_id for r in near_duplicates(spark, docs).collect()}
    assert found[3] != found[4]
    bench = [(0, f"{body} {one}"), (1, f"{body} {two}")]
    got = judged(find_matches(spark, docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()) == Counter((d, n, h, i) for d, n, h, i, *_ in brute.contamination(made, bench))
    import public_tokenizers

    tool = encoder(public_tokenizers.path("word_bpe_49k.json"))
    for _, text in made:
        data = np.frombuffer(text.encode(), np.uint8)
        assert tool.encode(data, np.array([0, len(data)]))[0].tolist() == tool.whole(text)


def test_words_of_sequences_that_alternate(spark):
    """The same with words in the place of letters: passages of words that are each other's complements."""
    from tracemill.llm.minhash import near_duplicates
    from tracemill.llm.substring_dedup import repeated_words

    one, two = (t.replace("a", " left").replace("b", " right") for t in thue_morse(11))
    made = [(1, one), (2, two)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeated_words(spark, docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == Counter(brute.repeated_words(made, 35))
    short = spark.createDataFrame([(1, " left right right"), (2, " right left left")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(spark, short).collect()} == {1, 2}


def test_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    limb = K.limbs(data)
    for size in (1, 4, 8, 9, 24, 100):
        at = np.arange(len(data) - size + 1)
        grams = K.byte_grams(limb, size)
        assert (grams == K.byte_hashes(data, limb, at, at + size)).all()
        seen = {}
        for i in at.tolist():
            assert seen.setdefault(int(grams[i]), data[i : i + size].tobytes()) == data[i : i + size].tobytes()
        assert len(seen) == len({data[i : i + size].tobytes() for i in at.tolist()})
    codes = rng.integers(0, 3, 500).astype(np.uint64)
    for size in (1, 3, 8):
        at = np.arange(len(codes) - size + 1)
        assert (K.word_grams(codes, size) == K.code_hashes(codes, at, at + size)).all()
    assert len(K.byte_grams(K.limbs(data[:5]), 9)) == 0 and len(K.word_grams(codes[:2], 4)) == 0


def test_unit_table():
    table, held = K.UnitTable(longest=20), {}
    rng = np.random.default_rng(2)
    for _ in range(5):
        data = rng.integers(97, 100, 4000).astype(np.uint8)
        starts = np.arange(0, 3990, 7)
        ends = starts + rng.integers(1, 9, len(starts))
        ends[::50] = starts[::50] + 25
        number, new = table.find(data, starts, np.minimum(ends, 4000))
        for n, s, e in zip(number.tolist(), starts.tolist(), np.minimum(ends, 4000).tolist()):
            word = data[s:e].tobytes()
            assert (n < 0) == (len(word) > 20)
            if n >= 0:
                assert held.setdefault(n, word) == word
        assert len(table) == len(held) == len(set(held.values()))
    assert len(table.find(data[:0], starts[:0], ends[:0])[0]) == 0

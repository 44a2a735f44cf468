"""Token counts against the library on whole texts."""

import random
import tracemalloc
from collections import Counter as Bag

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import kernels
from tracemill.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tools():
    return T.load(PATH), T.Counter(PATH, T.prove_whole(PATH), T.unsettled())


def count(counter, *texts):
    found = counter.texts(pa.array(texts, pa.string())).tolist()
    return found[0] if len(texts) == 1 else found


def plain(tool, text):
    return len(tool.encode(text or "", add_special_tokens=False).ids)


def test_op12(spark, edge):
    from tracemill.llm.queries import QUERIES

    tool, table = T.load(PATH), edge[1]["documents"]
    want = Bag((d, len((t or "").encode()), n := plain(tool, t), n > 1024) for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    got = QUERIES["op12_token_counts"](spark, edge[0])
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and Bag(map(tuple, got.collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|", " ", "  \n", "don't", "'s", "'S", " 12345", " ", "\x1c", " ", "é́", "😀", "𞀀", "中文字", " \U00010940x", "࢏", "a՘ "])), max_size=12).map("".join))
def test_same_as_library(tools, text):
    tool, counter = tools
    assert count(counter, text) == plain(tool, text)


def test_settled_code_points_are_cut_alike(tools):
    """Every code point that is not encoded whole has the same class in both libraries: behind a letter, a digit and a stop."""
    import regex

    cut, new, cutter = regex.compile(T.PRE_TOKENS), regex.compile(T.unsettled()), tools[0].pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not new.match(chr(c))]
    assert len(points) > 200_000
    for lo in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)}1{chr(c)}.{chr(c)}\n" for c in points[lo : lo + 20_000])
        assert [o for _, o in cutter.pre_tokenize_str(text)] == [m.span() for m in cut.finditer(text)]


def test_proof(tools):
    whole = T.prove_whole(PATH)
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole and " the" in whole
    assert all(plain(tools[0], w) == 1 for w in random.Random(1).sample(whole, 500))
    assert not T.prove_whole(public_tokenizers.path("word_bpe_49k.json"))


def test_other_tokenizer(spark, edge):
    path, table = public_tokenizers.path("word_bpe_49k.json"), edge[1]["documents"]
    tool = T.load(path)
    got = T.count_tokens(spark, spark.read.parquet(f"{edge[0]}/documents.parquet"), path)
    assert Bag(r.n_tokens for r in got.collect()) == Bag(plain(tool, t) for t in table["text"].to_pylist())


def test_long_texts(tools, monkeypatch):
    """Pieces give what the whole gives, a long word too, and a long text's temporaries are those of a piece."""
    tool, counter = tools
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n\n", "x" * 300, "1", ".", "'s", "<|endoftext|>", "😀", "\u3000", "é"]) for _ in range(3000))
    with monkeypatch.context() as m:
        m.setattr(kernels, "BLOCK_BYTES", 50)
        assert count(counter, text) == plain(tool, text)
    long = "some words of a text " * 500_000
    tracemalloc.start()
    assert count(counter, long) == 5 * 500_000 + 1
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    counter = T.Counter(PATH, T.prove_whole(PATH), T.unsettled())
    words = [f"zq{i}qz" for i in range(100)]
    assert all(count(counter, w) == plain(counter.tool, w) for w in words) and len(counter.table) <= 12


def test_units_of_equal_hash(monkeypatch):
    """Units that share a hash are told apart by content."""
    monkeypatch.setattr(kernels, "byte_hashes", lambda data, limb, starts, ends: (ends - starts).astype("uint64") % 3)
    counter = T.Counter(PATH, T.prove_whole(PATH), T.unsettled())
    texts = ["some words of many kinds, told apart", "others, of like length. and short", "", "words words"] * 2
    assert count(counter, *texts) == [plain(counter.tool, t) for t in texts]

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.config import ABBREVIATIONS, MARKERS, STATES
from tracemill.functions import text as X
from tracemill.operators import sampling
from tracemill.operators.markers import marker_densities


def apply(spark, texts, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def plain_sentences(text, least=5):
    if len(text.strip()) < 10:
        return []
    text = text.replace("\r\n", "\n")
    for mark in (r"\*\*(.+?)\*\*", r"\*(.+?)\*"):
        text = re.sub(mark, r"\1", text)
    long_enough, out = lambda s: len(s.split()) >= least, []
    for para in re.split(r"\n\s*\n", text):
        para = para.strip()
        for a in ABBREVIATIONS:
            para = para.replace(a, a.replace(".", X.DOT))
        para = re.sub(r"(?<=\d)\.(?=\d)", X.DOT, para)
        for s in re.split(r"(?<=[.!?。！？])\s+(?=[A-Z一-鿿])|(?<=[.!?。！？])\s*\n", para):
            s = s.replace(X.DOT, ".").strip()
            if long_enough(s):
                out += [i.strip() for i in re.split(r"\n\s*(?=\d+[.)]\s|-\s|\*\s|•\s)", s) if long_enough(i)]
    return out


def test_sentences(spark):
    hand = [
        "", "short", "One two three four five. Six seven eight nine ten.", "See Dr. Smith about it now. It is 3.5 mg. Take it with water e.g. At noon today.", "**Bold words here are kept** and *so are these words*. Next one has five words.",
        "First line has five words.\nsecond line has five words\n\nThird para has five words here.", "Items come in this list:\n- one two three four five\n- six seven eight nine ten\n1. a b c d e\n2) f g h i j", "a b c d e.\r\nf g h i j.\r\n\r\nk l m n o",
        "No break space counts as a space here. Yes it does so indeed.", "这是一个没有空格的句子。另一个句子也是。", "五 个 字 的 句。 又 五 个 字 的 句！ A b c d e?", "  \n  padded one two three four five  \n ",
    ]
    rng = random.Random(3)
    bits = ["word", "Word", "Dr.", "3.14", ". ", "! ", "?\n", "\n\n", "\n- ", "\n2. ", " ", " ", " a ", "**b** ", "*c* ", "。 ", "中", "\r\n", "e.g. ", " "]
    texts = hand + ["".join(rng.choice(bits) for _ in range(rng.randrange(4, 90))) for _ in range(300)]
    assert apply(spark, texts, X.sentences) == [plain_sentences(t) for t in texts]


def test_markers(spark):
    texts = ["No, that", "No,that", "wait, Wait! WAIT waiting", "I'm not sure, it seems likely", None, "", "could be could be"]
    for category, patterns in MARKERS.items():
        want = [sum(len(re.findall(p, t or "", re.I)) for p in patterns) for t in texts]
        assert apply(spark, texts, lambda c, p=patterns: X.marker_count(c, p)) == want


def test_states(spark):
    texts = ["Wait, therefore", "First, maybe; thus so the answer", "nothing here", "Let me check: Hmm", "It could be possible, thus", "no"]

    def plain(t):
        scores = {s: sum(bool(re.search(p, t, re.I)) for p in ps) for s, ps in STATES.items()}
        return max(scores, key=scores.get) if any(scores.values()) else "neutral"

    assert apply(spark, texts, lambda c: X.sentence_state(c, STATES)) == [plain(t) for t in texts]


def test_densities(spark):
    base = "x" * 45
    rows = [(i, i % 2 == 0, t) for i, t in enumerate([base + " Wait", base + "  Wait", "Wait " + "y" * 60, "a" * 29 + " Wait " + "b" * 29, "y" * 60 + " perhaps maybe"])]
    df = spark.createDataFrame(rows, "q int, is_correct boolean, thinking_text string")
    got = {(r.q, r.region, r.category): (r["count"], r.density) for r in marker_densities(df, ["q"]).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4}  # more than 50 characters only
    assert got[2, "early", "revise"][0] == 1 and got[2, "late", "revise"][0] == 0
    assert got[3, "all", "revise"][0] == 1 and got[3, "early", "revise"][0] + got[3, "late", "revise"][0] == 0  # cut in two
    assert got[1, "all", "revise"][1] == pytest.approx(1000 / 51) and got[1, "late", "revise"][1] == pytest.approx(1000 / 25)
    assert got[4, "all", "TOTAL"][1] == pytest.approx(got[4, "all", "hedge"][1])


def plain_block_cut(t, least=50):
    for size in range(200, least - 1, -10):
        for start in range(len(t) - 2 * size):
            block = t[start : start + size]
            if t.count(block) >= 3 and (second := t.find(block, start + size)) > 0:
                return t[: second + size].strip()
    return t


def test_repeated_blocks(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    texts = ["", "x" * 99, "x" * 100, "x" * 149, "x" * 150, "x" * 151, "é" * 700]
    for _ in range(25):
        b = make(rng.randrange(45, 230))
        texts.append(make(rng.randrange(30)) + "".join(b + make(rng.randrange(12)) for _ in range(rng.randrange(2, 5))) + make(20))
    assert apply(spark, [*texts, None], X.remove_repetitions) == [*(plain_block_cut(t) if len(t) >= 100 else t for t in texts), None]


def test_repeated_answers(spark):
    section = "\n### Final Answer\nThe answer is B.\n"
    t = "Some thinking that is long enough to be looked at, at least a hundred characters of it in all, I think."
    box = "so \\\\boxed{A} it is. "
    got = apply(spark, [t + section * 3, t + section * 2, t + box * 4, t + box * 3, "### Final Answer " * 4], X.remove_repetitions)
    assert got == [(t + section).strip(), t + section * 2, t + "so \\\\boxed{A} it is. so \\\\boxed{A}", t + box * 3, "### Final Answer " * 4]
    assert apply(spark, [t + box.replace("\\\\", "\\") * 4], lambda c: X.cut_boxed(c, 1)) == [t + "so \\boxed{A} it is. so \\boxed{A}"]


def test_split_thinking(spark):
    long = "z" * 101
    cases = [
        ("<think> a b </think> c", True, "a b", "c"), ("<think> a b </think> c", False, "<think> a b </think> c", "<think> a b </think> c"), ("<think> open\n\nrest", True, "<think> open", "rest"),
        (long + "\nThe most likely answer is B", False, long, "The most likely answer is B"), ("short\n## Answer x\n\n" + long + "\n## Answer y", False, "short\n## Answer x", long + "\n## Answer y"),
        (long + "\n**Answer** b\n# Conclusion c", False, long, "**Answer** b\n# Conclusion c"), (" one only ", False, " one only ", "one only"), ("a\n\nb\n\nc", False, "a\n\nb", "c"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, t string, tags boolean")
    got = [(r.s.thinking, r.s.answer) for r in df.select("i", X.split_thinking(F.col("t"), F.col("tags")).alias("s")).orderBy("i").collect()]
    assert got == [c[2:] for c in cases]


def test_predicted_option(spark):
    cases = {"so \\boxed{C} or A": "C", "The answer is diabetes": "D", "ANSWER: **(b)": "B", "I say **D)** here": "D", "A) first\nB": "A", "(E). yes": "E", "It is A or maybe C then": "C", "nothing": None, "x" * 500 + " B": None, "": None}
    assert apply(spark, list(cases), X.predicted_option) == list(cases.values())
    assert apply(spark, ["<|im_start|><think>a</think><|end|> b"], X.drop_special_tokens) == ["<think>a</think> b"]


def test_options_and_prompt(spark):
    df = spark.createDataFrame([({"B": "two", "A": "one"}, "B"), ({"A": "x"}, "D")], "o map<string,string>, a string")
    got = df.select(X.options_text(F.col("o")), X.option_value(F.col("o"), F.col("a")), X.fill("Q {t} {o}", t=F.lit("?"), o=X.options_text(F.col("o")))).collect()
    assert [tuple(r) for r in got] == [("A) one\nB) two", "two", "Q ? A) one\nB) two"), ("A) x", "?", "Q ? A) x")]


def test_samples_and_steps(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 3 > 0, "big").otherwise("small"))
    a, b = (sorted(r.id for r in sampling.fixed_sample(x, "id", 20, 42).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 20 and sampling.fixed_sample(df, "id", 5000, 42).count() == 1000
    assert a != sorted(r.id for r in sampling.fixed_sample(df, "id", 20, 43).collect())
    got = sampling.stratified_sample(df, "s", "id", 30, 1).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"big": 30, "small": 30}
    t = "one two three four five six seven eight nine ten. However this is a second step of at least ten words in all.\n\nshort"
    assert [len(x) for x in apply(spark, [t], sampling.reasoning_steps)] == [2]
    assert apply(spark, ["I initially thought A, but B. I first thought C but D", "none", None], sampling.abandoned) == [2, 0, 0]

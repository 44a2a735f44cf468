"""Words of a lexicon are found in one pass, as their patterns find them one by one."""

import random

from pyspark.sql import functions as F

from tracemill.config import COMMON_MARKERS, COMMON_STATES, MARKERS, STATES, whole_words
from tracemill.functions import text as X
from tracemill.jobs import texts
from tracemill.operators import markers

SF = "/root/testdata/sf0.001"
PIECES = ["that", "THIS", "thiſ", "İs", "ıs", "was", "not", "as", "are", "area", "by", "or", "for", "with", "with_", "bé", "be", "é", "-", "'", "_", "1", "\n", ".", "from", "baſ", "ís"]


def made(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(12)))) for i in range(3000)]
    return spark.createDataFrame([*rows, (3000, None), (3001, "")], "pos long, sentence string")


def test_words_as_patterns(spark):
    d, s = made(spark), F.col("sentence")
    lexicon, states = whole_words(COMMON_MARKERS), whole_words(COMMON_STATES)
    assert X.whole_word_list(lexicon["hedge"]) == ["that", "this"] and X.whole_word_list(MARKERS["hedge"]) is None and X.whole_word_list([r"\bis\b"] * 2) is None
    plain = {k: [*ps, r"\bqqq qqq\b"] for k, ps in lexicon.items()}  # a pattern that is no word, and never matches
    rows = d.select("pos", X.marker_counts(s, lexicon).alias("a"), F.array(*[X.marker_count(s, ps) for ps in lexicon.values()]).alias("b"),
                    X.sentence_state(s, states).alias("c"), X.sentence_state(s, {k: [*ps, r"\bqqq qqq\b"] for k, ps in states.items()}).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and sum(map(sum, (r.a for r in rows))) > 1000
    both = [sorted(map(tuple, markers.marker_positions(d.withColumn("k", F.lit(1)), ["k"], x).collect())) for x in (lexicon, plain)]
    assert both[0] == both[1] and both[0]


def test_one_pass_for_all_words(spark):
    t = F.col("sentence")
    for c, most in ((X.sentence_state(t, whole_words(COMMON_STATES)), 1), (X.marker_counts(t, whole_words(COMMON_MARKERS)), 1), (X.sentence_state(t, STATES), 99)):
        plan = made(spark).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert 1 <= plan.count("regexp_extract_all") + plan.count("rlike") <= most


def test_marker_table_reads_whole_texts_only(spark):
    plan = texts.marker_table(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "early" not in plan and "late AS" not in plan


def test_white_space_at_the_ends(spark):
    white = [chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    d = spark.createDataFrame([(w + " a" + w + "b " + w,) for w in white] + [(" " + chr(c) + "x" + chr(c),) for c in (0x1F, 0x180E, 0x200B, 0xFEFF)], "t string")
    old = F.regexp_replace("t", r"(?U)^\s++|(?<!\s)\s++$", "")
    assert [r.a for r in d.select(X.strip(F.col("t")).alias("a")).collect()] == [r.a for r in d.select(old.alias("a")).collect()]


def test_boundaries_begin_at_white_space(spark):
    old = r"(?U)(?<!\s)\s*\n\s*\n\s*|(?<=[.!?。！？])\s+(?=[A-Z一-鿿])|(?<=[.!?。！？])\s*\n\s*"
    rng = random.Random(4)
    rows = [("".join(rng.choice([".", "!", "。", " ", " ", "\n", "\n", "\r", "　", "A", "b", "中", "1"]) for _ in range(rng.randrange(40))),) for _ in range(5000)]
    r = spark.createDataFrame(rows, "t string").select((F.split("t", old, -1) == F.split("t", X._BETWEEN, -1)).alias("same")).agg(F.bool_and("same").alias("same")).first()
    assert r.same and X._BETWEEN.startswith(r"(?U)(?=\s)")

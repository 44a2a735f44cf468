"""Every query on small tables with all edge cases against a plain version, and on empty tables."""

import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracemill.llm.queries import ORACLE_SQL, QUERIES


def pairs(table, a, b):
    return list(zip(table[a].to_pylist(), table[b].to_pylist()))


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def docs_of(edge):
    return pairs(edge[1]["documents"], "doc_id", "text")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, edge, name):
    con = duckdb.connect()
    for t in edge[1]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{edge[0]}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, edge[0])
    if name == "op1_exact_dedup":  # null doc_ids: SQL has null for kept
        got, want = got.filter("doc_id is not null"), want.filter("doc_id is not null")
    got, want, columns = rows(got, *want.columns), Counter(want.fetchall()), want.columns
    if name != "op1_exact_dedup" and "doc_id" in columns:  # the SQL joins on doc_id: documents with one of their own
        once = {d for d, n in Counter(d for d, _ in docs_of(edge)).items() if n == 1 and d is not None}
        got, want = ({k: n for k, n in x.items() if k[columns.index("doc_id")] in once} for x in (got, want))
    assert got == want


def test_op1_null_ids(spark):
    from tracemill.llm.exact_dedup import digest

    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in digest(spark, spark.createDataFrame([(None, "A"), (3, "a"), (None, "b"), (None, "c"), (None, "C")], "doc_id long, text string")).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), (None, None, 2, True)}


def test_op2(spark, edge):
    got = rows(QUERIES["op2_suffix_dedup"](spark, edge[0]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute.repeated_bytes(docs_of(edge), 100))


def test_op4(spark, edge):
    got = rows(QUERIES["op4_substring_dedup"](spark, edge[0]), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(brute.repeated_words(docs_of(edge), 35))


@pytest.mark.parametrize("hot", [10**9, 3])
@pytest.mark.parametrize("alphabet", ["ab", "abé x", "a"])
def test_windows_of_few_symbols(spark, alphabet, hot):
    import random

    from tracemill.llm.substring_dedup import repeated_words
    from tracemill.llm.suffix_dedup import repeated_bytes

    rng = random.Random(len(alphabet))
    made = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 9, 30, 60])))) for i in range(60)] + [(100 + i, "xyabcabcab" * 3 + str(i) + "abcdefghijk") for i in range(12)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(repeated_bytes(spark, df, 9, 4, hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeated_bytes(made, 9))
    made = [(i, " ".join(t)) for i, t in made]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(repeated_words(spark, df, 9, 4, hot), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeated_words(made, 9))


def plain_targets(sizes):
    """Targets by water filling: the level at which weight * level, cut at three times the size, sums to all words."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, lo, hi = sum(sizes), 0.0, float(sum(sizes)) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, w * mid) for s, w in zip(sizes, weight)) < total else (lo, mid)
    return [min(3 * s, w * hi) for s, w in zip(sizes, weight)]


def test_op3(spark, edge):
    got = QUERIES["op3_mixing"](spark, edge[0]).collect()
    again = QUERIES["op3_mixing"](spark, edge[0]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    table = edge[1]["documents"]
    size = {}
    for s, t in pairs(table, "source", "text"):
        size[s] = size.get(s, 0) + len(brute.SPACE.findall((t or "").encode()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip([size[s] for s in order], plain_targets([size[s] for s in order])))
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-3
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - goal[r.source_size]) < 1e-3
        assert r.taken == sum(d["words"] for d in r.draws or []) == r.size * r.copies + r.cut_words
        taken[r.source_size] += r.taken
    assert len(got) == table.num_rows and all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    cuts = Counter(r.source_size for r in got if r.cut_words)
    assert max(cuts.values()) == 1


def test_op3_shards(spark):
    """Many shards and strata: every block in one place, shards of like size, no draw lost."""
    from tracemill.llm import mixing

    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 60 as int)) as text", "concat('s', if(id % 3 = 0, 0, id % 5)) as source")
    kept = mixing.STRATUM_BLOCKS, mixing.TOP_NODES
    mixing.STRATUM_BLOCKS, mixing.TOP_NODES = 16, 8
    try:
        got = mixing.mix_sources(spark, docs, block_words=500, shards=50).collect()
        mixed = mixing.mixed_documents(spark, docs, block_words=500, shards=50)
        assert mixed.rdd.getNumPartitions() == 50
        words = mixed.selectExpr("spark_partition_id() as p", "size(split(trim(text), ' ')) as n").groupBy("p").sum("n").collect()
    finally:
        mixing.STRATUM_BLOCKS, mixing.TOP_NODES = kept
    shards = Counter()
    for r in got:
        for d in r.draws or []:
            shards[d["shard"]] += d["words"]
    assert {r["p"]: r["sum(n)"] for r in words} == dict(shards) and len(shards) == 50
    mean = sum(shards.values()) / 50
    assert max(shards.values()) < 2 * mean and sum(r.taken for r in got) == sum(shards.values())
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    assert all(abs(sum(r.taken for r in got if r.source == s) - t) <= 1 for s, t in zip(sorted(sizes), plain_targets([sizes[s] for s in sorted(sizes)])))


def test_shares_and_tree():
    import numpy as np

    from tracemill.llm.mixing import shares, split_tree

    assert shares([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert shares([10, 190], [5, 1]) == pytest.approx([30, 170])
    assert shares([0, 5], [5, 2]) == [0, 5] and shares([], []) == []
    counts = np.stack(list(split_tree(np.array([7, 0, 100, 1]), 8, 3)))
    assert (counts.sum(axis=0) == [7, 0, 100, 1]).all() and (counts >= 0).all() and counts.sum(axis=1).max() <= 14


def test_op5(spark, edge):
    got = rows(QUERIES["op5_decontaminate"](spark, edge[0]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter(brute.contamination(docs_of(edge), pairs(edge[1]["benchmark"], "item_id", "text")))


def test_op5_in_blocks(spark, edge):
    from tracemill.llm.common import read_table
    from tracemill.llm.decontaminate import find_matches, judged

    found = judged(find_matches(spark, read_table(spark, edge[0], "documents"), read_table(spark, edge[0], "benchmark"), block_bytes=500))
    want = Counter((d, n, h, i) for d, n, h, i, *_ in brute.contamination(docs_of(edge), pairs(edge[1]["benchmark"], "item_id", "text")))
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()) == want


def test_op5_longest(spark):
    """For every test suffix that begins a match its longest one in the document, against all pairs of places."""
    import random

    from tracemill.llm.decontaminate import find_matches

    rng = random.Random(12)
    bench = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([4, 9, 30, 30, 3, 0])]
    docs = [(i, " ".join(rng.choice("abcd" if i % 3 else "abc") for _ in range(rng.choice([0, 2, 5, 40, 90])))) for i in range(40)] + [(50, "a " * 60), (51, f"{bench[2][1]} d {bench[3][1]}")]
    found = find_matches(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), window=5, longest=True)
    got = {(r.doc_id, m["item"], m["item_start"], m["words"]) for r in found.collect() for m in r.matches}
    at = {(r.doc_id, m["item"], m["item_start"]): m["start"] for r in found.collect() for m in r.matches}
    want, texts, tests = set(), dict(docs), dict(bench)

    def common(w, v):
        return next((n for n, (x, y) in enumerate(zip(w, v)) if x != y), min(len(w), len(v)))

    for d, t in docs:
        w = t.split()
        for i, u in bench:
            v, before = u.split(), 0
            for o in range(len(v)):
                n = max((common(w[p:], v[o:]) for p in range(len(w))), default=0)
                n = n if n >= min(5, len(v)) and (len(v) >= 5 or o == 0) else 0
                if n and before != n + 1:
                    want.add((d, str(i), o, n))
                before = n
    assert got == want and len(want) > 50
    for d, i, o, n in got:
        p = at[d, i, o]
        assert texts[d].split()[p : p + n] == tests[int(i)].split()[o : o + n]


def test_op5_one_repeated_word():
    """Half a million equal words against an item of five thousand: linear in both."""
    import time
    import tracemalloc

    import numpy as np

    from tracemill.llm.decontaminate import TestSuffixes, shard

    block = TestSuffixes(["0"], ["word " * 5000], 13)
    data = np.frombuffer(b"word " * 500_000, np.uint8)
    began = time.time()
    tracemalloc.start()
    for longest in (False, True):
        count, hits, items, matches = shard(block, data, np.array([0, len(data)]), longest)
        assert count.tolist() == [500_000] and hits == [[(0, 500_000)]] and items == [["0"]]
    assert matches[0] == [{"item": "0", "item_start": 0, "start": matches[0][0]["start"], "words": 5000}]
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_op7_repeated_ids_and_other_tokenizers(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracemill.llm.token_output import encoder, tokens_of

    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    first, second = (Counter(tuple(r) for r in tokens_of(spark, docs.repartition(k, "text")).collect()) for k in (2, 3))
    assert first == second
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert encoder(public_tokenizers.path("word_bpe_49k.json")).by_units and not encoder(path).by_units
    tool, texts = Tokenizer.from_file(path), {d: t for d, t in docs_of(edge) if d is not None}
    unique = {d for d, n in Counter(d for d, _ in docs_of(edge)).items() if n == 1 and d is not None}
    got = {r.doc_id: r.n_tokens for r in tokens_of(spark, docs.filter("doc_id is not null"), path).collect() if r.doc_id in unique}
    assert got == {d: len(tool.encode(texts[d] or "", add_special_tokens=False).ids) + 1 for d in unique}


def test_op8_repeated_ids(spark):
    """Rows of one doc_id are one node: 9 is linked with one text of 5, 5's other text with 1."""
    from tracemill.llm.minhash import near_duplicates

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    made = [(1, a), (5, a + " z"), (5, b), (9, b + " z"), (7, c), (None, a), (None, None), (5, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), 4, 80).collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (9, 1, False)]


def test_op7(spark, edge):
    import public_tokenizers

    got = QUERIES["op7_token_output"](spark, edge[0])
    unique = [d for d, n in Counter(d for d, _ in docs_of(edge)).items() if n == 1]
    want = brute.tokens(docs_of(edge), public_tokenizers.path("word_bpe_49k.json"))
    keep = lambda found: Counter((d, n, c) for d, _, n, c in found)  # noqa: E731  rows of one doc_id come in any order
    found = [tuple(r) for r in got.collect()]
    assert keep(found) == keep(want)
    assert {r for r in found if r[0] in unique} == {r for r in want if r[0] in unique}


def test_pfor_round_trip():
    import numpy as np

    from tracemill.llm.token_output import BLOCK, pack, unpack

    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([2**32 - 1, 0]), np.full(3000, 7), rng.integers(0, 50_000, 5000), np.where(rng.random(4096) < 0.02, 2**31, rng.integers(0, 9, 4096))):
        ids = ids.astype(np.uint32)
        data, index = pack(ids)
        assert (unpack(data, index, len(ids)) == ids).all()
        if len(index) > 2:
            assert (unpack(data, index, len(ids), 1, 2) == ids[BLOCK : 2 * BLOCK]).all()


def test_op8(spark, edge):
    from tracemill.llm.common import read_table
    from tracemill.llm.minhash import near_duplicates

    docs = docs_of(edge)
    once = [d for d, n in Counter(d for d, _ in docs).items() if n == 1 and d is not None]
    want = [(d, n, c) for d, n, c in brute.near_components(docs)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_minhash"](spark, edge[0]).collect()]
    assert Counter((d, n) for d, n, _ in got) == Counter((d, n) for d, n, _ in want)
    assert {r for r in got if r[0] in once} == {r for r in want if r[0] in once}
    assert all(c is None for d, _, c in got if d is None)
    assert near_duplicates(spark, read_table(spark, edge[0], "documents")).count() == len(docs)


def test_op8_all_links(spark):
    """Groups of near copies at all degrees of likeness around the threshold, sets from 1 to 400 shingles."""
    import random

    from tracemill.llm.minhash import near_duplicates

    rng, made = random.Random(8), []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 40, 60, 120, 400]))]
        for _ in range(rng.randrange(2, 9)):
            w = list(base)
            for _ in range(rng.randrange(max(2, len(w) // 16))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            made.append((len(made), " ".join(w)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), 4, 80).collect()}
    assert got == set(brute.near_components(made))


def test_components(spark):
    import random

    from tracemill.llm.common import Scratch
    from tracemill.llm.components import connected_components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    parent = {x: x for e in edges for x in e}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long"), "c").collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def folds(ids, parts, part):
    return Counter((d, True if d is None else zlib.crc32(str(d).encode()) % parts == part) for d in ids)


def test_op9(spark, edge):
    got = QUERIES["op9_quality"](spark, edge[0]).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == folds([d for d, _ in docs_of(edge)], 4, 2)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op9_scores_one_by_one(spark, edge):
    """Scores of all rows against a plain loop with the fitted dictionaries and calibration."""
    import math

    import zstandard

    from tracemill.llm.common import read_table
    from tracemill.llm.quality import CHUNK_BYTES, LEVEL, fit_quality, held_out, score_quality

    docs = read_table(spark, edge[0], "documents")
    fit = fit_quality(spark, docs, read_table(spark, edge[0], "labels").filter(~held_out(F.col("doc_id"), 4, 2)))

    def plain(text):
        raw, total = (text or "").encode(), 0
        for a in range(0, len(raw), CHUNK_BYTES):
            size = [len(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(raw[a : a + CHUNK_BYTES])) for d in (fit.bad, fit.good)]
            total += size[0] - size[1]
        return 1 / (1 + math.exp(-(fit.slope * (total / math.sqrt(len(raw)) if raw else 0.0) + fit.intercept)))

    got = Counter((r.doc_id, round(r.score, 9)) for r in score_quality(spark, docs, fit).collect())
    assert got == Counter((d, round(plain(t), 9)) for d, t in docs_of(edge))


def test_op10_predictions_one_by_one(spark, edge):
    """Predictions against grams counted one by one and every codeword's loss summed bit by bit."""
    import math

    from tracemill.llm.common import read_table
    from tracemill.llm.language import DIMENSIONS, fit_languages, predict_languages

    docs = read_table(spark, edge[0], "documents")
    model = fit_languages(spark, docs)
    got = {}
    for r in predict_languages(spark, docs, model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 3)))
    for d, t in docs_of(edge)[:60]:
        if d is None or t is None or not any(c.isalpha() for c in t) or len(t) > 3000:
            continue
        b, count = t.translate(brute.FOLD).encode(), Counter()
        for i in range(len(b)):
            count[b[i]] += 1
            if i + 1 < len(b):
                count[((b[i] * 263 + b[i + 1] * 40_503) * 2_654_435_761 >> 15) % DIMENSIONS] += 1
            if i + 2 < len(b):
                count[((b[i] * 69_069 + b[i + 1] * 40_503 + b[i + 2] * 331) * 2_654_435_761 >> 15) % DIMENSIONS] += 1
        size = math.sqrt(sum(count.values()))
        margin = [sum(math.sqrt(n) / size * float(model.weights[g, k]) for g, n in count.items()) + float(model.bias[k]) for k in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * int(c))) for m, c in zip(margin, word)) for word in model.code]
        share = [math.exp(-4 * (x - min(loss)) / len(margin)) for x in loss]
        best = loss.index(min(loss))
        assert any(p == model.langs[best] and abs(s - share[best] / sum(share)) < 2e-3 for p, s in got[d]), d


def test_op8_on_the_given_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_minhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == set(brute.near_components(pairs(table, "doc_id", "text")))


def test_op9_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    labels = dict(pairs(pq.read_table(f"{sf}/labels.parquet"), "doc_id", "quality"))
    got = [(r.score, labels[r.doc_id]) for r in QUERIES["op9_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.9


def test_op10(spark, edge):
    got = QUERIES["op10_language"](spark, edge[0]).collect()
    texts = docs_of(edge)
    assert Counter((r.doc_id, r.held_out) for r in got) == folds([d for d, _ in texts], 3, 1)
    blank = Counter(d for d, t in texts if t is None or not any(c.isalpha() for c in t))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == blank
    truth = dict(pairs(edge[1]["documents"], "doc_id", "lang"))
    told = [(r.lang_pred, truth[r.doc_id]) for r in got if r.held_out and r.lang_pred != "und" and truth.get(r.doc_id)]
    assert sum(a == b for a, b in told) >= 0.9 * len(told)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 40])
def test_codewords(n):
    from tracemill.llm.language import codewords

    code = codewords(n)
    assert len(code) == n and len({tuple(r) for r in code.tolist()}) == max(n, 0)
    if 3 <= n <= 7:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 2 ** (n - 2)


def test_op9_long_text():
    """What stands at the end of a text of several MB counts as much as what stands at its begin."""
    import random

    from tracemill.llm.quality import Scorer

    rng = random.Random(9)
    noise = lambda n: rng.randbytes(n).hex().encode()
    good, bad = noise(200_000), noise(200_000)
    filler = noise(2_500_000)
    scorer = Scorer(good, bad)
    start, end, worse = (scorer.difference(x) for x in (good[:100_000] + filler, filler + good[:100_000], filler + bad[:100_000]))
    assert start > 20 and abs(end - start) < 0.1 * start and worse < -20


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from tracemill.llm import decontaminate, kernels, language, minhash, token_output, windows
import public_tokenizers
rng = np.random.default_rng(1)
words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(5000)]
text = pa.array([b" ".join(words[i] for i in rng.integers(0, 5000, 2_500_000)).decode()])
batch = lambda **k: pa.RecordBatch.from_arrays(list(k.values()), names=list(k))
token_output.encoder(public_tokenizers.path("word_bpe_49k.json"))
before, size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, text.nbytes / 1024
for name in sys.argv[1:]:
    if name == "op8":
        list(minhash._sketch(4, 80)([batch(doc_id=pa.array([1]), text=text)]))
    elif name in ("op2", "op4"):
        unit = windows.Unit(100, 24, False, False) if name == "op2" else windows.Unit(35, 8, True, True)
        for rows in windows._seeds(unit)([batch(key=pa.array([1]), text=text)]):
            pass
    elif name == "op10":
        language.features(*list(kernels.text_blocks(text))[0][2:])
    elif name == "op7":
        from pyspark import TaskContext
        TaskContext.get = classmethod(lambda cls: type("T", (), {{"partitionId": lambda self: 0}})())
        for row in token_output._encode(public_tokenizers.path("word_bpe_49k.json"), 2)([batch(doc_id=pa.array([1]), text=text)]):
            pass
    print(name, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / size)
"""


@pytest.mark.parametrize("name", ["op2", "op4", "op7", "op8", "op10"])
def test_memory_of_a_long_text(name):
    """A text of 15 MB: temporaries stay within some multiples of it (they are about 80 times a block of half a MB)."""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", MEMORY.format(root=str(Path(__file__).resolve().parents[2])), name], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout.split()[-1]) < 30


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts of many pieces against the plain versions."""
    import random

    import numpy as np

    from tracemill.llm import kernels, language, windows

    monkeypatch.setattr(kernels, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    made = " ".join(rng.choice(["alpha", "be", "gämma", "d" * 700, "eps", "z"]) for _ in range(900))
    for unit in (windows.Unit(20, 6, False, False), windows.Unit(5, 2, True, True)):
        found = {}
        for big in (300, 1 << 20):
            monkeypatch.setattr(kernels, "BLOCK_BYTES", big)
            symbols, first = unit.symbols(np.frombuffer(made.encode(), np.uint8), np.array([0, len(made.encode())]))
            rows = set()
            for begin, codes, at in unit.parts(symbols, first):
                mh, _, _, start, n = windows.window_seeds(codes, at, unit)
                rows |= {(int(h), int(s) + begin + k) for h, s, m in zip(mh, start, n) for k in range(int(m))}
            found[big] = rows
        assert found[300] == found[1 << 20] and len(found[300]) == len(symbols) - unit.size + 1
    features = {}
    for big in (300, 1 << 20):
        monkeypatch.setattr(kernels, "BLOCK_BYTES", big)
        data = np.frombuffer(made.encode(), np.uint8)
        features[big] = language.features(data, np.array([0, len(data)]))
    assert np.allclose(features[300], features[1 << 20])
    cuts = list(kernels.pieces(np.frombuffer(made.encode(), np.uint8), kernels.SPACE_WORDS, 300))
    assert b"".join(made.encode()[a:b] for a, b in cuts) == made.encode() and all(made.encode()[b - 1 : b] == b" " for _, b in cuts[:-1])


def test_pieces_remembered_by_a_task(spark):
    """Copies over many batches of one task: marks are right whatever the order of keys, and one row a piece goes on."""
    import random

    import pyarrow as pa

    from tracemill.llm import substring_dedup, suffix_dedup, windows

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    made = [(i, " ".join(base if i % 3 else [f"x{rng.random()}" for _ in range(50)])) for i in range(90)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = rows(substring_dedup.repeated_words(spark, df, 9, 4), "doc_id", "n_words", "n_removed", "kept_sha256")
        bytes_ = rows(suffix_dedup.repeated_bytes(spark, df, 30, 8), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == Counter(brute.repeated_words(made, 9)) and bytes_ == Counter(brute.repeated_bytes(made, 30))
    unit = windows.Unit(9, 4, True, True)
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], names=["key", "text"]) for k, t in sorted(made)]
    out = pa.Table.from_batches(list(windows._seeds(unit)(batches))).to_pylist()
    copies = [k for k, t in made if t.startswith("w0")]
    pieces = len({r["mh"] for r in out if r["n"] > 0 and r["key"] in copies})
    assert sum(r["n"] > 0 for r in out if r["key"] in copies) == pieces < len(copies)


def test_least_places():
    """Hashes that differ in their lowest bits only, and repeated ones."""
    import numpy as np

    from tracemill.llm.windows import least_places

    rng = np.random.default_rng(3)
    for hashes in (rng.integers(0, 6, 400).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64), np.uint64(2**60) + rng.integers(0, 300, 400).astype(np.uint64)):
        for span in (1, 2, 7, 50, 400):
            assert least_places(hashes, span).tolist() == [i + int(hashes[i : i + span].argmin()) for i in range(400 - span + 1)]


def test_rounds_over_few_edges_take_few_tasks(spark):
    from tracemill.llm.common import Scratch
    from tracemill.llm.components import connected_components

    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    edges = spark.createDataFrame([(k + 1, k) for k in range(12)] + [(100 + k, 100) for k in range(1, 40)], "u long, v long")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-edges", "")
        got = {r.node: r.component for r in connected_components(Scratch(spark, "t"), edges, "few").collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(13)} | {100 + k: 100 for k in range(40)}
    stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 500

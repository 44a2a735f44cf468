"""The pipeline, stage by stage, against plain versions on the edge tables."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, edge, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")

    def step(name, docs):
        stages[name](spark, docs, edge[0]).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    told = step("language", docs)
    assert told.columns == docs.columns
    gone = docs.exceptAll(told).collect()
    assert all(r.text is None or not any(c.isalpha() for c in r.text) or len(r.text) < 100 for r in gone)
    assert any(r.doc_id == 433 for r in gone) and told.filter("length(text) > 200").count() == docs.filter("length(text) > 200").count()

    near = step("near_dedup", told)
    pairs = [(r.doc_id, r.text) for r in told.collect()]
    parts = {d: c for d, _, c in brute.near_components([p for p in dict(pairs).items()], 5, 80)}
    ids = [r.doc_id for r in near.select("doc_id").collect()]
    repeated = {d for d, n in Counter(d for d, _ in pairs).items() if n > 1 or d is None}
    assert max(n for d, n in Counter(ids).items() if d is not None) == 1
    assert {d for d in ids if d not in repeated} == {d for d, c in parts.items() if d == c and d not in repeated}

    clean = step("decontamination", near)
    bench = list(zip(edge[1]["benchmark"]["item_id"].to_pylist(), edge[1]["benchmark"]["text"].to_pylist()))
    kept = [r[0] for r in brute.contamination([(r.doc_id, r.text) for r in near.collect()], bench) if not r[-1] or r[0] is None]
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(d or -1 for d in kept)

    mixed = step("mixing", clean)
    assert mixed.columns == docs.columns
    count = Counter((r.doc_id, r.text) for r in mixed.collect())
    whole = {(r.doc_id, r.text) for r in clean.collect()}
    cut = [k for k in count if k not in whole]
    assert max(count.values()) <= 3 and len(cut) <= 6
    assert all(any(d == i and t.split()[: len(c.split())] == c.split() for i, t in whole) for d, c in cut)

    out = stages["token_output"](spark, mixed, edge[0]).collect()
    want = brute.tokens([(r.doc_id, r.text) for r in mixed.collect()], public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == Counter(want)


def test_run(spark, edge, empty):
    assert corpus_pipeline.run(spark, edge[0]).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_rows_without_a_doc_id_of_their_own(spark):
    from tracemill.llm.decontaminate import decontaminate
    from tracemill.llm.minhash import drop_near_duplicates
    from tracemill.llm.mixing import mix_sources, mixed_documents

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = words("p", 30)
    made = [(None, words("a", 10)), (None, words("b", 1000)), (None, words("c", 300)), (None, words("c", 300)), (None, f"{words('d', 20)} {passage}"), (3, words("e", 15)), (3, f"{words('f', 40)} {passage}"), (4, words("g", 700))]
    docs = spark.createDataFrame([(d, t, "s") for d, t in made], "doc_id long, text string, source string")
    near = drop_near_duplicates(spark, docs.filter("doc_id is null or doc_id <> 3"))
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter({r for r in made if r[0] != 3})
    clean = decontaminate(spark, docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in made if passage not in r[1])
    two = docs.unionByName(spark.createDataFrame([(None, words("h", 2000), "t"), (3, words("i", 900), "t")], docs.schema))
    decisions = mix_sources(spark, two, block_words=200, shards=3)
    want, got = Counter(), Counter()
    for r in decisions.collect():
        want.update((r.doc_id, r.source, x.words) for x in r.draws or [])
    got.update((r.doc_id, r.source, len(r.text.split())) for r in mixed_documents(spark, two, block_words=200, shards=3).collect())
    assert got == want


def test_columns_that_clash(spark, edge):
    """Every helper name of the stages as a column of the documents: rows and columns come out as they went in."""
    names = ["row_key", "ROW_KEY_", "gone_id", "again_id", "near_turn", "has_letter", "row", "size", "draw", "draws", "taken", "block", "ord", "mix_source", "rank", "homes", "state", "copies", "node", "component", "kept"]
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet").select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge[0])
        assert out.columns == docs.columns, name
        got = out.select("doc_id", *names).collect()
        assert got and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in got for n in names), name

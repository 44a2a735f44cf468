"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import BROADCAST_ROWS, Scratch, read_table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20240601
#: Words in one block, the unit that is dealt out.
BLOCK_WORDS = 50_000
#: Words in one output shard, about 50 MB of text, unless there would be more shards than the bound.
SHARD_WORDS = 1 << 23
MAX_SHARDS = 1 << 18
#: Nodes of the splitting tree that the driver draws, and their quotas (a number for each node and source); each one's subtree
#: is drawn in a task.
TOP_NODES, TOP_QUOTAS = 256, 1 << 22
#: Blocks of a source that one window orders: a source's blocks are cut to strata of the permuted order first.
STRATUM_BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: list[int], weights: list[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Split the sum of ``sizes`` by weight; what exceeds ``max_epochs`` times a source's size is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def split_tree(quotas: np.ndarray, shards: int, seed: int, edges: list[int] | None = None):
    """Deal exact block quotas (one per source) out to shards: each shard's counts, in order.

    A node holds a run of shards and a vector of quotas; its left half gets a multivariate-hypergeometric draw of as
    many blocks as its share of the shards, its right half the rest. Sums over shards are the quotas. With ``edges`` the shards
    are runs of smaller ones, the k-th of edges[k] to edges[k + 1], and get shares by that. Only one path of the tree is held.
    """
    edges = range(shards + 1) if edges is None else edges
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            yield q
            continue
        mid = (lo + hi) // 2
        take = int(q.sum()) * (edges[mid] - edges[lo]) // (edges[hi] - edges[lo])
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if take else np.zeros_like(q)
        stack += [(mid, hi, q - left), (lo, mid, left)]


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _subtrees(shards: int, top: int, seed: int):
    """Runs of every source's draw list, one per shard that gets any: (rank, shard, begin, end)."""

    def run(batches):
        for batch in batches:
            for node, quotas, begins in zip(*(batch.column(c).to_pylist() for c in ("node", "quotas", "begins"))):
                lo, hi = node * shards // top, (node + 1) * shards // top
                ends = np.asarray(begins, np.int64)
                for shard, counts in enumerate(split_tree(np.asarray(quotas, np.int64), hi - lo, seed + 1 + int(node)), lo):
                    rank, ends = np.flatnonzero(counts), ends + counts
                    columns = [pa.array(rank.astype(np.int32)), pa.array(np.full(len(rank), shard, np.int32)), pa.array((ends - counts)[rank]), pa.array(ends[rank])]
                    yield pa.RecordBatch.from_arrays(columns, names=["rank", "shard", "begin", "end"])

    return run


@dataclass(frozen=True)
class Mix:
    """A decided mix: per source its target, per block its shards, and the documents of opened blocks. All of it are tables."""

    targets: DataFrame
    blocks: DataFrame
    fitted: DataFrame
    shards: int
    seed: int

    def decide(self, docs: DataFrame) -> DataFrame:
        """Adds the decision to rows with ``doc_id``, ``source`` and ``size``, by which alone it is made.

        New columns: source_size, target, taken, copies, cut_words, draws. Tables of blocks and opened documents are
        broadcast up to ``BROADCAST_ROWS`` rows, else joined by shuffle.
        """
        small = lambda table: F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
        placed = _placed(docs, self.targets, self.seed)
        out = placed.join(small(self.blocks), ["rank", "block"])
        fitted = self.fitted.select(F.col("rank").alias("f_rank"), F.col("doc_id").alias("f_doc_id"), F.col("size").alias("f_size"), "extra")
        out = out.join(small(fitted), (F.col("rank") == F.col("f_rank")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("size") == F.col("f_size")), "left")
        extra = F.when(F.col("state") == "in", F.col("size")).when(F.col("state") == "cut", F.coalesce("extra", F.lit(0))).otherwise(0)
        out = out.withColumn("extra", extra).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0)).otherwise(0).cast("int"))
        out = out.withColumn("cut_words", F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0).cast("long"))

        def drawn(c):
            return F.struct(
                F.col("homes")[c - 1].alias("shard"), F.xxhash64(F.lit(self.seed + 3), "doc_id", "size", c).alias("place"),
                F.when(c <= F.col("copies"), F.col("size")).otherwise(F.col("cut_words")).alias("words"),
            )

        n = F.col("copies") + F.when(F.col("cut_words") > 0, 1).otherwise(0)
        out = out.withColumn("draws", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), drawn)))
        taken = F.aggregate(F.coalesce("draws", F.array()), F.lit(0).cast("long"), lambda t, d: t + d["words"])
        return out.select(*docs.columns, "source_size", "target", taken.alias("taken"), "copies", "cut_words", "draws")


def _placed(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan, block and place in the order of opened blocks."""
    placed = docs.join(F.broadcast(targets), docs["source"].eqNullSafe(F.col("mix_source")))  # one row per source, of which the number is checked
    return placed.withColumns({"block": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_blocks")), "ord": F.xxhash64(F.lit(seed + 1), "doc_id", "size")})


def plan_mix(
    spark: SparkSession, sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int | None = None,
    block_words: int = BLOCK_WORDS, seed: int = SEED, max_sources: int = 100_000,
) -> Mix:
    """Decide a mix, for rows (doc_id, source, size), in which each source has about its target number of words.

    Sources by code point (null last) weigh ``weights``, repeating, and share all words; a source gets at most
    ``max_epochs`` times its size and the excess is shared again by weight. Documents are hashed to blocks of about
    ``block_words`` words; a source's blocks, in an order permuted by the seed, are its draw list: all blocks once for
    every whole epoch of its target, then a run of permuted blocks for the rest. The block where the target falls is
    opened and its documents are taken in permuted order, each if it still fits; one is cut to the room left.

    Blocks are ordered in strata of their permuting hash: a window gives each stratum the turns and words before it, and
    one per stratum those within, so that no task holds a source. A splitting tree deals the block quotas out to
    ``shards`` (by default one for every ``SHARD_WORDS`` words, so their number grows and their size doesn't): its first
    ``TOP_NODES`` nodes are drawn on the driver and the rest in tasks. Every shard takes a disjoint run of each source's
    draw list, found by an equi-join on coarse places in the list. Only one row per source comes to the driver, checked
    against ``max_sources``.

    Null texts have size 0; documents of size 0 are never taken. Rows that repeat a doc_id and a size, null ids too, fall
    in one block and are taken together or not at all, each at most ``max_epochs`` times. Reruns agree: all orders depend
    on doc_id, size and seed only.
    """
    scratch = Scratch(spark, "mixing")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources")
    per_source = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in per_source]
    goal = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_epochs)
    whole = [min(int(t // s), max_epochs) if s else 0 for s, t in zip(sizes, goal)]
    shards = shards or max(1, min(MAX_SHARDS, -(-sum(sizes) // SHARD_WORDS)))
    plan = [
        (r["source"], sizes[i], goal[i], i, max(1, -(-sizes[i] // block_words)), whole[i], max(0, round(goal[i] - whole[i] * sizes[i])))
        for i, r in enumerate(per_source)
    ]
    targets = spark.createDataFrame(plan, "mix_source string, source_size long, target double, rank int, n_blocks long, whole int, part long")

    # Blocks in permuted order with running totals, over strata and then within each.
    table = _placed(sized, targets, seed).groupBy("rank", "block", "n_blocks", "whole", "part").agg(F.sum("size").alias("words"))
    turn = F.xxhash64(F.lit(seed + 2), "rank", "block")
    strata = F.ceil(F.col("n_blocks") / STRATUM_BLOCKS)
    table = table.withColumns({"place": F.shiftrightunsigned(turn, 1), "stratum": F.shiftright(F.shiftrightunsigned(turn, 40) * strata, 24)})
    table = scratch.save(table, "words")
    totals = table.groupBy("rank", "stratum").agg(F.count("*").alias("k"), F.sum("words").alias("w"))
    ahead = Window.partitionBy("rank").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)  # one row per stratum
    before = totals.select("rank", "stratum", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("k0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    perm = Window.partitionBy("rank", "stratum").orderBy("place", "block")
    table = table.join(before, ["rank", "stratum"]).withColumns({
        "turn": F.col("k0") + F.row_number().over(perm), "upto": F.col("w0") + F.sum("words").over(perm.rowsBetween(Window.unboundedPreceding, 0)),
    })
    table = table.withColumn("room", F.col("part") - (F.col("upto") - F.col("words")))
    table = table.withColumn("state", F.when(F.col("upto") <= F.col("part"), "in").when(F.col("room") > 0, "cut").otherwise("out"))
    table = scratch.save(table.select("rank", "block", "whole", "turn", "room", "state"), "blocks")

    # Draw list of a source: whole epochs of all blocks, then the permuted blocks up to the cut.
    taken = F.count(F.when(F.col("state") != "out", 1))
    quotas = {r["rank"]: r for r in table.groupBy("rank").agg(F.count("*").alias("n"), taken.alias("m")).collect()}  # one row per source
    lists = np.array([quotas[i]["n"] * whole[i] + quotas[i]["m"] for i in range(len(sizes))], dtype=np.int64)
    top = max(1, min(shards, TOP_NODES, TOP_QUOTAS // max(1, len(lists))))
    counts = np.stack(list(split_tree(lists, top, seed, [k * shards // top for k in range(top + 1)])))
    begins = counts.cumsum(axis=0) - counts
    lists_of = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
    nodes = spark.createDataFrame(pa.table({"node": pa.array(np.arange(top, dtype=np.int32)), "quotas": lists_of(counts), "begins": lists_of(begins)})) if len(lists) else spark.createDataFrame([], "node int, quotas array<long>, begins array<long>")
    dealt = nodes.repartition(min(top, 64)).mapInArrow(_subtrees(shards, top, seed), "rank int, shard int, begin long, end long")
    steps = [(i, int(quotas[i]["n"]), max(1, -(-int(lists[i]) // shards))) for i in range(len(sizes))]
    steps = F.broadcast(spark.createDataFrame(steps, "rank int, n long, step long"))
    dealt = dealt.join(steps.drop("n"), "rank").withColumn("coarse", F.explode(F.sequence(F.expr("begin div step"), F.expr("(end - 1) div step")))).drop("step")
    dealt = scratch.save(dealt, "dealt")
    draws = table.withColumn("copy", F.explode(F.expr("sequence(1, whole + 1)"))).filter("copy <= whole or state <> 'out'")
    draws = draws.join(steps, "rank").withColumn("at", F.col("turn") - 1 + (F.col("copy") - 1) * F.col("n"))
    draws = draws.withColumn("coarse", F.expr("at div step")).join(dealt, ["rank", "coarse"]).filter("begin <= at and at < end")
    homes = draws.groupBy("rank", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda d: d["shard"]).alias("homes"))  # max_epochs + 1 at most
    blocks = scratch.save(table.select("rank", "block", "state", "room").join(homes, ["rank", "block"], "left"), "homes")

    # Opened blocks: one per source at most, each of about block_words words.
    opened = F.broadcast(blocks.filter("state = 'cut'").select("rank", "block", "room"))
    opened = _placed(sized, targets, seed).join(opened, ["rank", "block"]).select("rank", "doc_id", "size", "ord", "room")
    fitted = scratch.save(opened.groupBy("rank").applyInArrow(_fit, "rank int, doc_id long, size long, extra long"), "fitted")
    return Mix(targets, blocks.drop("room"), fitted, shards, seed)


def mix_sources(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The decision for every row of documents (doc_id, text, source); see ``plan_mix`` for the mix and its options.

    Returns one row per input row: ``doc_id, source, size long, source_size long, target double, taken long,
    copies int, cut_words long, draws array<struct<shard int, place long, words long>>`` (one draw per copy or cut). An empty
    table gives no rows; other columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words("text").alias("size"))
    sized = Scratch(spark, "mixing").save(sized, "sized")
    return plan_mix(spark, sized, **options).decide(sized)


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' columns once per draw, each shard in a partition of its own and shuffled within.

    A cut document, one per source at most, comes as its first words joined by spaces. Every row is decided by its own doc_id,
    source and size, also where doc_ids repeat or are missing. Decisions are made without texts, one for all rows that are alike
    in these three, and joined to the documents once: up to ``BROADCAST_ROWS`` of them are broadcast, and then texts move to their shard
    only. Documents travel in a struct, so that no column of theirs can clash.
    """
    scratch = Scratch(spark, "mixed")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words("text").alias("size"))
    sized = scratch.save(sized, "sized")
    mix = plan_mix(spark, sized, **options)
    drawn = mix.decide(sized.filter("size > 0").distinct()).filter("draws is not null").select(F.col("doc_id").alias("m_doc_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "draws")
    drawn = scratch.save(drawn, "drawn")
    drawn = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words("text").alias("size"))
    alike = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size"))
    drawn = rows.join(drawn, alike).select("row", "size", F.explode("draws").alias("draw"))
    drawn = drawn.repartitionById(mix.shards, F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") >= F.col("size"), F.col("row.text")).otherwise(cut)
    return drawn.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _fit(block: pa.Table) -> pa.Table:
    """Words to take of each document of an opened block: whole documents in permuted order while they fit.

    The first document that doesn't fit is cut to what room is left at the end. Repeated rows stand or fall together, uncut.
    """
    alike = Counter(zip(*(block.column(c).to_pylist() for c in ("ord", "doc_id", "size"))))
    rank, room = block.column("rank")[0].as_py(), block.column("room")[0].as_py()
    out, cut = [], None
    for (order, doc_id, size), n in sorted(alike.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0, x[0][2])):
        fits = 0 < size * n <= room
        room -= size * n * fits
        if not fits and cut is None and n == 1 and size > 0:
            cut = len(out)
        out.append([doc_id, size, size * fits])
    if cut is not None and room > 0:
        out[cut][2] = min(room, out[cut][1])
    doc_id, size, extra = zip(*out)
    return pa.table({"rank": pa.array([rank] * len(out), pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "size": pa.array(size, pa.int64()), "extra": pa.array(extra, pa.int64())})


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; nulls, repeats and empty texts as in ``plan_mix``."""
    mix = mix_sources(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "cut_words", "draws")

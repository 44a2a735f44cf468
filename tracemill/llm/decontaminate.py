"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table, row_keyed, without_ids

WINDOW = 13
#: Bytes of benchmark text in one block of test suffixes; a larger benchmark takes several blocks.
BLOCK_BYTES = 8_000_000
PAD = -2


class TestSuffixes:
    """One block of benchmark items: their vocabulary and their distinct windows, with the items that hold each."""

    def __init__(self, item_ids: list[str], texts: list[str], window: int):
        array = pa.array([t or "" for t in texts], pa.string())
        data, offs = K.buffers(array)
        data, offs = K.FOLD[data[offs[0] : offs[-1]]], offs - offs[0]
        starts, ends, first = K.words(data, offs, K.ALNUM_WORDS)
        raw, seen = data.tobytes(), {}
        ids = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
        self.window, self.item_ids = window, item_ids
        self._learn(list(seen))
        rows, owners = [], []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            size = min(window, b - a)
            for s in range(a, b - size + 1 if size else a):
                rows.append(np.concatenate((ids[s : s + size], np.full(window - size, PAD))))
                owners.append((i, s - a))
        table = np.array(rows, dtype=np.int32).reshape(len(rows), window)
        self.rows, inverse = np.unique(table, axis=0, return_inverse=True) if len(rows) else (table, np.zeros(0, np.int64))
        owners = np.array(owners, dtype=np.int64).reshape(-1, 2)
        self.item_words = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
        self.places, place_of = owners, inverse.ravel()  # of every window of every item
        by_window = np.argsort(place_of, kind="stable")
        self.place_order, self.place_at = by_window, np.searchsorted(place_of[by_window], np.arange(len(self.rows) + 1))
        pairs = np.unique(np.stack([place_of, owners[:, 0]], axis=1), axis=0)
        self.owners, self.owner_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))  # items that hold each window
        self.sizes = (self.rows != PAD).sum(axis=1)
        self.least = int(self.sizes.min()) if len(self.rows) else window

    def _learn(self, vocabulary: list[bytes]) -> None:
        """Words sorted by hash, to be found by hash and compared by content."""
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        length = np.array([len(w) for w in vocabulary], dtype=np.int64)
        starts = np.cumsum(length) - length
        hashes = K.word_hashes(data, starts, starts + length)
        order = np.argsort(hashes, kind="stable")
        self.vocabulary, self.number = hashes[order], order
        self.most = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # words of one hash: one, but for chance
        size = -(-length // 8)
        self.limb_at, self.lengths = (np.cumsum(size) - size)[order], length[order]
        padded = np.zeros(int(size.sum()) * 8, np.uint8)
        padded[np.repeat((np.cumsum(size) - size) * 8 - starts, length) + np.arange(len(data))] = data
        self.limbs = padded.view("<u8")
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def word_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for words that no item has."""
        out = np.full(len(starts), -1, dtype=np.int32)
        for lo, hi, part, limb, s, e in K.word_blocks(data, starts, ends):
            hashes = K.byte_hashes(part, limb, s, e)
            maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            left = np.searchsorted(self.vocabulary, hashes[maybe])
            for r in range(self.most):
                at = left + r
                maybe, left, at = (x[at < len(self.vocabulary)] for x in (maybe, left, at))
                hit = (self.vocabulary[at] == hashes[maybe]) & (self.lengths[at] == (e - s)[maybe])
                who, where = maybe[hit], at[hit]
                equal = K.same_bytes(limb, s[who], self.limbs, self.limb_at[where], self.lengths[where], 8)
                out[lo + who[equal]] = self.number[where[equal]]
        return out


def suffix_array(ids: np.ndarray, reach: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a shard, sorted by their first ``window`` words.

    Only suffixes that begin with ``least`` benchmark words in one document can hold a match; the others are left out.
    ``reach`` is the number of benchmark words in a row from each place. Returns (places in order, their words; -1
    after the end of the run).
    """
    places = np.flatnonzero(reach >= least)
    step = np.arange(window)
    rows = np.where(step < np.minimum(reach[places], window)[:, None], ids[np.minimum(places[:, None] + step, len(ids) - 1)] if len(ids) else -1, -1).astype(np.int32)
    order = np.lexsort(rows.T[::-1]) if len(places) else np.zeros(0, np.int64)
    return places[order], rows[order]


def bounds(rows: np.ndarray, tests: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all test windows at once: the run [lower, upper) of suffixes that begin with each."""

    def search(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(rows), np.int64)
        open_ = lo < hi
        while open_.any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) // 2
            diff = rows[mid].astype(np.int64) - tests[at]
            diff[np.arange(tests.shape[1]) >= sizes[at][:, None]] = 0
            first = (diff != 0).argmax(axis=1)
            value = diff[np.arange(len(at)), first]
            right = value <= 0 if upper else value < 0
            lo[at[right]] = mid[right] + 1
            hi[at[~right]] = mid[~right]
            open_ = lo < hi
        return lo

    return search(False), search(True)


def window_hits(block: TestSuffixes, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of all occurrences of test windows in a shard: at most one for each place and size of window."""
    none = (np.zeros(0, np.int64),) * 2
    if not len(ids) or not len(block.rows):
        return none
    stop = np.flatnonzero((ids < 0) | np.concatenate((doc[1:] != doc[:-1], [True])))
    nxt = stop[np.searchsorted(stop, np.arange(len(ids)))]
    reach = np.where(ids >= 0, nxt - np.arange(len(ids)) + (ids[nxt] >= 0), 0)
    places, rows = suffix_array(ids, reach, block.least, block.window)
    if not len(places):
        return none
    lower, upper = bounds(rows, block.rows, block.sizes)
    n = upper - lower
    return places[np.repeat(lower, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)], np.repeat(np.arange(len(n)), n)


def longest_matches(block: TestSuffixes, words: np.ndarray, windows: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, place in it, place in the document, words): for the test suffixes that begin with a window of the document, their longest match.

    Suffixes of the document and of the items that hold such windows are ranked together by doubling; the longest match of a
    test suffix is with the next suffix of the document above or below it, the first of equal ones. One that only continues the match of
    the suffix before it is left out. Work is that of sorting the two texts, however often words repeat.
    """
    spans = [block.place_order[block.place_at[w] : block.place_at[w + 1]] for w in np.unique(windows).tolist()]
    found = block.places[np.sort(np.concatenate(spans))]
    items = np.unique(found[:, 0]).tolist()
    parts, begin, base = [np.where(words < 0, -1, words), np.array([-2])], {}, len(words) + 1
    for k, i in enumerate(items):
        begin[i] = base
        parts += [block.item_words[i], np.array([-3 - k])]
        base += len(block.item_words[i]) + 1
    codes = np.concatenate(parts).astype(np.int64)
    unlike = np.flatnonzero(codes < 0)  # words that no item has, and ends, match nothing
    codes[unlike] = -1 - np.arange(len(unlike))
    n, width = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    levels = [(1, rank)]
    while width < n and rank.max() < n:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:]
        rank = np.unique(rank * np.int64(n + 2) + follow, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
        levels.append((width, rank))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for width, ranks in reversed(levels):
            fits = np.flatnonzero((a + width <= n) & (b + width <= n))
            same = fits[ranks[a[fits]] == ranks[b[fits]]]
            out[same] += width
            a[same] += width
            b[same] += width
        return out

    order = np.argsort(rank, kind="stable")
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    own = np.flatnonzero(order < len(words))  # the document's suffixes in order
    tests = np.array([begin[i] + o for i, o in found.tolist()])
    right = np.searchsorted(own, where[tests])
    above, below = order[own[np.maximum(right - 1, 0)]], order[own[np.minimum(right, len(own) - 1)]]
    a, b = common(tests, above), common(tests, below)
    size, place = np.where(a >= b, a, b), np.where(a >= b, above, below)
    out = []
    for (i, o), s, p in zip(found.tolist(), size.tolist(), place.tolist()):
        if out and out[-1][0] == i and out[-1][1] + 1 == o and out[-1][4] == s + 1:
            out[-1] = (*out[-1][:1], o, *out[-1][2:4], s, *out[-1][5:])
        else:
            out.append((i, o, p, s, s, o))
    return [(i, start, p, s) for i, _, p, s, _, start in out]


def shard(block: TestSuffixes, data: np.ndarray, offs: np.ndarray, longest: bool):
    """Of each document of a shard: number of words, hit runs [start, end), item ids, longest matches."""
    data = K.FOLD[data]
    starts, ends, first = K.words(data, offs, K.ALNUM_WORDS)
    n = len(first) - 1
    ids, doc = block.word_ids(data, starts, ends), K.per_text(starts, first)
    at, window = window_hits(block, ids, doc)
    hits, items, matches = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    if len(at):
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.sizes[window], -1)
        inside = np.cumsum(edge[:-1]) > 0
        fresh = inside & np.concatenate(([True], ~inside[:-1] | (doc[1:] != doc[:-1])))
        begin = np.flatnonzero(fresh)
        run = np.bincount(np.cumsum(fresh)[inside] - 1)
        for a, k in zip(begin.tolist(), run.tolist()):
            hits[doc[a]].append((int(a - first[doc[a]]), int(a - first[doc[a]] + k)))
        pairs = np.unique(doc[at] * np.int64(len(block.rows)) + window)
        of, held = pairs // len(block.rows), pairs % len(block.rows)
        for d in np.unique(of).tolist():
            mine = held[of == d] if n > 1 else held
            owners = np.unique(np.concatenate([block.owners[block.owner_at[w] : block.owner_at[w + 1]] for w in mine.tolist()]))
            items[d] = sorted({block.item_ids[i] for i in owners.tolist()})
            if longest:
                words = ids[first[d] : first[d + 1]]
                matches[d] = [{"item": block.item_ids[i], "item_start": o, "start": p, "words": s} for i, o, p, s in longest_matches(block, words, mine)]
    return np.diff(first), hits, items, matches


SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
MATCH = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))
SHAPE = "doc_id long, n_words long, hits array<struct<a:long,b:long>>, items array<string>, matches array<struct<item:string,item_start:long,start:long,words:long>>"


def _mark(tests, longest: bool, only_hit: bool):
    """The words hit by a block of items in each document, the items that occur, and where; if ``only_hit`` of documents with a hit."""

    def run(batches):
        K.begin("matches")
        block = tests.value
        for batch in batches:
            doc_id = K.column(batch, "doc_id")
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                count, hits, items, matches = shard(block, data, offs, longest)
                out = pa.RecordBatch.from_arrays([
                    doc_id.slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array([[{"a": a, "b": b} for a, b in x] for x in hits], SPAN),
                    pa.array(items, pa.list_(pa.string())), pa.array(matches if longest else [None] * (hi - lo), MATCH),
                ], names=["doc_id", "n_words", "hits", "items", "matches"])
                yield out.filter(pa.array([bool(x) for x in hits])) if only_hit else out

    return run


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark, dealt to blocks of about ``block_bytes`` by a hash, each indexed and broadcast."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = []
    for k in range(n):
        rows = items.filter(F.col("part") == k).select("item_id", "text").collect()  # about block_bytes
        out.append(spark.sparkContext.broadcast(TestSuffixes([r[0] for r in rows], [r[1] for r in rows], window)))
    return out


def find_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, longest: bool = False) -> DataFrame:
    """Locate every benchmark window in every document.

    A shard is about half a MB of whole documents within a task: its suffix array (word suffixes, sorted by their first
    ``window`` words) is searched for all distinct benchmark windows at once by binary search. Words are found by hash and then
    compared as they stand; suffixes that hold a word that no item has are left out of the arrays. Words are
    A-Z-lower-cased runs of ASCII letters and digits and non-ASCII characters. An item with fewer words than ``window`` is one
    window; an item without words is none.

    The benchmark is measured first and dealt to blocks of about ``block_bytes`` by a hash; a block goes to the driver, is
    indexed and goes out as a broadcast. With one block nothing is shuffled. With several, each block meets the documents in
    tasks of its own, and what they find in a document is put together by its row key.

    Returns one row per input row: doc_id, n_words, hits (word spans in matches, merged), items (ids as strings,
    sorted), and if ``longest`` matches (item, place in it, place in the document, words: see ``longest_matches``), else null. Null
    texts have no words; null item ids are named "null"; repeated rows are each judged; empty documents or an empty
    benchmark give no hits. Other columns are ignored.
    """
    scratch = Scratch(spark, "matches")
    blocks = _blocks(spark, benchmark, window, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(blocks) == 1:
        return rows.mapInArrow(_mark(blocks[0], longest, False), SHAPE)
    kept, key = row_keyed(scratch, rows)
    texts = kept.select(F.col(key).alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, (texts.mapInArrow(_mark(b, longest, True), SHAPE) for b in blocks))
    gathered = found.groupBy("doc_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "matches")))  # as large as its own hits
    merge = F.aggregate(
        F.array_sort("hits"), F.expr("cast(array() as array<struct<a:long,b:long>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= x["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x))),
    )
    gathered = gathered.select(F.col("doc_id").alias(key), merge.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"), "matches")
    counts = texts.mapInArrow(_count_words, "row long, n_words long").withColumnRenamed("row", key)
    out = kept.select(key, "doc_id").join(counts, key).join(gathered, key, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(gathered.dtypes)[c])).alias(c)
    return out.select("doc_id", "n_words", none("hits"), none("items"), none("matches") if longest else F.lit(None).cast(dict(gathered.dtypes)["matches"]).alias("matches"))


def _count_words(batches):
    for batch in batches:
        for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id").slice(lo, hi - lo), pa.array(np.diff(K.words(K.FOLD[data], offs, K.ALNUM_WORDS)[2]).astype(np.int64))], names=["row", "n_words"])


def _clean(tests):
    """Batches without the rows whose text a block of items contaminates."""

    def run(batches):
        K.begin("matches")
        block = tests.value
        for batch in batches:
            keep = []
            for _, _, data, offs in K.text_blocks(K.column(batch, "text")):
                count, hits, _, _ = shard(block, data, offs, False)
                n_hit = np.array([sum(b - a for a, b in x) for x in hits], np.int64)
                keep.append((n_hit == 0) | (20 * n_hit < count))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return run


def judged(matches: DataFrame) -> DataFrame:
    """n_hit, n_items, items and the contamination rule: any hit and at least one word in twenty hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return matches.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns; every row is judged by its own text, whatever its doc_id.

    Null and empty texts have no words and stay. With one block of benchmark the rows are filtered in the pass that judges them;
    with several, rows get a key and are written first.
    """
    scratch = Scratch(spark, "decontaminated")
    blocks = _blocks(spark, benchmark, window, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(_clean(blocks[0]), docs.schema)
    rows, key = row_keyed(scratch, docs)
    found = judged(find_matches(spark, rows.select(F.col(key).alias("doc_id"), "text"), benchmark, window, block_bytes))
    return without_ids(scratch, rows, found.filter("contaminated"), key).drop(key)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hits against the whole benchmark; cases as in ``find_matches``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(find_matches(spark, docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )

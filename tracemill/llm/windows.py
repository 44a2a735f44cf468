"""Finding windows of equal symbols that repeat across documents: shared stages of the two substring operators.

A window is ``size`` symbols of one document in a row; symbols are bytes or words. Comparing all windows would move
many times the corpus, so windows are first tied to seeds: the smallest hashed gram of ``gram`` symbols in a window.
Equal windows have the same seed at the same place, so a window whose seed is unique in the corpus can't repeat. The
windows tied to one seed occurrence lie in a row; together they are a *piece*. Results come from two places: pieces of
equal seed and equal hash are marked as repeated by these 64-bit hashes alone, and of the distinct pieces with a
repeated seed, the first of each is compared by the operator's own method. Windows of hot seeds are grouped by their own
hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import BROADCAST_ROWS, Scratch

SEED = "mh long, ph long, key long, start int, n int"
#: A seed shared by more distinct pieces than this has its pieces cut to single windows, keyed by their own hash.
HOT_PIECES = 50_000
#: Pieces that are compared at once; whole seed groups are added until there are so many.
CHUNK = 6000


@dataclass(frozen=True)
class Unit:
    """How texts are cut to symbols. ``by_words``: words of non-space bytes; else UTF-8 bytes."""

    size: int
    gram: int
    by_words: bool
    #: Whether the first occurrence of a repeated window is marked as well.
    mark_first: bool

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first symbol of each text and the end): bytes, or 64-bit codes of words."""
        if not self.by_words:
            return data, offs
        starts, ends, first = K.words(data, offs, K.SPACE_WORDS)
        return K.word_hashes(data, starts, ends), first

    def numbers(self, symbols: np.ndarray) -> np.ndarray:
        """What grams are made of: the codes of words, or the eight bytes from each place."""
        return symbols if self.by_words else K.limbs(symbols)

    def grams(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` symbols from every place."""
        return K.word_grams(numbers, size) if self.by_words else K.byte_grams(numbers, size)

    def hashes(self, symbols: np.ndarray, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return K.code_hashes(numbers, starts, ends) if self.by_words else K.byte_hashes(symbols, numbers, starts, ends)

    def parts(self, symbols: np.ndarray, first: np.ndarray):
        """(begin, symbols, first) of runs of symbols to be handled at once; runs of a long text hold each of its windows once."""
        if len(first) > 2 or len(symbols) <= 2 * K.BLOCK_BYTES:
            yield 0, symbols, first
            return
        for a in range(0, len(symbols) - self.size + 1, K.BLOCK_BYTES):
            run = symbols[a : a + K.BLOCK_BYTES + self.size - 1]
            yield a, run, np.array([0, len(run)])


def keyed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with keys that are unique and ascend with doc_id.

    Where doc_ids are unique and not null they are the keys. Otherwise rows are sorted by (doc_id, text), nulls last,
    written with a running key and read back, so that every row is a document of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count() == 0:
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return scratch.save(rows.orderBy(F.asc_nulls_last("doc_id"), "text").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")


def _sliding(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of every ``span`` values in a row, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of every ``span`` hashes in a row, and of equals the leftmost: it depends on these hashes alone.

    Places are found with the hash's high bits in front of them; the whole hashes then tell whether the low bits that
    made room matter, which hardly ever happens.
    """
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    places = np.arange(len(hashes), dtype=np.uint64)
    found = (_sliding(((hashes >> bits) << bits) | places, span) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    least = _sliding(hashes, span)
    for i in np.flatnonzero(hashes[found] != least).tolist():
        found[i] = i + int(np.flatnonzero(hashes[i : i + span] == least[i])[0])
    return found


def window_seeds(symbols: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(seed hash, piece hash, text, first window's start in the text, number of windows) of all pieces."""
    none = np.zeros(0, np.int64)
    if len(symbols) < unit.size:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    numbers = unit.numbers(symbols)
    grams = unit.grams(numbers, unit.gram)
    seed = least_places(grams, unit.size - unit.gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(seed)]
    fits = np.arange(len(seed)) + unit.size <= first[1:][text]
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    seed, text = seed[starts], text[starts]
    head = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.append(head, len(starts)))
    begin = starts[head]
    return grams[seed[head]], unit.hashes(symbols, numbers, begin, begin + n + unit.size - 1), text[head], begin - first[text[head]], n


class Seen:
    """First occurrences of pieces that a task has met: a table of fixed size, in which a new piece takes its slot's place.

    What it forgets is combined after the shuffle as well; what it remembers leaves one row per task, however often a
    piece occurs.
    """

    def __init__(self, slots: int = 1 << 18):
        self.mask = np.uint64(slots - 1)
        self.mh, self.ph = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.key, self.start, self.n = (np.zeros(slots, np.int64) for _ in range(3))
        self.full, self.told = np.zeros(slots, bool), np.zeros(slots, bool)

    def meet(self, mh, ph, key, start, n) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(which of these distinct pieces stand after one met before, the ones met that weren't told to be repeated yet)."""
        slot = (K.mix64(mh ^ ph) & self.mask).astype(np.int64)
        known = self.full[slot] & (self.mh[slot] == mh) & (self.ph[slot] == ph)
        later = known & ((key > self.key[slot]) | ((key == self.key[slot]) & (start > self.start[slot])))
        first = np.unique(slot[later & ~self.told[slot]])
        told = tuple(x[first] for x in (self.key, self.start, self.n))
        self.told[first] = True
        new = ~later
        at = slot[new]
        self.mh[at], self.ph[at], self.key[at], self.start[at], self.n[at] = (x[new] for x in (mh, ph, key, start, n))
        self.full[at], self.told[at] = True, False
        return later, told


def _seeds(unit: Unit):
    """Pieces of all texts. Equal pieces that a task remembers leave one row; the windows of the others are marks (n < 0)."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            keys, found = K.column(batch, "key").to_numpy(), []
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                for begin, symbols, first in unit.parts(*unit.symbols(data, offs)):
                    mh, ph, text, start, n = window_seeds(symbols, first, unit)
                    found.append((mh, ph, keys[lo:hi][text], start + begin, n))
            if not found:
                continue
            mh, ph, key, start, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, key, ph, mh))
            mh, ph, key, start, n = (x[order] for x in (mh, ph, key, start, n))
            same = np.concatenate(([False], (mh[1:] == mh[:-1]) & (ph[1:] == ph[:-1]))) if len(mh) else np.zeros(0, bool)
            marked = same.copy()
            if unit.mark_first:
                marked[:-1] |= same[1:]
            head = np.flatnonzero(~same)
            later, told = seen.meet(*(x[head] for x in (mh, ph, key, start, n)))
            marked[head[later]] = True
            same[head[later]] = True
            if unit.mark_first:
                key, start, n = (np.concatenate((x, t)) for x, t in zip((key, start, n), told))
                mh, ph = (np.concatenate((x, np.zeros(len(told[0]), np.uint64))) for x in (mh, ph))
                same, marked = (np.concatenate((x, np.ones(len(told[0]), bool))) for x in (same, marked))
            parts = [(mh[~same], ph[~same], key[~same], start[~same], n[~same]), (K.mix64(key[marked].view(np.uint64) + start[marked].astype(np.uint64) * np.uint64(K.MULT)), np.zeros(int(marked.sum()), np.uint64), key[marked], start[marked], -n[marked])]
            mh, ph, key, start, n = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mh", "ph", "key", "start", "n"])

    return run


def _group(unit: Unit):
    """Reads pieces sorted by (mh, ph, key, start) and keeps those that can repeat.

    Of equal pieces the first stays and the others are marked whole; a seed with several distinct pieces passes on the
    first of each (n > 0), to be compared. Only one row is carried from batch to batch, whatever the size of a group.
    """

    def run(batches):
        carry = None  # (mh, ph, key, start, n), passed on?, marked?
        for batch in batches:
            mh, ph, key, start, n = (K.column(batch, c).to_numpy() for c in ("mh", "ph", "key", "start", "n"))
            given = n < 0
            out = [(np.zeros(int(given.sum()), np.int64), key[given], start[given], n[given])]
            mh, ph, key, start, n = (x[~given] for x in (mh, ph, key, start, n))
            passed, done = np.zeros(len(mh), bool), np.zeros(len(mh), bool)
            if carry is not None:
                mh, ph, key, start, n = (np.concatenate((np.array([c], dtype=x.dtype), x)) for c, x in zip(carry[0], (mh, ph, key, start, n)))
                passed, done = np.concatenate(([carry[1]], passed)), np.concatenate(([carry[2]], done))
            if len(mh):
                group = np.concatenate(([True], mh[1:] != mh[:-1]))
                head = group | np.concatenate(([True], ph[1:] != ph[:-1]))
                at = np.flatnonzero(head)
                of = np.cumsum(group)[at] - 1
                several = np.bincount(of)[of] > 1
                ready = at[several & ~passed[at]]
                out.append((mh[ready], key[ready], start[ready], n[ready]))
                passed[at[several]] = True
                marked = ~head
                if unit.mark_first:
                    repeated = at[np.diff(np.append(at, len(mh))) > 1]
                    marked[repeated] = ~done[repeated]
                    done[repeated] = True
                out.append((np.zeros(int(marked.sum()), np.int64), key[marked], start[marked], -n[marked]))
                last = at[-1]
                carry = (tuple(int(x[last]) for x in (mh, ph, key, start, n)), bool(passed[last]), bool(done[last]))
            mh, key, start, n = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(mh), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mh", "key", "start", "n"])

    return run


def _extract(unit: Unit):
    """The symbols of the listed pieces; those of hot seeds as single windows under their own hash.

    Of windows that a task remembers (``Seen``) the later ones are marks (n < 0) and don't travel.
    """

    def run(batches):
        seen = Seen(1 << 16)
        for batch in batches:
            keys, lists = K.column(batch, "key").to_pylist(), K.column(batch, "pieces").to_pylist()
            out_mh, out_key, out_start, out_n, out_body = [], [], [], [], []
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                symbols, first = unit.symbols(data, offs)
                raw, wide = symbols.tobytes(), symbols.itemsize
                for i in range(lo, hi):
                    base = int(first[i - lo])
                    for piece in lists[i]:
                        a, n = base + piece["start"], piece["n"]
                        if piece["hot"]:
                            at = np.arange(n)
                            hashes = unit.grams(unit.numbers(symbols[a : a + n + unit.size - 1]), unit.size)
                            later, told = seen.meet(hashes, hashes, np.full(n, keys[i]), at + piece["start"], np.ones(n, np.int64))
                            marks = [(keys[i], int(s) + piece["start"]) for s in at[later]]
                            for k, s in marks + (list(zip(told[0].tolist(), told[1].tolist())) if unit.mark_first else []):
                                out_mh.append(hash((k, s)))
                                out_key.append(k)
                                out_start.append(s)
                                out_n.append(-1)
                                out_body.append(b"")
                            runs = [(int(h), int(s), 1) for h, s in zip(hashes[~later].view(np.int64), (at + a)[~later])]
                        else:
                            runs = [(piece["mh"], a, n)]
                        for mh, s, k in runs:
                            out_mh.append(mh)
                            out_key.append(keys[i])
                            out_start.append(s - base)
                            out_n.append(k)
                            out_body.append(raw[s * wide : (s + k + unit.size - 1) * wide])
            yield pa.RecordBatch.from_arrays([pa.array(out_mh, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_start, pa.int32()), pa.array(out_n, pa.int32()), pa.array(out_body, pa.binary())], names=["mh", "key", "start", "n", "body"])

    return run


def _compare(unit: Unit, repeated: Callable):
    """Runs ``repeated`` over chunks of whole seed groups and returns the windows that it finds, as runs."""

    def run(batches):
        held, group, base = [], None, None  # pieces of the chunk, current seed, its first piece

        def flush():
            # A seed left alone (its windows went to other keys) has nothing to be compared with.
            if len(held) < 2:
                return []
            bodies = [h[2] for h in held]
            keys, starts = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            piece, place = repeated(bodies, keys, starts, np.array([h[3] for h in held], np.int64), unit)
            order = np.lexsort((place, piece))
            piece, place = piece[order], place[order]
            if not len(piece):
                return []
            head = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1))))
            n = np.diff(np.append(head, len(piece)))
            return [(keys[piece[head]], starts[piece[head]] + place[head], n)]

        def rows(found):
            key, start, n = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(-n.astype(np.int32))], names=["mh", "key", "start", "n"])

        for batch in batches:
            found = []
            same = ([], [], [])
            bodies = K.column(batch, "body").to_pylist()
            for mh, key, start, n, body in zip(*(K.column(batch, c).to_pylist() for c in ("mh", "key", "start", "n")), bodies):
                if n < 0:  # marked where it was read
                    for x, y in zip(same, (key, start, -n)):
                        x.append(y)
                    continue
                if mh != group:
                    if len(held) >= CHUNK:
                        found += flush()
                        held = []
                    group, base = mh, None
                if base is not None and body == base[2]:  # single windows of hot seeds meet here, however many
                    for k, s in [(key, start)] + ([(base[0], base[1])] if unit.mark_first else []):
                        same[0].append(k)
                        same[1].append(s)
                        same[2].append(n)
                    continue
                base = base or (key, start, body)
                held.append((key, start, body, mh))
            if same[0]:
                found.append(tuple(np.array(x, np.int64) for x in same))
            if found:
                yield rows(found)
        last = flush()
        if last:
            yield rows(last)

    return run


def repeated_windows(scratch: Scratch, docs: DataFrame, unit: Unit, repeated: Callable, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(key, start, n): runs of window starts that repeat, for documents (key, text).

    ``repeated(bodies, keys, starts, seeds, unit)`` compares the pieces of a chunk and returns (piece, place in it) of the
    windows to mark. Pieces travel by seed; a seed with more than ``hot_pieces`` distinct pieces is split to the hashes of its single
    windows.
    """
    seeds = docs.select("key", "text").mapInArrow(_seeds(unit), SEED).repartition("mh").sortWithinPartitions("mh", "ph", "key", "start")
    kept = scratch.save(seeds.mapInArrow(_group(unit), "mh long, key long, start int, n int"), "seeds")
    pieces = kept.filter("n > 0")
    hot = pieces.groupBy("mh").agg(F.count("*").alias("size")).filter(F.col("size") > hot_pieces).select("mh", F.lit(True).alias("hot"))
    hot = scratch.save(hot, "hot")  # each stands for more than hot_pieces rows, so there are few
    n_hot = hot.count()
    if n_hot:
        pieces = pieces.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "mh", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        pieces = pieces.withColumn("hot", F.lit(False))
    pieces = pieces.select("key", F.struct("mh", "start", "n", "hot").alias("piece"))
    lists = pieces.groupBy("key").agg(F.collect_list("piece").alias("pieces"))  # bounded by a document's length
    bodies = docs.select("key", "text").join(lists, "key").mapInArrow(_extract(unit), "mh long, key long, start int, n int, body binary")
    bodies = bodies.repartition("mh").sortWithinPartitions("mh", "key", "start")
    compared = scratch.save(bodies.mapInArrow(_compare(unit, repeated), "mh long, key long, start int, n int"), "compared")
    return kept.filter("n < 0").unionByName(compared).select("key", "start", (-F.col("n")).alias("n"))


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, doc_id, text, marks) with each document's runs of repeated windows, null if it has none."""
    lists = marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.join(lists, "key", "left")


def covered(marks: list, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of symbols covered by the marked windows."""
    out: list[list[int]] = []
    for a, n in sorted((m["start"], m["n"]) for m in marks or []):
        b = min(a + n + size - 1, length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]

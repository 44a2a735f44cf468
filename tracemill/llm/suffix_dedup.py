"""Suffix-array dedup: repeated byte strings found by a column-wise Burrows-Wheeler construction."""

from __future__ import annotations

import hashlib
import tempfile
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table
from tracemill.llm.windows import HOT_PIECES, Unit, covered, keyed, repeated_windows, with_marks

WINDOW = 100
GRAM = 24
END = 255  # never a byte of UTF-8
FILE_BLOCK = 1 << 22


def count_before(block: np.ndarray, symbol: int, places: np.ndarray) -> np.ndarray:
    """How often the symbol stands in the block before each place: a bit per symbol, counted by words of 64."""
    bits = np.packbits(block == symbol, bitorder="little")
    words = np.zeros(len(block) // 64 + 1, np.uint64)
    words.view(np.uint8)[: len(bits)] = bits
    ones = np.bitwise_count(words)
    word, rest = places >> 6, (places & 63).astype(np.uint64)
    return np.cumsum(ones, dtype=np.int64)[word] - ones[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class CollectionBwt:
    """Burrows-Wheeler transform of a collection of strings, built by columns over sequential files.

    Round j inserts the suffix of length j of every string, that is one symbol per string: the symbol that precedes
    the suffix goes to the transform at the suffix's rank. The rank follows from the symbol inserted a round before:
    the number of smaller symbols in the transform plus that of equal ones above it. A round reads the transform
    twice in sequence, in blocks (to rank, then to merge the new symbols in), and writes the next one; only a block and a
    few integers per string are in memory. Strings end in END, and empty suffixes come first, by string.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, folder: str):
        self.data, self.offs, self.m, self.folder = data, offs, len(offs) - 1, folder
        self.lengths = np.diff(offs)
        self._build()

    def _blocks(self, name: str):
        with open(name, "rb") as f:
            while len(block := np.fromfile(f, np.uint8, FILE_BLOCK)):
                yield block

    def _ranks(self, name: str, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the suffixes that begin with the symbols at these places (ascending) rank."""
        below = self.m + np.concatenate(([0], np.cumsum(counts)[:-1]))
        out, at = np.empty(len(places), np.int64), 0
        for block in self._blocks(name):
            lo, hi = np.searchsorted(places, [at, at + len(block)])
            inside = places[lo:hi] - at
            symbols = block[inside]
            by_symbol = np.argsort(symbols, kind="stable")
            edges = np.flatnonzero(np.diff(symbols[by_symbol], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                who = by_symbol[a:b]
                symbol = symbols[who[0]]
                out[lo + who] = below[symbol] + count_before(block, symbol, inside[who])
            at += len(block)
            if len(block) == FILE_BLOCK:
                below = below + np.bincount(block, minlength=256)
        return out

    def _build(self) -> None:
        name, m = f"{self.folder}/0", self.m
        data = np.append(self.data, np.uint8(END))
        before = lambda who, j: np.where(self.lengths[who] > j, data[self.offs[who + 1] - j - 1], END).astype(np.uint8)
        who = np.arange(m)  # strings in the order of their newest suffix
        symbols = before(who, 0)
        symbols.tofile(name)
        counts = np.bincount(symbols, minlength=256)
        places = np.arange(m)
        for j in range(1, int(self.lengths.max(initial=0)) + 1):
            going = self.lengths[who] >= j
            who, places = who[going], places[going]
            ranks = self._ranks(name, places, counts)
            order = np.argsort(ranks)
            who, places = who[order], ranks[order]
            symbols = before(who, j)
            old, target = places - np.arange(len(places)), f"{self.folder}/{j % 2}.{j}"
            at = 0
            with open(target, "wb") as f:
                for block in self._blocks(name):
                    lo, hi = np.searchsorted(old, [at, at + len(block)])
                    np.insert(block, old[lo:hi] - at, symbols[lo:hi]).tofile(f)
                    at += len(block)
                symbols[np.searchsorted(old, at) :].tofile(f)
            with open(name, "wb"):
                pass  # the old file's space goes back
            name, counts = target, counts + np.bincount(symbols, minlength=256)
        self.file, self.counts = name, counts

    def suffix_ranks(self):
        """(string, length, rank) of all suffixes, the empty ones too, walking the transform backwards."""
        who, places = np.arange(self.m), np.arange(self.m)
        out = [(who, np.zeros(self.m, np.int64), places)]
        for j in range(1, int(self.lengths.max(initial=0)) + 1):
            going = self.lengths[who] >= j
            who, places = who[going], places[going]
            ranks = self._ranks(self.file, places, self.counts) if self.steps is None else self.steps[places]
            order = np.argsort(ranks)
            who, places = who[order], ranks[order]
            out.append((who, np.full(len(who), j), places))
        return tuple(np.concatenate(x) for x in zip(*out))

    @cached_property
    def steps(self) -> np.ndarray | None:
        """Ranks for all places at once, by one sort, if the transform is a single block."""
        if self.counts.sum() > FILE_BLOCK:
            return None
        block = next(self._blocks(self.file))
        out = np.empty(len(block), np.int64)
        out[np.argsort(block, kind="stable")] = np.arange(self.m, self.m + len(block))
        return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b are equal."""
    words = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), (max(len(data) - 7, 0), 8), (1, 1))
    same = np.ones(len(a), bool)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])] if size >= 8 else []:
        live = np.flatnonzero(same)
        same[live] = (words[a[live] + k] == words[b[live] + k]).all(axis=1)
    for k in range(size) if size < 8 else []:
        same &= data[a + k] == data[b + k]
    return same


def seed_places(data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, unit: Unit) -> np.ndarray:
    """Where in its piece each seed stands: all windows hold it, so it is the first such gram from the last window on.

    0 for single windows of hot seeds, which are keyed by their own hash.
    """
    out = np.zeros(len(seeds), np.int64)
    if len(data) >= unit.gram:
        at = np.arange(len(data) - unit.gram + 1)
        piece = np.repeat(np.arange(len(seeds)), np.diff(offs))[: len(at)]
        place = at - offs[piece]
        hit = K.byte_grams(K.limbs(data), unit.gram) == seeds.view(np.uint64)[piece]
        hit &= (place >= np.diff(offs)[piece] - unit.size) & (at + unit.gram <= offs[piece + 1])
        found = np.flatnonzero(hit)[::-1]  # the first one is written last
        out[piece[found]] = place[found]
    return out


def later_windows(bodies: list[bytes], keys: np.ndarray, starts: np.ndarray, seeds: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces that also start earlier: all but the first, by (key, start), of each run of equal windows.

    Equal windows hold the same seed at the same place, so columns are needed from the seed leftwards only: strings end
    at their seeds, and their ends are ordered by what follows (sorted as bytes). In the order of the transform, windows
    that are equal then stand next to each other; whether neighbours have a common prefix of the window's size is read
    off their bytes.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    cut = seed_places(data, offs, seeds, unit)
    order = np.array(sorted(range(len(bodies)), key=[b[c:] for b, c in zip(bodies, cut.tolist())].__getitem__))
    heads = np.frombuffer(b"".join([bodies[i][: cut[i]] for i in order.tolist()]), np.uint8)
    with tempfile.TemporaryDirectory() as folder:
        who, length, rank = CollectionBwt(heads, np.concatenate(([0], np.cumsum(cut[order]))), folder).suffix_ranks()
    who = order[who]
    place = cut[who] - length
    keep = place <= np.diff(offs)[who] - unit.size
    by_rank = np.argsort(rank[keep])
    who, place = who[keep][by_rank], place[keep][by_rank]
    at = offs[who] + place
    head = np.concatenate(([True], ~same_prefix(data, at[1:], at[:-1], unit.size)))
    run = np.cumsum(head) - 1
    begin = starts[who] + place
    by_age = np.lexsort((begin, keys[who], run))
    oldest = np.concatenate(([True], run[by_age][1:] != run[by_age][:-1]))
    later = by_age[~oldest]
    return who[later], place[later]


def _finish(size: int):
    def run(batches):
        for batch in batches:
            data, offs = K.buffers(K.column(batch, "text"))
            marks, out = K.column(batch, "marks").to_pylist(), []
            for i, found in enumerate(marks):
                raw = data[offs[i] : offs[i + 1]]
                spans = covered(found, size, len(raw))
                keep, at, digest = len(raw), 0, hashlib.sha256()
                for a, b in spans:
                    digest.update(raw[at:a])
                    keep -= b - a
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), len(raw) - keep, len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            n, gone, spans, sha, where = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                K.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
                pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_bytes(spark: SparkSession, docs: DataFrame, size: int = WINDOW, gram: int = GRAM, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Per document, the bytes covered by a ``size``-byte string that also starts earlier in the corpus.

    Earlier: in a document with a smaller doc_id, or in the same one. Strings are judged on the input. Candidate pieces
    come from ``windows.repeated_windows``; each chunk of them goes through ``CollectionBwt``, and windows with a
    common prefix of ``size`` bytes with a neighbour in its order repeat. That comparison is of bytes; equal pieces are
    marked before it, by 64-bit hashes of the seed and of the piece.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed), one row per input row. A null text is empty.
    Null doc_ids come after all others; rows that repeat a doc_id are documents of their own, in order of text. An
    empty table gives no rows.
    """
    scratch = Scratch(spark, "suffix-dedup")
    rows = keyed(scratch, docs)
    marks = repeated_windows(scratch, rows, Unit(size, min(gram, size), False, False), later_windows, hot_pieces)
    return with_marks(rows, marks).select("doc_id", "text", "marks").mapInArrow(
        _finish(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated 100-byte strings removed."""
    return repeated_bytes(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")

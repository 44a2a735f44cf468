"""Substring dedup: documents factored against indexed reference blocks (relative Lempel-Ziv)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table
from tracemill.llm.windows import HOT_PIECES, Unit, covered, keyed, repeated_windows, with_marks

WINDOW = 35
GRAM = 8


class ReferenceBlock:
    """Index of a block of word sequences: for every place, the longest match that starts anywhere else in the block.

    Suffixes are ranked by doubling (1, 2, 4 ... words); the ranks of all levels give the common prefix of two
    suffixes. The longest match of a suffix is with a neighbour in suffix order. No match reaches over a sequence's end.
    """

    def __init__(self, codes: np.ndarray, offs: np.ndarray):
        self.offs = offs
        n, longest = len(codes), int(np.diff(offs).max()) if len(offs) > 1 else 0
        room = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        levels, width = [(1, rank)], 1
        while width < longest:
            follow = np.zeros(n, np.int64)
            follow[: n - width] = rank[width:]
            follow[room <= width] = 0  # the sequence ends
            rank = np.unique(rank * np.int64(n + 2) + follow, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
            levels.append((width, rank))
        order = np.argsort(rank, kind="stable")
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        for width, rank in reversed(levels):
            fits = np.flatnonzero((a < n) & (b < n))
            fits = fits[(room[a[fits]] >= width) & (room[b[fits]] >= width)]
            fits = fits[(common[fits] < room[order[:-1][fits]]) & (common[fits] < room[order[1:][fits]])]
            same = fits[rank[a[fits]] == rank[b[fits]]]
            common[same] += width
            a[same] += width
            b[same] += width
        self.match = np.zeros(n, np.int64)
        self.match[order[:-1]] = common
        self.match[order[1:]] = np.maximum(self.match[order[1:]], common)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Greedy factors (start, length) of all sequences: at each place the longest match, or one word."""
        at, stop = self.offs[:-1].copy(), self.offs[1:]
        out = []
        live = np.flatnonzero(at < stop)
        while len(live):
            size = np.maximum(self.match[at[live]], 1)
            out.append((at[live].copy(), size))
            at[live] += size
            live = live[at[live] < stop[live]]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def factored_windows(bodies: list[bytes], keys: np.ndarray, starts: np.ndarray, seeds: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces that also start elsewhere.

    Windows within a factor of the window's size or more repeat. Every other window crosses the end of a factor: those
    are checked one by one against the index.
    """
    codes = np.frombuffer(b"".join(bodies), np.uint64)
    offs = np.concatenate(([0], np.cumsum([len(b) // 8 for b in bodies])))
    block = ReferenceBlock(codes, offs)
    start, size = block.factors()
    inside = np.zeros(len(codes) + 1, np.int64)
    long = size >= unit.size
    np.add.at(inside, start[long], 1)
    np.add.at(inside, start[long] + size[long] - unit.size + 1, -1)
    found = np.cumsum(inside[:-1]) > 0
    crossing = np.zeros(len(codes) + 1, np.int64)
    np.add.at(crossing, np.maximum(start + size - unit.size + 1, start * 0), 1)
    np.add.at(crossing, start + size, -1)
    edge = np.flatnonzero((np.cumsum(crossing[:-1]) > 0) & ~found)
    found[edge[block.match[edge] >= unit.size]] = True
    at = np.flatnonzero(found)
    piece = np.searchsorted(offs, at, side="right") - 1
    return piece, at - offs[piece]


def _finish(size: int):
    def run(batches):
        for batch in batches:
            marks, out = K.column(batch, "marks").to_pylist(), []
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                starts, ends, first = K.words(data, offs, K.SPACE_WORDS)
                raw = data.tobytes()
                for i in range(lo, hi):
                    a, b = int(first[i - lo]), int(first[i - lo + 1])
                    spans = covered(marks[i], size, b - a)
                    keep = np.ones(b - a, bool)
                    for x, y in spans:
                        keep[x:y] = False
                    kept = b" ".join([raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist())])
                    out.append((b - a, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            n, gone, sha, where = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([
                K.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def repeated_words(spark: SparkSession, docs: DataFrame, size: int = WINDOW, gram: int = GRAM, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Per document, the words covered by a run of ``size`` words that also starts anywhere else in the corpus.

    Words are runs of non-space bytes, unchanged; windows are judged on the input and all their occurrences are
    covered. Candidate pieces come from ``windows.repeated_windows``; each chunk of them is a reference block that is
    indexed once (``ReferenceBlock``) and that its documents' pieces are factored against. Words are compared by 64-bit
    hashes.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (word ranges removed), one row
    per input row. A null text has no words. Rows that repeat a doc_id are documents of their own, so each repeats the other;
    null doc_ids are kept. An empty table gives no rows.
    """
    scratch = Scratch(spark, "substring-dedup")
    rows = keyed(scratch, docs)
    marks = repeated_windows(scratch, rows, Unit(size, min(gram, size), True, True), factored_windows, hot_pieces)
    return with_marks(rows, marks).select("doc_id", "text", "marks").mapInArrow(
        _finish(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 35-word passages that also stand elsewhere."""
    return repeated_words(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")

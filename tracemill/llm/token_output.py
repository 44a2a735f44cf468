"""Token ids as binary segments of patched frame-of-reference blocks."""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table

MAGIC = b"PFR1"
BLOCK = 1024  # ids in one block
PERCENTILE = 90  # share of a block's offsets that the packed width holds
SEGMENT_IDS = 1 << 18  # ids after which a segment is closed
CACHE_UNITS = 1_000_000  # units that a worker remembers between batches

# Classes of bytes for cutting a text to units that are encoded apart: white space, ASCII letters and digits, other
# ASCII. The apostrophe and all other bytes bind to both sides, as contractions and combining marks reach over them.
GLUE, SPACE, ALNUM, PUNCT = 0, 1, 2, 3
CLASS = np.full(256, GLUE, dtype=np.uint8)
CLASS[33:127] = PUNCT
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    CLASS[_lo : _hi + 1] = ALNUM
CLASS[9:14] = CLASS[32] = SPACE
CLASS[ord("'")] = GLUE
_CUTS = np.zeros((4, 4), dtype=bool)
_CUTS[SPACE, :] = _CUTS[:, SPACE] = True
_CUTS[ALNUM, PUNCT] = _CUTS[PUNCT, ALNUM] = True
_CUTS = _CUTS.ravel()
# The steps before the model, in a tokenizer's file, for which units may be encoded apart.
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNIT_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class UnitEncoder:
    """Encodes texts unit by unit and remembers the ids of the units it has seen.

    Pre-tokens of this kind of tokenizer never reach over ASCII white space or from an ASCII letter to ASCII
    punctuation, so a text's ids are those of its units in order. Special tokens could: a text with ``<|`` in it is
    encoded whole. Units travel to the library many at a time, with NUL between spaces as a mark; units that hold a
    NUL are encoded alone. All this is read off the tokenizer's file; with any other one, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.by_units = _cuts_to_units(json.loads(self.tokenizer.to_str()))
        self.clear()

    def clear(self) -> None:
        self.table, self.of = K.UnitTable(), np.zeros(0, np.int32)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, number of ids of each)."""
        ids, lengths = [], []
        for lo in range(0, len(units), 4096):
            part = units[lo : lo + 4096]
            text = " \0 ".join(part)
            if len(self.mark) == 1 and text.count("\0") == len(part) - 1:
                found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                marks = np.flatnonzero(found == self.mark[0])
                if len(marks) == len(part) - 1:
                    ids.append(np.delete(found, marks))
                    lengths.append(np.diff(np.concatenate(([-1], marks, [len(found)]))) - 1)
                    continue
            each = [self.whole(u) for u in part]
            ids.append(np.array([i for x in each for i in x], dtype=np.uint32))
            lengths.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if not self.by_units:
            raw = data.tobytes()
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        kind = CLASS[data]
        inside = kind != SPACE
        cut = np.ones(len(data) + 1, dtype=bool)
        cut[1:-1] = _CUTS[kind[:-1] * 4 + kind[1:]]
        cut[offs] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = inside[starts] if len(starts) else np.zeros(0, bool)
        starts, ends = starts[keep], ends[keep]
        glued = np.concatenate(([0], np.cumsum(data >= 128)))
        mixed = np.flatnonzero(glued[ends] != glued[starts])
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[mixed]] += 1
        edge[ends[mixed]] -= 1
        folded = np.where(np.cumsum(edge[:-1]) > 0, data, K.FOLD[data])  # in ASCII units case doesn't matter
        slot = self._slots(folded, starts, ends)
        lengths = self.lengths[slot].astype(np.int64)
        ids = self.ids[np.repeat(self.starts[slot] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(total[np.searchsorted(starts, offs)])

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each unit's ids are, after those of new units have been added; units that the table doesn't hold are added each."""
        if len(self.starts) > CACHE_UNITS or len(self.ids) > 8 * CACHE_UNITS:
            self.clear()
        number, new = self.table.find(data, starts, ends)
        alone = np.flatnonzero(number < 0)
        learn = np.concatenate((new, alone))
        if len(learn):
            raw = data.tobytes()
            found, lengths = self.many([raw[s:e].decode() for s, e in zip(starts[learn].tolist(), ends[learn].tolist())])
            begin = len(self.ids) + np.cumsum(lengths) - lengths
            self.of = np.concatenate((self.of, (len(self.starts) + np.arange(len(new))).astype(np.int32)))
            number_at = len(self.starts) + len(new) + np.arange(len(alone))
            self.starts, self.lengths = np.concatenate((self.starts, begin.astype(np.int32))), np.concatenate((self.lengths, lengths.astype(np.int32)))
            self.ids = np.concatenate((self.ids, found))
        held, out = number >= 0, np.empty(len(number), np.int64)
        out[held] = self.of[number[held]]
        if len(alone):
            out[alone] = number_at
        return out


def _cuts_to_units(spec: dict) -> bool:
    """Whether a tokenizer lower-cases and cuts texts as ``UnitEncoder`` takes it, and has no token with white space in it."""
    normalizer, cutter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [normalizer] if normalizer.get("type") != "Sequence" else normalizer["normalizers"]
    cutters = cutter.get("pretokenizers") or [{}]
    split = cutters[0].get("type") == "Split" and cutters[0].get("pattern") == {"Regex": UNIT_PATTERN} and cutters[0].get("behavior") == "Removed" and cutters[0].get("invert")
    later = all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in cutters[1:])
    return bool(steps == UNIT_NORMALIZERS and split and later and all(t["content"].startswith("<|") for t in spec.get("added_tokens", [])))


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
        K.remember("tokens", lambda: [e.clear() for e in _encoders.values()])
    return _encoders[path]


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids as bytes, and where each block starts.

    A block: minimum (uint32), width in bits (uint8), number of exceptions (uint16), the low ``width`` bits of id - minimum packed from
    the least significant bit up, then the exceptions' places (uint16) and their whole offsets (uint32).
    """
    out, index = io.BytesIO(), []
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo : lo + BLOCK].astype(np.uint32)
        low = int(block.min())
        offset = block - np.uint32(low)
        rank = min(len(offset) - 1, len(offset) * PERCENTILE // 100)
        width = int(np.partition(offset, rank)[rank]).bit_length()
        over = np.flatnonzero(offset >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        bits = (offset[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        index.append(out.tell())
        out.write(struct.pack("<IBH", low, width, len(over)))
        out.write(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        out.write(over.astype("<u2").tobytes())
        out.write(offset[over].astype("<u4").tobytes())
    return out.getvalue(), np.array(index, dtype="<u4")


def unpack(data: bytes, index: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (all by default) of a segment of n ids."""
    out = []
    for k in range(first, len(index) if last is None else last):
        size, at = min(BLOCK, n - k * BLOCK), int(index[k])
        low, width, over = struct.unpack_from("<IBH", data, at)
        at += 7
        used = (size * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=size * width, bitorder="little").reshape(size, width)
        block = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(size, np.uint32)
        at += used
        if over:
            block[np.frombuffer(data, "<u2", over, at)] = np.frombuffer(data, "<u4", over, at + 2 * over)
        out.append(block + np.uint32(low))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """A self-contained segment: header, document index (id, is null, ids), block index, blocks."""
    body, index = pack(ids)
    docs = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype="u1").tobytes()
    head = MAGIC + struct.pack("<III", len(doc_ids), len(ids), len(index))
    return head + docs + np.array(counts, dtype="<u4").tobytes() + index.tobytes() + body


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks = struct.unpack_from("<III", data, 4)
    at = 16
    ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    null = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs)
    at += 9 * n_docs
    counts = np.frombuffer(data, "<u4", n_docs, at)
    index = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_docs)
    body = data[at + 4 * n_docs + 4 * n_blocks :]
    return [None if z else i for i, z in zip(ids, null)], counts, unpack(body, index, n_ids)


SEGMENTS = "part int, seq int, before long, n_docs int, n_ids long, payload binary"


def _encode(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        K.begin("tokens")
        tool, part, seq, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        docs, counts, held, size = [], [], [], 0

        def close():
            nonlocal docs, counts, held, size, seq, before
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_docs": len(docs), "n_ids": size, "payload": segment(docs, counts, np.concatenate(held))}], schema=schema)
            docs, counts, held, before, seq, size = [], [], [], before + size, seq + 1, 0
            return row

        for batch in batches:
            names = K.column(batch, "doc_id").to_pylist()
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                special = data.tobytes().find(b"<|") >= 0
                if special:
                    texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]
                    found = [np.array(tool.whole(t.decode("utf-8")), np.uint32) if b"<|" in t else tool.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
                elif hi - lo == 1 and tool.by_units and len(data) > 2 * K.BLOCK_BYTES:  # a long text, cut at white space
                    found = [np.concatenate([tool.encode(data[a:b], np.array([0, b - a]))[0] for a, b in K.pieces(data, CLASS != SPACE)])]
                else:
                    ids, n = tool.encode(data, offs)
                    found = np.split(ids, np.cumsum(n)[:-1])
                for name, ids in zip(names[lo:hi], found):
                    held += [ids, np.array([end_id], np.uint32)]
                    docs.append(name)
                    counts.append(len(ids) + 1)
                    size += len(ids) + 1
                    if size >= SEGMENT_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def _decode(batches):
    for batch in batches:
        for base, before, payload in zip(K.column(batch, "base").to_pylist(), K.column(batch, "before").to_pylist(), K.column(batch, "payload")):
            docs, counts, ids = read_segment(payload.as_py())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts.astype(np.int64))
            starts = ends - counts
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(starts + base + before, pa.int64()), pa.array(counts.astype(np.int64)),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the written segments.

    Documents are range-partitioned by doc_id and sorted, so parts follow each other in order. Every task streams its
    documents to segments of about ``SEGMENT_IDS`` ids (a longer document is one segment), and Spark's committed
    writer stores them, so a task that is run again leaves nothing behind. ``path`` must be in a folder that all
    executors share. A null text is empty and has the end id only; null doc_ids come first; rows that repeat a doc_id
    are written each, next to each other in the order of a hash of their texts; an empty table writes no segment.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_encode(tokenizer, end_id), SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Where a part starts is the sum over the parts before it: one row per part (as many as tasks that wrote) is ordered
    and broadcast; segments carry their own place within the part.
    """
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return segments.join(F.broadcast(base), "part").select("base", "before", "payload").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the segments and report each document as the files have it; cases as in ``write_tokens``."""
    return tokens_of(spark, read_table(spark, sf_dir, "documents"))


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "tokens")
    return read_tokens(write_tokens(spark, docs, scratch.path("segments"), tokenizer))

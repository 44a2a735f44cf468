"""Token counts: pre-tokens that are one token as they stand are counted directly, only the rest is merged."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table

#: Fixed value: how a byte-level BPE file with ``use_regex`` cuts a text to pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches of text that a worker remembers.
REMEMBERED = 1_000_000


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def cuts_as_known(spec: dict) -> bool:
    """Whether a tokenizer's file cuts texts by ``PRE_TOKENS`` and merges each pre-token by itself, with special strings as plain marks."""
    cutter, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    marks = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]] for t in spec.get("added_tokens", []))
    return bool(plain and marks and not spec.get("normalizer") and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex"))


def prove_whole(path: str) -> list[str]:
    """The vocabulary's strings that encode alone as one token and are one pre-token: each is encoded by the library and looked at.

    As pre-tokens are merged apart from each other, such a string is one token wherever it is a pre-token. At most as many as the
    vocabulary has; none where the file cuts texts in another way than ``PRE_TOKENS``.
    """
    import regex

    tool = load(path)
    if not cuts_as_known(json.loads(tool.to_str())):
        return []
    cut, special = regex.compile(PRE_TOKENS), {t.content for t in tool.get_added_tokens_decoder().values()}
    ids = sorted(tool.get_vocab().values())
    words = [tool.decode([i], skip_special_tokens=False) for i in ids]
    found = tool.encode_batch_fast(words, add_special_tokens=False)
    return [w for i, w, e in zip(ids, words, found) if w and w not in special and e.ids == [i] and cut.fullmatch(w)]


def unsettled() -> str:
    """A character class of the code points that Unicode 3.2 had not assigned: libraries of different age take them for different things."""
    old = unicodedata.ucd_3_2_0
    new = np.array([old.category(chr(c)) == "Cn" for c in range(0x110000)])
    starts, ends = K.runs(new)
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(starts.tolist(), ends.tolist())) + "]"


# Classes of bytes for cutting a text to stretches that are counted apart.
SPACE, WORD, PUNCT, OTHER = 0, 1, 2, 3
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[33:127] = PUNCT
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    CLASS[_lo : _hi + 1] = WORD
CLASS[9:14] = CLASS[32] = SPACE


def stretches(data: np.ndarray, offs: np.ndarray, fine: bool) -> np.ndarray:
    """Where texts are cut, text ends included: no pre-token reaches over.

    Before ASCII white space that follows a character that is none (white space beyond ASCII binds), and, if ``fine``, before
    ASCII punctuation that follows an ASCII letter or digit. Other control characters bind.
    """
    kind = CLASS[data]
    space = kind == SPACE
    if (data >= 128).any():
        wide = np.zeros(len(data), bool)
        one, two, three = data[2:], data[1:-1], data[:-2]
        wide[2:] = ((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        wide[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    else:
        wide = np.zeros(len(data), bool)
    ends = ~space & ~wide & ((kind != OTHER) | (data >= 128))
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ends[:-1] & space[1:]
    if fine:
        cut[1:-1] |= (kind[:-1] == WORD) & (kind[1:] == PUNCT)
    cut[offs] = True
    return np.flatnonzero(cut)


class Counter:
    """Counts the tokens of texts as the library gives them.

    Texts are cut to stretches (``stretches``), which a table of fixed size remembers with their counts. A new stretch is
    cut at special strings and then to pre-tokens: those proved whole count one, the others as many as the merges give.
    Stretches with code points younger than Unicode 3.2, on whose class libraries differ, are encoded whole.
    """

    def __init__(self, path: str, whole: list[str], new: str):
        import regex

        self.tool, self.known, self.whole = load(path), bool(whole), frozenset(whole)
        self.cut, self.new = regex.compile(PRE_TOKENS), regex.compile(new)
        self.specials = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.mark = regex.compile("|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.clear()

    def clear(self) -> None:
        self.table, self.counts = K.UnitTable(), np.zeros(0, np.int64)

    def merged(self, text: str) -> int:
        return len(self.tool.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> int:
        """Tokens of a stretch without special strings."""
        if self.new.search(text):
            return self.merged(text)
        return sum(1 if t in self.whole else self.merged(t) for t in self.cut.findall(text))

    def stretch(self, text: str) -> int:
        parts = self.mark.split(text) if self.mark else [text]
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)

    def many(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        raw = data.tobytes()
        if not self.known:
            return np.array([self.merged(raw[a:b].decode()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int64)
        edges = stretches(data, offs, not any(t.encode() in raw for t in self.specials))
        starts, ends = edges[:-1], edges[1:]
        if len(self.table) > REMEMBERED:
            self.clear()
        number, new = self.table.find(data, starts, ends)
        learnt = [self.stretch(raw[a:b].decode()) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        self.counts = np.concatenate((self.counts, np.array(learnt, np.int64)))
        held, each = number >= 0, np.zeros(len(number) + 1, np.int64)
        each[:-1][held] = self.counts[number[held]]
        for i in np.flatnonzero(~held).tolist():
            each[i] = self.stretch(raw[starts[i] : ends[i]].decode())
        total = np.concatenate(([0], np.cumsum(each[:-1])))
        return np.diff(total[np.searchsorted(starts, offs)])

    def texts(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text; a long one is taken in pieces, cut before white space as stretches are."""
        out = [np.zeros(0, np.int64)]
        for lo, hi, data, offs in K.text_blocks(array):
            if hi - lo == 1 and self.known and len(data) > 2 * K.BLOCK_BYTES:
                out.append(np.array([sum(int(self.many(data[a:b], np.array([0, b - a]))[0]) for a, b in pieces(data))]))
            else:
                out.append(self.many(data, offs))
        return np.concatenate(out)


def pieces(data: np.ndarray):
    """(begin, end) of pieces of a long text that end where a stretch does."""
    begin = 0
    while begin < len(data):
        end, step = begin + K.BLOCK_BYTES, K.BLOCK_BYTES
        while end < len(data):  # looks further ahead until there is a cut
            part = data[end - 4 : end + step]
            found = stretches(part, np.array([0, len(part)]), False)
            found = found[(found > 4) & (found < len(part))]
            if len(found):
                end += int(found[0]) - 4
                break
            end += step
        end = min(end, len(data))
        yield begin, end
        begin = end


_counters: dict[str, Counter] = {}


def _count(path: str, proof):
    def run(batches):
        K.begin("counts")
        K.remember("counts", lambda: [c.clear() for c in _counters.values()])
        if path not in _counters:  # one for each Python worker
            _counters[path] = Counter(path, *proof.value)
        tool = _counters[path]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id"), K.column(batch, "n_bytes"), pa.array(tool.texts(K.column(batch, "text")))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text, as the library counts them by the tokenizer's JSON file.

    No begin, end or other added token is counted; special strings inside a text are what the library makes of them. Files that cut
    texts in another way than ``PRE_TOKENS`` are counted by the library alone. What is proved on the driver, once, is as large as
    the vocabulary at most and goes out as a broadcast. Nothing is shuffled. A null text is empty: 0 bytes, 0 tokens. Repeated rows and
    null doc_ids are counted each; an empty table gives no rows; other columns are neither read nor returned.
    """
    Scratch(spark, "token-counts")  # batch size
    proof = spark.sparkContext.broadcast((prove_whole(tokenizer), unsettled()))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_count(tokenizer, proof), "doc_id long, n_bytes long, n_tokens long")


def op12_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of all documents, and whether there are more than ``limit`` tokens; cases as in ``count_tokens``."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > limit)

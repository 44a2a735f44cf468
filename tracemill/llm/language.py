"""Language ID with error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, fresh, read_table
from tracemill.llm.quality import held_out

#: Labelled rows that fitting reads at most, for each language and for all of them (8 KB of features each on the driver).
SAMPLE_ROWS = 500
SAMPLE_TOTAL = 10_000
#: Languages are as many as label values; more than this is taken for a wrong column.
MAX_LANGUAGES = 2000
DIMENSIONS = 4096
UNKNOWN = "und"
#: A prediction is ambiguous below this score.
AMBIGUOUS = 0.6


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of -1 and 1 for each class.

    Up to 7 classes: every split into two, 2^(n-1) - 1 bits, so that any two rows differ in 2^(n-2) of them. More:
    of 64 random codes of 8 log2(n) bits, that whose closest rows are farthest apart.
    """
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 7:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1)][1:], dtype=np.int8).T.copy()
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, 8 * int(np.ceil(np.log2(n)))))
        near = (code.astype(np.int32) @ code.T.astype(np.int32)) - 10**6 * np.eye(n, dtype=np.int32)
        gap = int(code.shape[1] - near.max()) // 2
        if gap > far and not (np.abs(code.sum(axis=0)) == n).any():
            best, far = code, gap
    return best


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of hashed counts of 1-, 2- and 3-byte grams of each text, A-Z lower-cased: square roots, unit length.

    A long text is counted in pieces, each with two bytes of the next, of which no gram of its own begins.
    """
    n, step = len(offs) - 1, K.BLOCK_BYTES
    if n == 1 and len(data) > 2 * step:
        out = sum(_counts(data[a : a + step + 2], np.array([0, min(step + 2, len(data) - a)]), step) for a in range(0, len(data), step))
    else:
        out = _counts(data, offs, len(data))
    x = np.sqrt(out.reshape(n, DIMENSIONS).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _counts(data: np.ndarray, offs: np.ndarray, begins: int) -> np.ndarray:
    """Hashed counts of the grams that begin before the byte ``begins``, text after text."""
    n = len(offs) - 1
    b = K.FOLD[data].astype(np.int64)
    own = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs)) * DIMENSIONS
    size = np.diff(offs)
    room = np.repeat(offs[1:], size) - np.arange(len(b)) if len(b) else np.zeros(0, np.int64)  # bytes from here to the text's end
    out = np.bincount((own + b)[:begins], minlength=n * DIMENSIONS)
    for k, (m1, m2) in ((2, (263, 0)), (3, (69_069, 331))):
        if len(b) >= k:
            h = b[: len(b) - k + 1] * m1 + b[1 : len(b) - k + 2] * 40_503 + (b[2:] * m2 if k == 3 else 0)
            h = ((h * 2_654_435_761) >> 15) & (DIMENSIONS - 1)
            ok = (room[: len(h)] >= k) & (np.arange(len(h)) < begins)
            out += np.bincount((own[: len(h)] + h)[ok], minlength=n * DIMENSIONS)
    return out


class Model:
    """Languages, their codewords and the bits' linear classifiers."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.code, self.weights, self.bias = langs, code, weights, bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword by summed logistic loss of the bits' margins, and its share of the softmax."""
        if not self.langs:
            return np.full(len(x), -1), np.zeros(len(x))
        margin = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c).sum(axis=1) for c in self.code], axis=1)
        near = -(loss - loss.min(axis=1, keepdims=True)) / max(1, self.code.shape[1]) * 4
        share = np.exp(near) / np.exp(near).sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, share[np.arange(len(x)), best]


def train_bits(x: np.ndarray, signs: np.ndarray, steps: int = 300, rate: float = 20.0, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once by gradient descent with momentum."""
    w, b = np.zeros((x.shape[1], signs.shape[1]), np.float32), np.zeros(signs.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = signs / (1 + np.exp(np.clip((x @ w + b) * signs, -60, 60))) / len(x)
        vw = 0.9 * vw + x.T @ pull - ridge * w
        vb = 0.9 * vb + pull.sum(axis=0)
        w, b = w + rate * vw, b + rate * 0.1 * vb
    return w, b


def _featurise(batches):
    for batch in batches:
        for lo, hi, data, offs in K.text_blocks(K.column(batch, "text"), 1 << 19):
            x = features(data, offs).astype(np.float16)
            yield pa.RecordBatch.from_arrays([K.column(batch, "lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit_languages(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on the rows given (doc_id, text, lang): at most about ``sample_rows`` for each language and ``SAMPLE_TOTAL`` in
    all, by a hash of doc_id.

    Rows without text, doc_id or lang are not learnt from. One language gives a model that always answers it; none
    gives one that answers ``und``.
    """
    rows = docs.filter("doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in counts)
    sample_rows = min(sample_rows, max(1, SAMPLE_TOTAL // max(1, len(langs))))
    share = spark.createDataFrame([(r["lang"], min(1.0, sample_rows / r["n"])) for r in counts], "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32))
    seen = picked.select("lang", "text").mapInArrow(_featurise, "lang string, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in seen]).astype(np.float32)
    at = {k: i for i, k in enumerate(langs)}
    return Model(langs, code, *train_bits(x, code[[at[r["lang"]] for r in seen]].astype(np.float32)))


def _predict(model):
    def run(batches):
        K.begin("language")
        m = model.value
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in batches:
            letters, found, scores = K.column(batch, "has_letter").to_numpy(zero_copy_only=False), [], []
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text"), 1 << 19):
                best, share = m.decode(features(data, offs))
                best = np.where(letters[lo:hi], best, -1)
                found.append(names[best])
                scores.append(np.where(best < 0, 0.0, share))
            yield pa.RecordBatch.from_arrays([
                K.column(batch, "doc_id"), pa.array(np.concatenate(found) if found else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()),
            ], names=["doc_id", "lang_pred", "score"])

    return run


def predict_languages(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row's whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Repeated rows are each judged;
    other columns are neither read nor returned; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    found = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
    return found.withColumn("ambiguous", F.col("score") < AMBIGUOUS)


def _keep_known(model, least: float, has_letter: str):
    def run(batches):
        K.begin("language")
        m = model.value
        for batch in batches:
            letters, keep = K.column(batch, has_letter).to_numpy(zero_copy_only=False), []
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text"), 1 << 19):
                keep.append((m.decode(features(data, offs))[1] >= least) & letters[lo:hi])
            yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_())).drop_columns([has_letter])

    return run


def keep_known(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is told: with a letter, and with a score of at least ``least``.

    Null and empty texts go; every other row is judged by its own text, whatever its doc_id; all columns stay as they are.
    """
    name = fresh(docs, "has_letter")
    rows = docs.withColumn(name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_keep_known(spark.sparkContext.broadcast(model), least, name), docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out fold; null doc_ids are held out, other cases as in ``predict_languages``."""
    Scratch(spark, "language")  # batch size
    docs = read_table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 3, 1)
    found = predict_languages(spark, docs, fit_languages(spark, docs.filter(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", F.col("score").cast("double").alias("score"), "ambiguous")

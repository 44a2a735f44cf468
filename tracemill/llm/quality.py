"""Quality classifier: which of two zstandard dictionaries, of good or of bad texts, compresses a text better."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, read_table

#: Labelled rows that fitting reads at most, for each class: one in four builds the dictionary, the others calibrate.
SAMPLE_ROWS = 2000
DICTIONARY_SHARE = 4
#: Characters that one labelled text adds to the dictionary, so that it has about a million at most.
PIECE_CHARS = 2000
LEVEL = 6
#: Bytes that are compressed at once: zstandard drops a dictionary when a text has moved past its window, about 2 MB at this level.
CHUNK_BYTES = 256 << 10
THRESHOLD = 0.7


def held_out(doc_id, parts: int, part: int):
    """crc32 of the doc_id's text modulo ``parts`` is ``part``; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


class Scorer:
    """Two dictionaries and a logistic calibration of the normalised size difference."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, intercept: float = 0.0, level: int = LEVEL):
        self.good, self.bad, self.slope, self.intercept, self.level = good, bad, slope, intercept, level
        self._tools = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"} | {"_tools": None}

    def tools(self):
        if self._tools is None:
            import zstandard

            made = []
            for content in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
                if words:
                    words.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=words))
            self._tools = made
        return self._tools

    def difference(self, text: bytes) -> float:
        """(size with bad dictionary - size with good dictionary) / square root of bytes; 0 for an empty text.

        A text is compressed in consecutive pieces of ``CHUNK_BYTES``, each with the whole dictionary. The difference of
        its two sizes is a sum over its pieces, whose spread grows as the square root.
        """
        good, bad = self.tools()
        pieces = (text[a : a + CHUNK_BYTES] for a in range(0, len(text), CHUNK_BYTES))
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) / math.sqrt(len(text)) if text else 0.0

    def score(self, difference: float) -> float:
        z = self.slope * difference + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a slight ridge."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        w = weight * p * (1 - p)
        hessian = (design * w[:, None]).T @ design + 1e-4 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (weight * (y - p)) - 1e-4 * beta), -20, 20)
    return float(beta[0]), float(beta[1])


def _differences(scorer, extra: list[str]):
    def run(batches):
        tool = scorer.value
        for batch in batches:
            data, offs = K.buffers(K.column(batch, "text"))
            raw = memoryview(data)
            out = [tool.difference(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id"), *(K.column(batch, c) for c in extra), pa.array(out, pa.float64())], names=["doc_id", *extra, "difference"])

    return run


def fit_quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, piece_chars: int = PIECE_CHARS
) -> Scorer:
    """Dictionaries and calibration from the labelled rows given (doc_id, quality).

    Of each class at most about ``sample_rows`` rows are used, chosen by a hash of doc_id: one in ``DICTIONARY_SHARE`` gives a piece
    of ``piece_chars`` characters from a hashed place to the class's dictionary, and all these pieces are in it; the others,
    unseen by the dictionaries, calibrate. Calibration rows are weighted so that the classes have their shares of all labels.
    Labels that are null and rows without text count as unlabelled; repeated labels count once. With one class or none the score
    is 0.5 or that class's share.
    """
    labels = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    pick = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    bound = F.when(F.col("quality") == 1, F.lit(min(1.0, sample_rows / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample_rows / max(counts.get(0, 0), 1))))
    sample = labels.filter(pick < bound * (1 << 30))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")  # about 2 * sample_rows rows
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(DICTIONARY_SHARE)))
    place = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.greatest(F.lit(1), F.length("text") - piece_chars + 1)).cast("int") + 1
    pieces = rows.filter("part = 0").select("quality", F.col("text").substr(place, F.lit(piece_chars)).alias("piece"), F.xxhash64(F.lit(10), "doc_id").alias("turn"))
    content = {0: [], 1: []}
    for r in sorted(pieces.collect(), key=lambda r: r["turn"]):
        content[r["quality"]].append(r["piece"].encode())
    good, bad = (b"\n".join(content[k]) for k in (1, 0))
    scorer = Scorer(good, bad)
    seen = rows.filter("part > 0").select("doc_id", "text", "quality").mapInArrow(_differences(spark.sparkContext.broadcast(scorer), ["quality"]), "doc_id long, quality int, difference double").select("quality", "difference").collect()
    y = np.array([r["quality"] for r in seen], dtype=float)
    x = np.array([r["difference"] for r in seen])
    if len(set(y)) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Scorer(good, bad, 0.0, math.log(share / (1 - share)))
    weight = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    return Scorer(good, bad, *fit_logistic(x, y, weight))


def score_quality(spark: SparkSession, docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every row's whole text; null is empty, repeated rows are each scored, other columns are left out."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_differences(spark.sparkContext.broadcast(scorer), []), "doc_id long, difference double")
    z = F.col("difference") * scorer.slope + F.lit(scorer.intercept)
    return found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-700.0), z)))).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fold; null doc_ids are held out, other cases as in ``score_quality``."""
    Scratch(spark, "quality")  # batch size
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scorer = fit_quality(spark, docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    scored = score_quality(spark, docs, scorer)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

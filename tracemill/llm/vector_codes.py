"""Vector code compression: integer product quantisation, nearest entries found by partial-distance search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm.common import BROADCAST_ROWS, Scratch, read_table

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors searched at once, dimensions after which entries are looked at, and the share of entries from which on they are dropped one by one.
BLOCK_ROWS, GROUP, SHARE = 2048, 4, 1 / 3


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index on ties.

    Dimensions come in descending variance over the codebook. After each few of them the entry that leads is completed, which may be
    the best so far, and a mask tells which (row, entry) pairs strictly exceed their row's best. While most pairs are alive, sums go
    on for all of them; then the others are dropped, and more after each further dimension. What is left at the end is
    complete, and an entry as near as the best is never dropped.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    most = int(max(np.abs(x).max(), np.abs(book).max()))
    kind = np.int32 if (2 * most + 1) ** 2 * x.shape[1] < 1 << 31 else np.int64
    x, book = (np.ascontiguousarray(a[:, order].T.astype(kind)) for a in (x, book))
    width, n, entries = len(x), x.shape[1], book.shape[1]
    sums, best, d, alive = np.zeros((n, entries), kind), np.full(n, np.iinfo(kind).max, kind), 0, None
    while d < width and (alive is None or alive.mean() > SHARE):
        for d in range(d, min(d + GROUP, width)):  # noqa: B020
            apart = x[d][:, None] - book[d][None, :]
            sums += apart * apart
        d += 1
        best = np.minimum(best, ((x - book[:, sums.argmin(axis=1)]) ** 2).sum(axis=0, dtype=kind))
        alive = sums <= best[:, None]
    at = np.flatnonzero(alive)
    row, entry, sums = at // entries, at % entries, sums.ravel()[at]
    for d in range(d, width):  # noqa: B020
        apart = x[d][row] - book[d][entry]
        sums += apart * apart
        stay = sums <= best[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
    least = np.minimum.reduceat(sums, np.searchsorted(row, np.arange(n)))
    hit = np.flatnonzero(sums == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(n))]], least.astype(np.int64)


def _vectors(batch: pa.RecordBatch, width: int):
    """Blocks of (first row, integer vectors) of a batch."""
    lists = K.column(batch, "comps")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)
    for lo in range(0, len(flat), BLOCK_ROWS):
        yield lo, flat[lo : lo + BLOCK_ROWS]


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _sums(books):
    """Vectors to sums and counts of the parts assigned to each entry: at most a row for each entry and task."""

    def run(batches):
        book = books.value
        parts, entries, size = book.shape
        total, count = np.zeros(book.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in _vectors(batch, parts * size):
                for p in range(parts):
                    mine = x[:, p * size : (p + 1) * size]
                    at, _ = nearest(mine, book[p])
                    by_entry = np.argsort(at, kind="stable")
                    found, first = np.unique(at[by_entry], return_index=True)
                    total[p][found] += np.add.reduceat(mine[by_entry], first, axis=0)
                    count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=SUMS)

    return run


def _add(batches):
    """Adds up the rows of each entry that meet in a task."""
    found: dict = {}
    for batch in batches:
        for part, entry, n, total in zip(*(c.to_pylist() for c in batch.columns)):
            have = found.get((part, entry))
            found[part, entry] = (n + have[0], np.array(total) + have[1]) if have else (n, np.array(total))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.list_(pa.int64()))], schema=SUMS)


def _codes(books):
    def run(batches):
        book = books.value
        parts, _, size = book.shape
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, x in _vectors(batch, parts * size):
                for p in range(parts):
                    codes[lo : lo + len(x), p], distance = nearest(x[:, p * size : (p + 1) * size], book[p])
                    error[lo : lo + len(x)] += distance
            yield pa.RecordBatch.from_arrays([K.column(batch, "vec_id"), K.column(batch, "label"), pa.array(["".join(f"{i:02x}" for i in r) for r in codes.tolist()], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, comps: floor(scale * component) of the vectors without null or non-finite components, null and empty vectors left out.

    Components beyond 2^27 are taken as 2^27, so that squared distances fit 64 bits (up to 64 dimensions; ``compress`` narrows
    the bound for longer vectors).
    """
    bound = float(1 << 27)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    step = lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double") * scale))).cast("int")
    return vectors.filter(F.size("embedding") > 0).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", step).alias("comps"))


def compress(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors (vec_id, label, embedding), and the codebooks (part, entry, position).

    Integer vectors are written once. Each part's codebook starts as that part of the ``entries`` smallest vec_ids; a round sums, in
    each task, the parts nearest to each entry, and the driver gets a row for each entry (parts * entries of them), whose
    floored means are the next codebook. Every round reads what was written, so a lost executor costs a task. The codes
    (vec_id, label, code as two hex digits a part, error) are read back from the shared folder.

    Vectors that are null or empty or hold null or non-finite components are dropped, and those that are not as long as the one of
    the smallest vec_id. A length that isn't a multiple of ``parts`` is filled with zeros. With fewer vectors than
    ``entries``, codebooks are as long as there are vectors; equal vectors fill entries of their own, and the first of them
    is used. Null vec_ids come last, repeated vec_ids in the order of their vectors; other columns are ignored. An empty
    table gives no codes and codebooks without entries.
    """
    scratch = Scratch(spark, "vector-codes")
    kept = scratch.save(integer_vectors(vectors), "integers")
    order = [F.asc_nulls_last("vec_id"), "comps"]
    first = kept.orderBy(*order).select(F.size("comps").alias("n")).first()
    width = first["n"] if first else parts
    size = -(-width // parts)
    bound = min(1 << 27, math.isqrt((1 << 62) // (parts * size)) // 2)
    kept = kept.filter(F.size("comps") == width)
    if bound < 1 << 27:
        kept = kept.withColumn("comps", F.transform("comps", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))
    if width < parts * size:
        kept = kept.withColumn("comps", F.concat("comps", F.array_repeat(F.lit(0), parts * size - width)))
    start = kept.orderBy(*order).limit(entries).select("comps").collect()
    books = np.array([r["comps"] for r in start], dtype=np.int64).reshape(len(start), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        each = kept.select("comps").mapInArrow(_sums(spark.sparkContext.broadcast(books)), "part int, entry int, n long, total array<long>")
        for r in each.repartition("part", "entry").mapInArrow(_add, each.schema).collect():  # parts * entries rows at most
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    label = kept.schema["label"].dataType.simpleString()
    codes = scratch.save(kept.mapInArrow(_codes(spark.sparkContext.broadcast(books)), f"vec_id long, label {label}, code string, error long"), "codes")
    scratch.drop("integers")
    return codes, books


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """Integer vectors that codes stand for."""
    at = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(len(books))] for c in codes], dtype=np.int64).reshape(len(codes), len(books))
    return np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over rows of the same label, nulls together; label sums are broadcast up to ``BROADCAST_ROWS`` labels."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("label_error")).withColumn("label_error", F.least("label_error", F.lit((1 << 63) - 1)).cast("long"))
    few = codes.select("label").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors with the codebooks' hash; cases as in ``compress``."""
    codes, books = compress(spark, read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))

"""Vector codes against plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracemill.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label), entry by entry in Python's integers."""
    kept = [(v, [math.floor(1024 * float(x)) for x in e], y) for v, e, y in rows if e is not None and all(x is not None and math.isfinite(x) for x in e) and e]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    books = [[r[1][p * size : (p + 1) * size] for r in kept[:entries]] for p in range(parts)]

    def assign(e):
        out = []
        for p in range(parts):
            mine = e[p * size : (p + 1) * size]
            d = [sum((a - b) ** 2 for a, b in zip(mine, c)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = [assign(e) for _, e, _ in kept]
        for p in range(parts):
            members = {}
            for (_, e, _), f in zip(kept, found):
                members.setdefault(f[p][0], []).append(e[p * size : (p + 1) * size])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    found = [assign(e) for _, e, _ in kept]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    label = Counter()
    for (_, _, y), f in zip(kept, found):
        label[y] += sum(d for _, d in f)
    return [(v, "".join(f"{k:02x}" for k, _ in f), sum(d for _, d in f), label[y], sha) for (v, _, y), f in zip(kept, found)]


def table(rows):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32()), "code": pa.array(["x"] * len(rows)), "error": pa.array([None] * len(rows), pa.string()), "of": pa.array([1] * len(rows))})


def made(n, width, seed=1):
    rng = random.Random(seed)
    f = lambda: float(np.float32(rng.choice([rng.uniform(-1, 1), rng.gauss(0, 0.1), 0.5, 0.0])))
    rows = [(i * 3, [f() for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(7 + i * 3, rows[0][1], 1) for i in range(20)]  # one common vector
    rows += [rows[3], (rows[4][0], rows[5][1], None), (None, rows[6][1], 2), (None, rows[7][1], None)]
    rows += [(1, None, 0), (2, [None] * width, 1), (5, [float("nan")] * width, 1), (8, [float("inf")] + [0.0] * (width - 1), 2), (11, [float("-inf")] * width, None), (-1, [], 3)]
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n,width", [(300, 8), (40, 12)])
def test_op13(spark, tmp_path, n, width):
    rows = made(n, width)
    pq.write_table(table(rows), f"{tmp_path}/embeddings.parquet")
    got = V.op13_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got) == Counter(plain(rows))


def test_parts_follow_no_partitioning(spark, tmp_path):
    frame = spark.createDataFrame(made(120, 8, 2), "vec_id long, embedding array<float>, label int")
    a, b = (V.compress(spark, frame.repartition(k), entries=16) for k in (1, 7))
    assert (a[1] == b[1]).all() and Counter(map(tuple, a[0].collect())) == Counter(map(tuple, b[0].collect()))


def test_empty(spark, tmp_path):
    pq.write_table(table([]), f"{tmp_path}/embeddings.parquet")
    assert V.op13_vector_codes(spark, str(tmp_path)).count() == 0


def test_odd_lengths_and_large_components(spark):
    big = 3e38
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (2, [big, -big, 0.0, 0.0, 1.0], 0), (3, [1.0, 2.0], 1), (4, [1.0, 2.0, 3.0, 4.0, 5.5], 1)]
    codes, books = V.compress(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.code, r.error) for r in codes.collect()}
    assert set(got) == {1, 2, 4} and books.shape == (4, 3, 2) and got[1] == ("00000000", 0) and got[2] == ("01010100", 0) and got[4] == ("00000200", 0)
    assert V.decode([got[2][0]], books)[0].tolist()[:2] == [1 << 27, -(1 << 27)]


def test_partial_distances_are_exact():
    rng = np.random.default_rng(4)
    for high in (2, 6, 2000):
        for width in (1, 3, 16):
            x, book = rng.integers(-high, high, (500, width)), rng.integers(-high, high, (97, width))
            book[50:60] = book[0]
            full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            at, distance = V.nearest(x, book)
            assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert len(V.nearest(np.zeros((0, 4), np.int64), book[:, :4])[0]) == 0


def test_decode_round_trip(spark):
    frame = spark.createDataFrame(made(60, 8, 3), "vec_id long, embedding array<float>, label int")
    codes, books = V.compress(spark, frame, entries=32)
    comps = {(r.vec_id, tuple(r.comps)) for r in V.integer_vectors(frame).collect()}
    for r in codes.collect():
        near = V.decode([r.code], books)[0]
        assert any(v == r.vec_id and sum((a - int(b)) ** 2 for a, b in zip(c, near)) == r.error for v, c in comps)

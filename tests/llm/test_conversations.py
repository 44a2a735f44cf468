"""Conversation repair against a plain search over strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracemill.llm import conversations as C
from tracemill.llm import turn_grammar as G

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows):
    """(cost, audit, turns) of (role, text, fault): least (cost, audit) of every place and state, row by row."""

    def insertions(best):
        for _ in range(3):
            for s, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in STEP[s]:
                        put(best, STEP[s][role[0]], (cost + 2, audit + "I", [*turns, (role, "")]))
        return best

    def put(best, s, found):
        if s not in best or found[:2] < best[s][:2]:
            best[s] = found

    best = insertions({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, turns) in best.items():
            put(new, s, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in STEP[s]:
                    put(new, STEP[s][role[:1]], (cost + more, audit + "K", [*turns, (role, text)]))
                for other in ("user", "assistant"):
                    if other[0] in STEP[s]:
                        put(new, STEP[s][other[0]], (cost + 2 + more, audit + "R", [*turns, (other, text)]))
        best = insertions(new)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_report(rows):
    """The contract's columns of the (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = plain_faults([r[1:] for r in rows])
    turns = {r[0] for r in rows} - {None}
    first = [r[1][:1] for r in rows]
    cost, audit, kept = plain_repair([(r[1], r[2], f) for r, f in zip(rows, faults)])
    counts = Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


def plain(rows):
    left = defaultdict(list)
    for c, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        left[c] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return Counter((c, *plain_report(v)) for c, v in left.items())


def table(rows):
    n = len(rows)
    return pa.table({
        "conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string()),
        **{c: pa.array([None] * n, pa.string()) for c in ("c", "cls", "blank", "kind", "pos", "n", "long_id")},
    })


def made(seed=2, n=400):
    rng = random.Random(seed)
    texts = ["Yes.", "No, not that", "What?", "Well!  \n", "", " \t", "ünï. ", ".", "a. b", "Same. ", "　", "A very long turn. " * 200]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, t * rng.choice([1, 1, 2]) - 3, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ass", "uu"]), rng.choice(texts)))
    for c in range(n, n + 30):  # well formed
        rows += [(c, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, None, "Ho."), (None, None, "assistant", "x."), (1, None, "user", None), (2, None, None, None), (3, 5, "user", "a."), (3, 5, "assistant", "b."), (3, 5, "user", "a.")]
    rows += [(n + 40, t, "user" if t % 3 else "assistant", f"{t % 90}.") for t in range(300)] + [(n + 41, 7, "user", "again.")] * 200
    gone = next(t for t in range(100) if zlib.crc32(f"{n + 50}:{t}".encode()) % 20 == 0)
    rows += [(n + 50, gone, "user", "Only turn, and dropped.")]
    rng.shuffle(rows)
    return rows


def rows_of(df):
    assert df.columns[:1] == ["conv_id"]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("long_rows", [4096, 6])
def test_op11(spark, tmp_path, monkeypatch, long_rows):
    monkeypatch.setattr(C, "LONG_ROWS", long_rows)
    monkeypatch.setattr(C, "PIECE_BITS", 16 if long_rows > 6 else 2)
    rows = made()
    pq.write_table(table(rows), f"{tmp_path}/conversations.parquet")
    got, want = rows_of(C.op11_conversations(spark, str(tmp_path))), plain(rows)
    assert len(want) > 350 and got == want


def test_empty(spark, tmp_path):
    pq.write_table(table([]), f"{tmp_path}/conversations.parquet")
    assert C.op11_conversations(spark, str(tmp_path)).count() == 0


def test_real_turns(spark):
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    assert rows_of(C.op11_conversations(spark, "/root/testdata/sf0.01")) == plain(rows)


@pytest.mark.parametrize("long_rows", [4096, 1])
def test_turns_are_those_of_the_hash(spark, monkeypatch, long_rows):
    monkeypatch.setattr(C, "LONG_ROWS", long_rows)
    frame = spark.createDataFrame([r for r in made(5, 60) if r[0] != 1], "conv_id long, turn long, role string, text string")
    repairs = C.repair_conversations(spark, frame)
    turns = defaultdict(list)
    for r in C.repaired_turns(repairs).orderBy("place", "step").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.text == "" or r.text.strip(" \t\n")
    for r in C.repaired_digests(repairs).collect():
        lines = turns[r.conv_id]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_every_short_sequence():
    """All sequences of up to four rows over classes and faults."""
    rows = [np.array(x, dtype=np.int64) for n in range(5) for x in itertools.product([0, 1, 2, 3, 13, 14, 12, 5], repeat=n)]
    faults = {0: None, 1: "blank", 2: "duplicate", 3: "truncated"}
    for r, found in zip(rows, G.solve(rows)):
        cost, audit, turns = plain_repair([("suat"[c & 3], "t", faults[c >> 2]) for c in r.tolist()])
        assert (found["cost"], "".join(found["edits"]) + found["tail"]) == (cost, audit)
        shown = {"u": "u", "a": "a", "U": "u", "A": "a"}
        wrote = "".join(shown.get(x, "suat"[c & 3]) for done, c in zip(G.actions(r, found["edits"], found["tail"]), [*r.tolist(), 0]) for x in done if x != "D")
        assert wrote == "".join(t[0] for t, _ in turns)


def test_long_sequences_in_chunks():
    rng = random.Random(9)
    for n, chunk in [(300, G.CHUNK), (65, G.CHUNK), (129, G.CHUNK)]:
        for weights in ([1, 8, 8, 1], [1, 1, 1, 6], [0, 1, 0, 0], [5, 1, 1, 0]):
            codes = np.array([rng.choices(range(4), weights)[0] + 4 * rng.choice([0, 0, 0, 3, 2, 1]) for _ in range(n)])
            faults = {0: None, 1: "blank", 2: "duplicate", 3: "truncated"}
            found = G.solve([codes])[0]
            cost, audit, _ = plain_repair([("suat"[c & 3], "t", faults[c >> 2]) for c in codes.tolist()])
            assert (found["cost"], "".join(found["edits"]) + found["tail"]) == (cost, audit)

"""Least-cost repair of role sequences to ``(s?(ua)+)?`` by cost layers of bitsets, many sequences at once.

A row's code is its role's class (0 system, 1 user, 2 assistant, 3 other) plus four times its fault (0 none, 1 blank, 2
duplicate, 3 truncated). States of the grammar: 0 nothing written, 1 behind the system turn, 2 behind a user turn, 3 behind an
assistant turn; 0 and 3 accept.
"""

from __future__ import annotations

import re

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OTHER, PAD = 3, 4
#: Rows of a longer sequence that are solved together, and entries of a block of layers.
CHUNK, BLOCK = 64, 1 << 21
FAR = 1 << 40
#: State behind a kept row, by state and class (-1: not allowed), and behind an inserted or reroled one.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ANY = np.array([2, 2, 3, 2])
ACCEPTS = np.array([0, FAR, FAR, 0])
SYMBOLS = np.frombuffer(b"DIKR", np.uint8)
_U16 = np.uint16
_EACH = _U16(0x1111)


def _before_user(x):
    return ((x >> _U16(2)) & _EACH) * _U16(0b1011)


def _before_assistant(x):
    return ((x >> _U16(3)) & _EACH) << _U16(2)


def layers(cls: np.ndarray, cut: np.ndarray, whole: bool) -> np.ndarray:
    """Layer by cost, place and sequence: the bit ``4 * end + state`` tells whether ``end`` is reached from ``state`` there, for at most that cost.

    ``cls`` and ``cut`` (truncated) are [place, sequence]. Every layer comes from those one, two and three costs below it. The
    last one is the first that accepts each sequence from state 0 (``whole``) or that has every pair of states that any cost reaches.
    """
    length, n = cls.shape
    user, assistant, system, pad = (np.where(cls == k, _U16(0xFFFF), _U16(0)) for k in (1, 2, 0, PAD))
    goal = np.full(n, 0xFF21, _U16) | np.where((cls == 0).any(axis=0), _U16(0x10), _U16(0)) if not whole else None
    none = np.zeros((length + 1, n), _U16)
    out: list[np.ndarray] = []
    below = lambda k: out[-k] if len(out) >= k else none
    for _ in range(3 * length + 5):
        one, two, three = below(1), below(2), below(3)
        now = np.zeros((length + 1, n), _U16)
        now[length] = _U16(0x8421) | _before_user(two[length]) | _before_assistant(two[length])
        for j in range(length - 1, -1, -1):
            kept = np.where(cut[j], one[j + 1], now[j + 1])
            other = np.where(cut[j], three[j + 1], two[j + 1])
            now[j] = (
                (_before_user(kept) & user[j]) | (_before_assistant(kept) & assistant[j]) | (((kept >> _U16(1)) & _EACH) & system[j])
                | _before_user(other) | _before_assistant(other) | three[j + 1] | _before_user(two[j]) | _before_assistant(two[j])
            )
            now[j] = np.where(pad[j], now[j + 1], now[j])
        out.append(now)
        if ((now[0] & _U16(0x1001)) != 0).all() if whole else ((now[0] & goal) == goal).all():
            break
    return np.stack(out)


def costs(found: np.ndarray) -> np.ndarray:
    """Least cost by sequence, state and end: the first layer with the bit, ``FAR`` if none has it."""
    bits = (found[:, 0, :, None] >> np.arange(16, dtype=_U16)) & _U16(1)
    first = np.where(bits.any(axis=0), bits.argmax(axis=0), FAR)
    return first.reshape(-1, 4, 4).transpose(0, 2, 1)


def trace(found: np.ndarray, cls: np.ndarray, cut: np.ndarray, state: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least audit as bytes, 0 where none; end states; costs left) from ``state``, if ends cost ``after`` [sequence, end] more.

    At each place the first symbol in ASCII order is taken from which the layers still reach the least cost.
    """
    top, (length, n), every = len(found) - 1, cls.shape, np.arange(cls.shape[1])
    real = (cls != PAD).sum(axis=0)
    left = (costs(found)[every, state] + after).min(axis=1)

    def reaches(s, j, r):
        ok = np.zeros(n, bool)
        for end in range(4):
            rest = r - after[:, end]
            ok |= (rest >= 0) & ((found[np.clip(rest, 0, top), j, every] >> (4 * end + s).astype(_U16)) & _U16(1)).astype(bool)
        return ok

    state, place, out = state.copy(), np.zeros(n, np.int64), []
    while True:
        ended = (place == real) & (left == after[every, state])
        ended |= left >= FAR
        if ended.all():
            break
        inside = place < real
        at = np.minimum(place, max(length - 1, 0))
        c, t = (cls[at, every], cut[at, every].astype(np.int64)) if length else (np.full(n, PAD), np.zeros(n, np.int64))
        kept = np.where(inside, NEXT[state, np.minimum(c, OTHER)], -1)
        step = np.minimum(place + 1, length)
        options = [
            (inside, state, step, left - DELETE),
            (np.ones(n, bool), ANY[state], place, left - INSERT),
            (kept >= 0, np.maximum(kept, 0), step, left - KEEP - t * TRUNCATED),
            (inside, ANY[state], step, left - REROLE - t * TRUNCATED),
        ]
        symbol, new = np.zeros(n, np.uint8), [state.copy(), place.copy(), left.copy()]
        todo = ~ended
        for mark, (may, s, j, r) in zip(SYMBOLS, options):
            take = todo & may
            if take.any():
                take &= reaches(s, j, r)
                symbol[take] = mark
                for have, value in zip(new, (s, j, r)):
                    have[take] = value[take]
                todo &= ~take
        state, place, left = new
        out.append(symbol)
    return (np.stack(out, axis=1) if out else np.zeros((n, 0), np.uint8)), state, left


def _table(rows: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    cls, cut = np.full((length, len(rows)), PAD, np.int64), np.zeros((length, len(rows)), bool)
    for k, r in enumerate(rows):
        cls[: len(r), k], cut[: len(r), k] = r & 3, r >> 2 == 3
    return cls, cut


def _blocks(lengths: list[int]):
    """Sequences of like lengths, block by block: (their numbers, the length they are filled to)."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    begin = 0
    while begin < len(order):
        length = 1 << max(0, lengths[order[begin]] - 1).bit_length() if lengths[order[begin]] else 0
        most = max(1, BLOCK // ((3 * length + 5) * (length + 1)))
        end = begin
        while end < len(order) and end - begin < most and lengths[order[end]] <= length:
            end += 1
        yield order[begin:end], length
        begin = end


def _audits(rows: list[np.ndarray]) -> list[tuple[int, str]]:
    """(cost, audit) of sequences of rows none of which has to go."""
    out: list = [None] * len(rows)
    text = lambda marks: marks[marks != 0].tobytes().decode()
    short = [k for k, r in enumerate(rows) if len(r) <= CHUNK]
    for numbers, length in _blocks([len(rows[k]) for k in short]):
        picked = [short[i] for i in numbers]
        cls, cut = _table([rows[k] for k in picked], length)
        found = layers(cls, cut, True)
        after, start = np.tile(ACCEPTS, (len(picked), 1)), np.zeros(len(picked), np.int64)
        marks, _, _ = trace(found, cls, cut, start, after)
        cost = (costs(found)[:, 0] + after).min(axis=1)
        for i, k in enumerate(picked):
            out[k] = (int(cost[i]), text(marks[i]))
    for k in (k for k, r in enumerate(rows) if len(r) > CHUNK):
        out[k] = _long_audit(rows[k], text)
    return out


def _long_audit(row: np.ndarray, text) -> tuple[int, str]:
    """A long sequence in chunks: costs between states of each, what is left behind each, then the trace of each from every state."""
    chunks = [row[a : a + CHUNK] for a in range(0, len(row), CHUNK)]
    size = max(1, BLOCK // ((3 * CHUNK + 5) * (CHUNK + 1)))
    between = []
    for lo in range(0, len(chunks), size):
        between += list(costs(layers(*_table(chunks[lo : lo + size], CHUNK), False)))
    after = [ACCEPTS]
    for b in reversed(between):
        after.append(np.minimum((b + after[-1][None, :]).min(axis=1), FAR))
    after = after[::-1]
    state, marks = 0, []
    for lo in range(0, len(chunks), size):
        part = chunks[lo : lo + size]
        cls, cut = _table(part, CHUNK)
        found = layers(cls, cut, False)
        rest = np.stack(after[lo + 1 : lo + 1 + len(part)])
        by_state = [trace(found, cls, cut, np.full(len(part), s), rest) for s in range(4)]
        for i in range(len(part)):
            found_marks, ends, _ = by_state[state]
            marks.append(text(found_marks[i]))
            state = int(ends[i])
    return int(after[0][0]), "".join(marks)


def solve(rows: list[np.ndarray]) -> list[dict]:
    """For each conversation's row codes: counts of blank, duplicate, truncated and illegal, cost, and the edits of each row.

    ``edits`` has for each row the insertions before it and its own edit; what is inserted at the end follows as ``tail``. Rows
    that must go are left out of the layers: deleting them first is cheapest and ASCII-least wherever they stand.
    """
    faults = [r >> 2 for r in rows]
    found = _audits([r[(f == 0) | (f == 3)] for r, f in zip(rows, faults)])
    out = []
    for r, f, (cost, audit) in zip(rows, faults, found):
        gone = (f == 1) | (f == 2)
        c = r & 3
        legal = ((c[:-1] == 0) & (c[1:] == 1)) | ((c[:-1] == 1) & (c[1:] == 2)) | ((c[:-1] == 2) & (c[1:] == 1))
        own = re.findall("I*[DKR]", audit)
        steps = iter(own)
        edits = ["D" if g else next(steps) for g in gone.tolist()]
        blank, duplicate, truncated = (int((f == k).sum()) for k in (1, 2, 3))
        out.append({
            "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": int((~legal).sum()),
            "cost": cost + DELETE * (blank + duplicate), "edits": edits, "tail": audit[sum(map(len, own)) :],
        })
    return out


def actions(codes: np.ndarray, edits: list[str], tail: str) -> list[str]:
    """What each row's edits write: u or a for an inserted turn, K the row, U or A the row with another role, D nothing."""
    state, out = 0, []
    for c, steps in zip((codes & 3).tolist(), edits):
        done = ""
        for x in steps:
            if x == "I":
                state = int(ANY[state])
                done += "u" if state == 2 else "a"
            elif x == "R":
                state = int(ANY[state])
                done += "U" if state == 2 else "A"
            else:
                done += x
                state = int(NEXT[state, c]) if x == "K" else state
        out.append(done)
    for _ in tail:
        state = int(ANY[state])
        out[-1:] = [(out[-1] if out else "") + ("u" if state == 2 else "a")]
    return out

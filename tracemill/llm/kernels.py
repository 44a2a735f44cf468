"""Vectorised text kernels that run inside Arrow batches: words, hashes of spans, byte blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
#: Bytes of text handled at once: temporaries are about 80 times this. Longer texts are taken in pieces of this size.
BLOCK_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Longer spans of bytes are hashed one by one.
LONG_SPAN = 512
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def limbs(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    two = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(U64) | (four[4:].astype(U64) << U64(32))


def _begin(length) -> np.ndarray:
    return mix64(np.asarray(length, dtype=U64) * U64(MULT) + U64(1))


def byte_grams(limb: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from every place that has so many, of ``limbs``; ``byte_hashes`` gives the same."""
    n = max(len(limb) - size, 0)
    out = np.repeat(_begin([size]), n)
    for k in range(0, size, 8):
        out = mix64(out ^ (limb[k : k + n] & _MASKS[min(size - k, 8)]))
    return out


def byte_hashes(data: np.ndarray, limb: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time are mixed in, so none is a sum of its parts; long spans go through BLAKE2."""
    length = ends - starts
    out, k = _begin(length), 0
    live = np.flatnonzero(length <= LONG_SPAN)
    while len(live := live[length[live] > k]):
        out[live] = mix64(out[live] ^ (limb[starts[live] + k] & _MASKS[np.minimum(length[live] - k, 8)]))
        k += 8
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` 64-bit codes in a row from every place that has so many; ``code_hashes`` gives the same."""
    n = max(len(codes) - size + 1, 0)
    out = np.repeat(_begin([size]), n)
    for k in range(size):
        out = mix64(out ^ codes[k : k + n])
    return out


def code_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of 64-bit codes, mixed in one after the other."""
    length = ends - starts
    out, live, k = _begin(length), np.arange(len(length)), 0
    while len(live := live[length[live] > k]):
        out[live] = mix64(out[live] ^ codes[starts[live] + k])
        k += 1
    return out


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: np.ndarray, step: int = 1) -> np.ndarray:
    """Whether the spans of ``limbs`` a and b that begin at ``at`` and ``bt`` are equal; b may have the limb of every ``step``-th place only."""
    same, live, k = np.ones(len(at), bool), np.arange(len(at)), 0
    while len(live := live[length[live] > k]):
        mask = _MASKS[np.minimum(length[live] - k, 8)]
        equal = (a[at[live] + k] & mask) == (b[bt[live] + k // step] & mask)
        same[live[~equal]] = False
        live = live[equal]
        k += 8
    return same


_caches: dict[str, object] = {}


def remember(name: str, clear) -> None:
    """A Python worker keeps something between tasks of operator ``name``; ``clear`` lets go of it."""
    _caches[name] = clear


def begin(name: str) -> None:
    """A task of operator ``name`` begins: what this worker keeps for others goes, so that their memory doesn't add up."""
    for other, clear in list(_caches.items()):
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()


class UnitTable:
    """Numbers for short spans of bytes. Spans are found by hash and then compared by content, so no two share a number.

    ``find`` gives -1 to spans that are too long to be kept, and to one whose hash another span has.
    """

    def __init__(self, longest: int = 256):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.limbs = np.zeros(0, U64)  # of all spans kept, eight bytes in each

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each span, spans that stand for the numbers new to the table, in their order)."""
        limb, length = limbs(data), ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(length <= self.longest)
        keys, where, inverse = np.unique(byte_hashes(data, limb, starts[short], ends[short]), return_index=True, return_inverse=True)
        where = short[where]  # the span that stands for each key
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        slot = np.full(len(keys), -1, np.int64)
        slot[known] = self.slot[at[known]]
        old = np.flatnonzero(known)
        equal = self.lengths[slot[old]] == length[where[old]]
        old, lost = old[equal], old[~equal]
        wrong = ~same_bytes(limb, starts[where[old]], self.limbs, self.starts[slot[old]], length[where[old]], 8)
        slot[lost] = slot[old[wrong]] = -1
        new = np.flatnonzero(~known)
        slot[new] = len(self) + np.arange(len(new))
        picked = where[new]
        kept = length[picked]
        self.keys, self.slot = np.insert(self.keys, at[new], keys[new]), np.insert(self.slot, at[new], slot[new].astype(np.int32))
        size = -(-kept // 8)
        self.starts = np.concatenate((self.starts, (len(self.limbs) + np.cumsum(size) - size).astype(np.int32)))
        self.lengths = np.concatenate((self.lengths, kept.astype(np.int16)))
        turn = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.limbs = np.concatenate((self.limbs, limb[np.repeat(starts[picked], size) + 8 * turn] & _MASKS[np.minimum(np.repeat(kept, size) - 8 * turn, 8)]))
        mine = where[inverse]
        equal = (length[mine] == length[short]) & same_bytes(limb, starts[short], limb, starts[mine], np.minimum(length[short], length[mine]))
        out[short] = np.where(equal, slot[inverse], -1)
        return out, picked


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table of the bytes outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


SPACE_WORDS = byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORDS = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), offs


def text_blocks(array: pa.Array, limit: int = BLOCK_BYTES):
    """Runs of whole texts of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, offs = buffers(array)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``table`` that stay within a text: (starts, ends, first word of each text and the end)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(first word, end word, bytes, their limbs, starts, ends) of runs of words, a block of bytes at a time."""
    cuts = [0, len(starts)] if len(data) <= 2 * BLOCK_BYTES else np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK_BYTES)), len(starts))).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            begin = int(starts[lo])
            part = data[begin : int(ends[hi - 1])]
            yield lo, hi, part, limbs(part), starts[lo:hi] - begin, ends[lo:hi] - begin


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    out = np.zeros(len(starts), U64)
    for lo, hi, part, limb, s, e in word_blocks(data, starts, ends):
        out[lo:hi] = byte_hashes(part, limb, s, e)
    return out


def pieces(data: np.ndarray, inside: np.ndarray, limit: int = BLOCK_BYTES):
    """(begin, end) of pieces of about ``limit`` bytes that are cut behind bytes outside of ``inside`` only."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(begin + limit, n)
        while end < n:  # to behind the next byte where a cut may be
            ahead = np.flatnonzero(~inside[data[end - 1 : end - 1 + limit]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + limit, n)
        yield begin, end
        begin = end


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]

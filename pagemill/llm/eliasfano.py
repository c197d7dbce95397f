"""Elias-Fano sequences over numpy arrays: monotone numbers with constant-time access and successor
search, in the arrays of one file that readers map into memory."""

from __future__ import annotations

import json
import struct
import tempfile

import numpy as np
from pyarrow import fs

from pagemill.llm.store import opened, put_file

_MAPPED: dict[str, dict[str, np.ndarray]] = {}
U = np.uint64


def encode(keys: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays for a non-decreasing sequence of numbers below 2**63."""
    keys = keys.astype(U)
    n = len(keys)
    top = int(keys[-1]) + 1 if n else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (keys >> U(low)).astype(np.int64) + np.arange(n)
    size = (int(high[-1]) if n else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little").view(U)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
    lower = np.zeros((n * low + 63) // 64 + 2, U)
    if low and n:
        rest, at = keys & U((1 << low) - 1), np.arange(n, dtype=U) * U(low)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lower[word[first]] = np.bitwise_or.reduceat(rest << shift, first)
        over = np.flatnonzero(shift + U(low) > U(64))
        lower[word[over] + 1] |= rest[over] >> (U(64) - shift[over])
    return {f"{name}.head": np.array([n, low], np.int64), f"{name}.upper": upper, f"{name}.ones": ones, f"{name}.lower": lower}


def small(counts: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays for counts that are mostly small: a byte each, those over 254 beside them."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}.at": large, f"{name}.large": counts[large].astype(np.int64)}


def counts(arrays: dict[str, np.ndarray], name: str, at: np.ndarray | None = None) -> np.ndarray:
    """The counts at these places, or all."""
    out = (arrays[name] if at is None else arrays[name][at]).astype(np.int64)
    rows = np.flatnonzero(out == 255)
    out[rows] = arrays[f"{name}.large"][np.searchsorted(arrays[f"{name}.at"], rows if at is None else at[rows])]
    return out


def _in_word(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of the set bit of each rank, from 0, in a word: running counts of its bytes, then a table."""
    sums = bits - ((bits >> U(1)) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + ((sums >> U(2)) & U(0x3333333333333333))
    sums = ((sums + (sums >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
    whole = (((left.astype(U) * U(0x0101010101010101)) | U(0x8080808080808080)) - sums) & U(0x8080808080808080)
    shift = np.bitwise_count(whole).astype(U) << U(3)
    left = left - (((sums << U(8)) >> shift) & U(0xFF)).astype(np.int64)
    return _IN_BYTE[(left << 8) | ((bits >> shift) & U(0xFF)).astype(np.int64)] + shift.astype(np.int64)


#: Place of the set bit of rank r in byte b, at 256 * r + b.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)
#: Ranks from one noted word to the next, as a power of two.
NOTED = 5


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low = (int(x) for x in arrays[f"{name}.head"])
        self.upper, self.ones, self.lower = (arrays[f"{name}.{k}"] for k in ("upper", "ones", "lower"))
        self.zeros = len(self.upper) * 64 - int(self.ones[-1])
        self.arrays, self.noted = arrays, (f"{name}.ones noted", f"{name}.zeros noted")

    def _before(self, word: np.ndarray, flip: bool) -> np.ndarray:
        """Ones, or with flip zeros, before these words."""
        return word * 64 - self.ones[word] if flip else self.ones[word]

    def _select(self, rank: np.ndarray, flip: bool) -> tuple[np.ndarray, np.ndarray]:
        """Word and place in it of the bit of each rank, from 0, among ones or, with flip, zeros."""
        # Noted beside the arrays, which a process keeps from task to task.
        noted = self.arrays.get(self.noted[flip])
        if noted is None:
            counts = self._before(np.arange(len(self.ones)), flip)
            noted = (np.searchsorted(counts, np.arange(0, counts[-1], 1 << NOTED), side="right") - 1).astype(np.int32)
            self.arrays[self.noted[flip]] = noted
        word = noted[rank >> NOTED].astype(np.int64)
        open_ = np.flatnonzero(self._before(word + 1, flip) <= rank)
        for _ in range(4):
            word[open_] += 1
            open_ = open_[self._before(word[open_] + 1, flip) <= rank[open_]]
        if len(open_):
            # A few places where the bits of the other kind stand close together.
            lo, hi = word[open_], np.full(len(open_), len(self.upper) - 1, np.int64)
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                on = self._before(mid + 1, flip) <= rank[open_]
                lo, hi = np.where(on, mid + 1, lo), np.where(on, hi, mid)
            word[open_] = lo
        bits = self.upper[word]
        return word, _in_word(~bits if flip else bits, rank - self._before(word, flip))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(at), U)
        bit = at.astype(U) * U(self.low)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        far = (self.lower[word + 1] << (U(63) - shift)) << U(1)
        return ((self.lower[word] >> shift) | far) & U((1 << self.low) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        at = at.astype(np.int64)
        word, bit = self._select(at, False)
        return ((word * 64 + bit - at).astype(U) << U(self.low)) | self._low(at)

    def every(self) -> np.ndarray:
        """All numbers."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little")) - at
        return (high.astype(U) << U(self.low)) | self._low(at)

    def _bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places between which numbers of these high parts stand."""
        inside = np.minimum(high, self.zeros - 1)
        word, bit = np.zeros(len(high), np.int64), np.full(len(high), -1, np.int64)
        some = np.flatnonzero(inside > 0)
        word[some], bit[some] = self._select(inside[some] - 1, True)
        lo = word * 64 + bit + 1 - inside
        # The next zero ends them; most often it stands in the same word.
        rest = ~self.upper[word] & ~((U(1) << (bit + 1).astype(U)) - U(1))
        rest[bit == 63] = 0
        hi = word * 64 + np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64) - inside
        far = np.flatnonzero(rest == 0)
        if len(far):
            word, bit = self._select(inside[far], True)
            hi[far] = word * 64 + bit - inside[far]
        beyond = high >= self.zeros
        return np.where(beyond, self.n, np.minimum(lo, self.n)), np.where(beyond, self.n, np.minimum(hi, self.n))

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first number that is not smaller; n where there is none."""
        if not self.n or not len(keys):
            return np.full(len(keys), self.n, np.int64)
        keys = keys.astype(U)
        place, hi = self._bounds((keys >> U(self.low)).astype(np.int64))
        want = keys & U((1 << self.low) - 1)
        open_ = np.flatnonzero(place < hi)
        lo, hi, want = place[open_], hi[open_], want[open_]
        while len(open_):
            mid = (lo + hi) >> 1
            less = self._low(mid) < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            place[open_] = lo
            on = np.flatnonzero(lo < hi)
            open_, lo, hi, want = open_[on], lo[on], hi[on], want[on]
        return place

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where the sequence does not hold it; one of them where it holds several."""
        hit = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return hit
        keys = keys.astype(U)
        lo, hi = self._bounds((keys >> U(self.low)).astype(np.int64))
        want = keys & U((1 << self.low) - 1)
        open_ = np.flatnonzero(lo < hi)
        lo, hi, want = lo[open_], hi[open_], want[open_]
        while len(open_):
            mid = (lo + hi) >> 1
            found = self._low(mid)
            same = np.flatnonzero(found == want)
            hit[open_[same]] = mid[same]
            less = found < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            hi[same] = lo[same]
            on = np.flatnonzero(lo < hi)
            open_, lo, hi, want = open_[on], lo[on], hi[on], want[on]
        return hit


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: length of the directory, directory, arrays at multiples of 8 bytes."""
    places, parts, at = {}, [], 0
    for key, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        places[key] = (array.dtype.str, at, len(array))
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    put_file(folder, name, b"".join([struct.pack("<Q", len(head)), head, *parts]))


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays, mapped; a file of a remote store is fetched once per process."""
    path = f"{folder}/{name}"
    if path not in _MAPPED:
        system, inner = opened(folder)
        local = f"{inner}/{name}"
        if not isinstance(system, fs.LocalFileSystem):
            with system.open_input_stream(local) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                while block := source.read(1 << 24):
                    copy.write(block)
            local = copy.name
        data = np.memmap(local, np.uint8, "r").view(np.ndarray)
        size = int(data[:8].view("<u8")[0])
        places = json.loads(bytes(data[8 : 8 + size]))
        _MAPPED[path] = {k: data[8 + size + at : 8 + size + at + n * np.dtype(d).itemsize].view(d) for k, (d, at, n) in places.items()}
    return _MAPPED[path]

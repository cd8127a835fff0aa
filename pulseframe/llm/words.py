"""Words and word shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE = 32
#: Bytes hashed at a time; only bounds the memory of one step.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def byte_table(is_word) -> bytes:
    """For ``bytes.translate``: A-Z in lower case, bytes outside words as a space."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if is_word(b) else SPACE for b in lower)


#: Words of anything but white space, and words of letters, digits and bytes beyond ASCII.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)

_powers: dict[str, np.ndarray] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0, 1, ... and the inverses, modulo 2 ** 64."""
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, BLOCK + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts: spans in ``data``, and of which text each is."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = b" ".join(texts).translate(table)
        array = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(array) + 2, bool)
        inside[1:-1] = array != SPACE
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        heads = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, heads)  # the first word of each text, and one past the last
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        array = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            begin = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, begin + BLOCK, "right")))
            end = int(self.ends[upto - 1])
            up, down = powers(end - begin + 1)
            total = np.zeros(end - begin + 1, np.uint64)
            np.cumsum((array[begin:end].astype(np.uint64) + np.uint64(1)) * up[: end - begin], out=total[1:])
            s, e = self.starts[at:upto] - begin, self.ends[at:upto] - begin
            out[at:upto] = scramble((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = upto
        return out

    def shingles(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``size`` words within one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.full(n, np.uint64(size), np.uint64)
        for j in range(size):
            total = total * BASE + hashes[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, scramble(total[at])

    def span(self, start: int, end: int) -> bytes:
        """Words ``start`` to ``end`` (exclusive), joined by one space."""
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist()))

"""Vectorised text kernels: polynomial hashes of every word, word shingle or character shingle of a batch of texts.

The hash of a run a[s:e] is (S[e] - S[s]) * B**-s mod 2**64, where S holds the prefix sums of (a[i] + 1) * B**i and B is
odd, hence invertible. So hashes of runs of any length cost a few array operations, whatever the texts hold.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .common import worker_cache

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64
#: Code units that are handled at once; a single longer text is handled alone.
CHUNK = 1 << 18


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (U(BASE), U(INVERSE)))
        return self.up, self.down


def shared_powers() -> Powers:
    """This worker's table of powers."""
    cache = worker_cache("powers")
    if "powers" not in cache:
        cache["powers"] = Powers()
    return cache["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def chunks(texts: list[str], size: int = CHUNK):
    """Index ranges of consecutive texts of about `size` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def digests(parts) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each of the byte strings, for which no two different ones with equal digests are known, as two arrays."""
    got = np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in parts]), U).reshape(-1, 2)
    return got[:, 0].copy(), got[:, 1].copy()


class Runs:
    """Prefix sums over one array of code units, for hashes of its runs. Different runs of up to 1023 units may share a hash by
    chance only; of longer ones there are pairs that share it whatever the base."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        self.codes = codes
        up, self.down = powers.get(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


#: Bytes of words: letters, digits, the underscore, and all bytes of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    WORD_BYTE[_a:_b] = True


def words(texts: list[str], powers: Powers):
    """Runs of word bytes of the lower-cased texts: (document index, start, end, runs over all bytes)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0], edge]) if inside[0] else edge
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(ends, start, side="right"), start, end, Runs(data, powers)


def word_shingles(texts: list[str], width: int, powers: Powers):
    """(document index, hash) of every run of `width` words, in order; a text of fewer words, but one at least, gives one
    shingle of all its words. Then the digest of each text's word sequence, in two parts."""
    doc, start, end, runs = words(texts, powers)
    h = mix(runs.hashes(start, end) ^ mix((end - start).astype(U)))
    data = runs.codes
    long = np.flatnonzero(end - start > 512)
    if len(long):
        h[long] = digests([data[a:b].tobytes() for a, b in zip(start[long], end[long], strict=True)])[0]
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    seq = Runs(h, powers)
    size = np.minimum(count, width)
    places = np.where(count > 0, count - size + 1, 0)
    owner = np.repeat(np.arange(n), places)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places) + first[owner]
    # the words, each with one newline after it
    inside = WORD_BYTE[data]
    inside[end] = True
    joined = np.where(WORD_BYTE[data], data, np.uint8(10))[inside].tobytes()
    stop = np.cumsum(np.bincount(doc, weights=end - start + 1, minlength=n).astype(np.int64)).tolist()
    w1, w2 = digests([joined[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)])
    return owner, mix(seq.hashes(at, at + size[owner])), w1, w2


def char_shingles(texts: list[str], width: int, powers: Powers):
    """(text index, hash) of every run of `width` code points; a shorter text, but not an empty one, gives one shingle of all its code
    points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    runs = Runs(codes, powers)
    places = np.where(size > 0, np.maximum(size - width, 0) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), places)
    ends = np.cumsum(size)
    # runs of one length have the hashes of neighbouring sums; those that cross an end are left out
    within = np.ones(max(len(codes) - width + 1, 0), bool)
    across = (ends[:, None] - np.arange(1, width)).ravel()
    within[across[(across >= 0) & (across < len(within))]] = False
    h = ((runs.sums[width:] - runs.sums[:-width]) * runs.down[: len(within)])[within]
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        at = (np.cumsum(places) - places)[short]
        h = np.insert(h, at - np.arange(len(short)), runs.hashes(ends[short] - size[short], ends[short]))
    return owner, mix(h)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for small arrays, which np.unique is slow on."""
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else np.concatenate([x[:1], x[1:][new]])


def occurrences(owner: np.ndarray, h: np.ndarray):
    """Sorted distinct (owner, hash) pairs and their counts; owners come in ascending order."""
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(owner) and owner[-1] < 1 << 16 else owner[order], kind="stable")]
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

"""Elias-Fano sequences and n-gram levels on flat buffers.

A sorted sequence is cut into low bits, stored packed, and high bits, stored as unary gaps:
2 + log2(universe / n) bits a number. Buffers are only viewed, never copied: bytes of a
table's row, or a file through `Level.open`, which maps it into memory.
"""

import numpy as np

HEADER = 4
PACK_ROWS = 1 << 16
#: Low bits at most, so that a number's bits lie in eight bytes whatever bit they start at.
MOST_LOW = 56
#: Bits of a successor's number; the rank of its context takes the rest of 64.
SUCCESSOR_BITS = 36
SUCCESSOR_MASK = np.uint64((1 << SUCCESSOR_BITS) - 1)
MOST_CONTEXTS = 1 << (64 - SUCCESSOR_BITS)
#: Steps per factor of ten of the quantised probabilities; code 0 stands for none.
STEPS = 4000


def encode(values: np.ndarray, bits: int) -> np.ndarray:
    """The sorted numbers, each below 2**bits, as 64-bit words: header, low bits, high bits."""
    n = len(values)
    low_bits = int(min(MOST_LOW, max(0, bits - max(0, n.bit_length() - 1))))
    packed = []
    for at in range(0, n if low_bits else 0, PACK_ROWS):
        rows = np.ascontiguousarray(values[at : at + PACK_ROWS]).view(np.uint8).reshape(-1, 8)
        packed.append(np.unpackbits(rows, axis=1, bitorder="little")[:, :low_bits].ravel())
    low = np.packbits(np.concatenate(packed), bitorder="little") if packed else np.zeros(0, np.uint8)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    upper = np.zeros(n + (1 << max(0, bits - low_bits)) + 1, np.uint8)
    upper[high + np.arange(n)] = 1
    upper = np.packbits(upper, bitorder="little")

    def words(data, spare):
        out = np.zeros(-(-(len(data) + spare) // 8) * 8, np.uint8)
        out[: len(data)] = data
        return out.view(np.uint64)

    low, upper = words(low, 8), words(upper, 0)
    return np.concatenate([np.array([n, low_bits, len(low), len(upper)], np.uint64), low, upper])


class Sequence:
    """An encoded sequence, read in place."""

    def __init__(self, words: np.ndarray):
        self.n, self.low_bits, low, high = (int(x) for x in words[:HEADER])
        self.words = HEADER + low + high
        # The eight bytes from each byte of the low bits on.
        self.eights = np.lib.stride_tricks.as_strided(words[HEADER : HEADER + low], (max(0, 8 * low - 7),), (1,))
        upper = np.unpackbits(words[HEADER + low : self.words].view(np.uint8), bitorder="little")
        # Where each value of the high bits begins: the zeros of the unary gaps, less those before.
        zeros = np.flatnonzero(upper == 0)
        self.begins = np.r_[0, zeros - np.arange(len(zeros))]

    def low_at(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        bit = index * self.low_bits
        return (self.eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        per_high = np.diff(self.begins)
        high = np.repeat(np.arange(len(per_high), dtype=np.uint64), per_high)[: self.n]
        return (high << np.uint64(self.low_bits)) | self.low_at(np.arange(self.n))

    def at(self, index: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.begins, index, "right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low_at(index)

    def search(self, wanted: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of the first number that is not below the wanted one, within [first, last)."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        high = np.minimum(high, len(self.begins) - 2)
        lo, hi = self.begins[high], self.begins[high + 1]
        if first is not None:
            lo, hi = np.maximum(lo, first), np.maximum(np.minimum(hi, last), np.maximum(lo, first))
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.low_at(mid) < low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)


def quantised(chances: np.ndarray) -> np.ndarray:
    """log10 of probabilities above 0 in 16-bit steps; what is below 10**-16 is taken for that."""
    steps = np.rint(-np.log10(np.minimum(chances, 1.0)) * STEPS)
    return (np.minimum(steps, 16 * STEPS) + 1).astype(np.uint16)


def unquantised(codes: np.ndarray, none: float) -> np.ndarray:
    """The probabilities of the codes, and `none` where there is no code."""
    return np.where(codes > 0, 10.0 ** ((1 - codes.astype(np.float64)) / STEPS), none)


def padded(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(codes) // 4) * 4, np.uint16)
    out[: len(codes)] = codes
    return out.view(np.uint64)


class Words:
    """The first level: all words as successors of the root, and monotone sums of their counts."""

    def __init__(self, words: np.ndarray):
        self.keys = Sequence(words)
        self.sums = Sequence(words[self.keys.words :])

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The level of sorted distinct keys with counts."""
        sums = np.r_[0, np.cumsum(counts)].astype(np.uint64)
        return np.concatenate([encode(keys, 64), encode(sums, max(1, int(sums[-1]).bit_length()))])

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for one not there."""
        if not self.keys.n:
            return np.zeros(len(keys), np.int64)
        place = np.minimum(self.keys.search(keys), self.keys.n - 1)
        counts = (self.sums.at(place + 1) - self.sums.at(place)).astype(np.int64)
        return np.where(self.keys.at(place) == keys, counts, 0)


class Lists:
    """Contexts, and numbers of successors with their context's rank above them, so that they rise."""

    def __init__(self, words: np.ndarray):
        self.contexts = Sequence(words)
        self.successors = Sequence(words[self.contexts.words :])
        self.words = self.contexts.words + self.successors.words

    @staticmethod
    def build(contexts: np.ndarray, rank: np.ndarray, successors: np.ndarray) -> np.ndarray:
        if len(contexts) >= MOST_CONTEXTS:
            raise ValueError("too many contexts for one part of a level")
        relative = (rank.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors
        bits = min(64, SUCCESSOR_BITS + max(1, len(contexts).bit_length()))
        return np.concatenate([encode(contexts, 64), encode(relative, bits)])

    def decode(self):
        """(contexts, rank of each successor's context, successors)."""
        relative = self.successors.decode()
        return self.contexts.decode(), (relative >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), relative & SUCCESSOR_MASK


class Level:
    """A level above the words: lists, pointers to each context's first successor, and codes.

    A successor has the code of its discounted probability, a context that of the weight that
    its shorter context's probabilities have in it.
    """

    def __init__(self, words: np.ndarray):
        self.lists = Lists(words)
        self.pointers = Sequence(words[self.lists.words :])
        at = self.lists.words + self.pointers.words
        n, contexts = self.lists.successors.n, self.lists.contexts.n
        self.codes = words[at:].view(np.uint16)[:n]
        self.weights = words[at + -(-n // 4) :].view(np.uint16)[:contexts]

    @staticmethod
    def build(contexts, rank, successors, chances, weights) -> np.ndarray:
        """The level of sorted contexts and, in order of (rank, successor), their successors."""
        pointers = np.searchsorted(rank, np.arange(len(contexts) + 1)).astype(np.uint64)
        return np.concatenate(
            [
                Lists.build(contexts, rank, successors),
                encode(pointers, max(1, len(rank).bit_length())),
                padded(quantised(chances)),
                padded(quantised(weights)),
            ]
        )

    @staticmethod
    def open(path: str) -> "Level":
        """A level in a file of its own, mapped into memory."""
        return Level(np.memmap(path, np.uint64, "r"))

    def answer(self, contexts, rank, successors):
        """(codes, weights): per successor its code in its context, per context its weight; 0 for none."""
        codes, weights = np.zeros(len(rank), np.uint16), np.zeros(len(contexts), np.uint16)
        if not self.lists.contexts.n:
            return codes, weights
        mine = np.minimum(self.lists.contexts.search(contexts), self.lists.contexts.n - 1)
        known = self.lists.contexts.at(mine) == contexts
        weights[known] = self.weights[mine[known]]
        first, last = (self.pointers.at(mine + i).astype(np.int64) for i in (0, 1))
        asked = np.flatnonzero((known & (first < last))[rank])
        if not len(asked):
            return codes, weights
        rank = rank[asked]
        wanted = (mine[rank].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[asked]
        place = self.lists.successors.search(wanted, first[rank], last[rank])
        inside = place < last[rank]
        place = np.minimum(place, len(self.codes) - 1)
        there = inside & (self.lists.successors.at(place) == wanted)
        codes[asked[there]] = self.codes[place[there]]
        return codes, weights

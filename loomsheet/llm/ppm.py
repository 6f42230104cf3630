"""Prediction by partial matching over bytes, for several classes at once.

Each class has its own variable-order context tree with escape probabilities (method C: a context
seen n times with d different successors gives count / (n + d), and d / (n + d) to escape).  The
statistics are frozen after training, so the exact code length of a symbol in a context is a constant:
trees are flattened to one table from byte strings of up to ``ORDER + 1`` bytes to the code lengths of
their last byte under every class.  Scoring a text is then a table look-up per byte from the longest
context down, with the escapes of the longer contexts added where the byte is new in them.
"""

from __future__ import annotations

import numpy as np

#: longest context in bytes
ORDER = 5
#: pieces are preceded by so many bytes, so that contexts don't reach into the piece before
PAD = b"\n" * ORDER


def _packed(data: np.ndarray) -> np.ndarray:
    """At each place the last ORDER + 1 bytes as one number, the latest byte lowest."""
    out = data.astype(np.uint64)
    wide = out.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= wide[:-back] << np.uint64(8 * back)
    return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


class Table:
    """Open-addressed map from byte strings (length and bytes packed in a number) to their row."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.slots = np.full(self.size, -1, np.int32)
        self.keys = keys
        pending = np.arange(len(keys), dtype=np.int32)
        home = self._home(keys)
        step = 0
        while len(pending):
            at = (home[pending] + step) & (self.size - 1)
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]] = pending[first]
            taken = np.zeros(len(pending), bool)
            taken[first] = True
            pending = pending[~taken]
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        home = self._home(keys)
        row = self.slots[home]
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        step = 0
        while len(open_):
            step += 1
            now = self.slots[(home[open_] + step) & (self.size - 1)]
            row[open_] = now
            open_ = open_[(now >= 0) & (self.keys[now] != keys[open_])]
            if step > self.steps:
                row[open_] = -1
                break
        return row


def _key(packed: np.ndarray, n: int) -> np.ndarray:
    return (packed & _mask(n)) | np.uint64(n << 56)


def counted(pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(byte strings, counts) of each length from 0, where there are none, to ORDER + 1 bytes."""
    data = np.frombuffer(PAD + b"".join(p + PAD for p in pieces), np.uint8)
    own = np.ones(len(data), bool)  # the padding is context, not text
    own[: len(PAD)] = False
    ends = np.cumsum([len(PAD), *(len(p) + len(PAD) for p in pieces)])[1:]
    for back in range(1, len(PAD) + 1):
        own[ends - back] = False
    packed = _packed(data)[own]
    return [(packed[:0], np.zeros(0, np.int64)), *(np.unique(packed & _mask(n), return_counts=True) for n in range(1, ORDER + 2))]


class Models:
    """Frozen statistics of all classes; ``bits`` gives exact code lengths."""

    def __init__(self, classes: list[str], keys: np.ndarray, codes: np.ndarray, escapes: np.ndarray):
        self.classes, self.keys, self.codes, self.escapes = classes, keys, codes, escapes
        self._table: Table | None = None
        self._links: tuple | None = None

    def __getstate__(self):
        return self.classes, self.keys, self.codes, self.escapes

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def train(cls, pieces: dict[str, list[bytes]]) -> Models:
        classes = sorted(pieces)
        return cls.of_counts(classes, list(zip(*(counted(pieces[name]) for name in classes), strict=True)))

    @classmethod
    def of_counts(cls, classes: list[str], grams: list[list[tuple[np.ndarray, np.ndarray]]]) -> Models:
        """Models from (sorted byte strings, counts) by length, from 0 to ORDER + 1 bytes, and class."""
        width = len(classes)
        shorter_keys = np.zeros(1, np.uint64)
        shorter = np.full((1, width), 8.0)
        all_keys, all_codes, all_escapes = [], [], []
        for n in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([k for k, _ in grams[n]]))
            counts = np.zeros((len(keys), width))
            for c, (k, m) in enumerate(grams[n]):
                counts[np.searchsorted(keys, k), c] = m
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), width))
            different = np.zeros((len(contexts), width))
            np.add.at(total, at, counts)
            np.add.at(different, at, counts > 0)
            seen = total > 0
            whole = np.where(seen, total + different, 1.0)
            escape = np.where(seen, -np.log2(np.where(seen, different, 1.0) / whole), 0.0)
            below = shorter[np.searchsorted(shorter_keys, keys & _mask(n - 1))] if n > 1 else np.broadcast_to(shorter[0], counts.shape)
            code = np.where(counts > 0, -np.log2(np.maximum(counts, 1e-9) / whole[at]), escape[at] + below)
            if n > 1:  # escapes belong to the context as a string of n - 1 bytes
                place = np.searchsorted(shorter_keys, contexts)
                place = np.minimum(place, len(shorter_keys) - 1)
                known = shorter_keys[place] == contexts
                all_escapes[-1][place[known]] = escape[known]
                if not known.all():  # contexts of padding only: never a symbol, so their code isn't used
                    all_keys.append(contexts[~known] | np.uint64((n - 1) << 56))
                    all_codes.append(np.full((int((~known).sum()), width), 16, np.float32))
                    all_escapes.append(escape[~known].astype(np.float32))
            all_keys.append(keys | np.uint64(n << 56))
            all_codes.append(code.astype(np.float32))
            all_escapes.append(np.zeros(code.shape, np.float32))
            shorter_keys, shorter = keys, code
            if n == 1:
                root = escape[0] if len(escape) else np.zeros(width)
        # row 0: a byte never seen; the escapes of the empty context go with it
        codes = np.concatenate([np.asarray([root + 8.0], np.float32), *all_codes])
        escapes = np.concatenate([np.zeros((1, width), np.float32), *all_escapes])
        keys = np.concatenate([np.zeros(1, np.uint64), *all_keys])
        return cls(classes, keys, codes.astype(np.float16), escapes.astype(np.float16))

    def seen(self, characters: list[bytes]) -> list[bool]:
        """Whether byte strings of at most ``ORDER + 1`` bytes occur in the training text of any class."""
        if self._table is None:
            self._table = Table(self.keys)
        keys = [int.from_bytes(c, "big") | len(c) << 56 for c in characters]
        return (self._table.find(np.array(keys, np.uint64)) > 0).tolist() if keys else []

    def bits(self, pieces: list[bytes]) -> np.ndarray:
        """Code length in bits of each piece (rows) under each class (columns)."""
        out = np.zeros((len(pieces), len(self.classes)), np.float32)
        codes, firsts = self.codes_of(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        filled = np.flatnonzero(sizes > 0)
        if len(filled):
            out[filled] = np.add.reduceat(codes, firsts[filled], axis=0)
        return out

    def codes_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each byte of all pieces (rows) under each class (columns), and the row each piece starts at."""
        if self._links is None:
            self._links = self._linked()
        table, short, suffix, parent, chain = self._links
        find = table.find
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not sizes.sum():
            return np.zeros((0, len(self.classes)), np.float32), np.zeros(len(pieces), np.int64)
        data = np.frombuffer(PAD + PAD.join(pieces), np.uint8)
        starts = np.cumsum(sizes + len(PAD)) - sizes
        own = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        packed = _packed(data)
        now = packed[own]
        row = find(_key(now, ORDER + 1))
        rest = np.flatnonzero(row < 0)
        if len(rest):
            # the longest string known: every suffix of a known string is known
            late = now[rest]
            last = np.take(short[2], (late & _mask(2)).astype(np.int64))
            at = np.flatnonzero(last < 0)
            last[at] = np.take(short[1], (late[at] & _mask(1)).astype(np.int64))
            open_ = np.flatnonzero(last > 0)
            open_ = open_[self.keys[last[open_]] >> np.uint64(56) == 2]
            for n in range(3, ORDER + 1):
                longer = find(_key(late[open_], n))
                open_, longer = open_[longer >= 0], longer[longer >= 0]
                last[open_] = longer
            row[rest] = np.maximum(last, 0)
            # the longest context is that of the byte before, or the padding
            first = np.zeros(len(own) + 1, bool)
            first[np.cumsum(sizes) - sizes] = True
            before = np.where(first[rest], np.int32(short[0]), np.take(row, np.maximum(rest - 1, 0)))
            before = np.where(before >= self._longest, np.take(suffix, before), before)
        codes = np.take(self.codes, row, axis=0).astype(np.float32)
        if len(rest):
            codes[rest] += np.take(chain, before, axis=0) - np.take(chain, np.take(parent, row[rest]), axis=0)
        return codes, np.cumsum(sizes) - sizes

    def _linked(self) -> tuple[Table, tuple, np.ndarray, np.ndarray, np.ndarray]:
        """Of each string its row without the first byte and without the last, and the escapes of it and all its suffixes as contexts; rows of strings of one and two bytes."""
        if self._table is None:
            self._table = Table(self.keys)
        table, keys = self._table, self.keys
        size = (keys >> np.uint64(56)).astype(np.int64)
        own = keys & _mask(7)
        less = np.maximum(size - 1, 0)
        suffix = np.maximum(table.find((own & ((np.uint64(1) << (8 * less).astype(np.uint64)) - np.uint64(1))) | (less.astype(np.uint64) << np.uint64(56))), 0)
        parent = np.maximum(table.find((own >> np.uint64(8)) | (less.astype(np.uint64) << np.uint64(56))), 0)
        chain = self.escapes.astype(np.float32)
        for n in range(2, ORDER + 1):
            at = np.flatnonzero(size == n)
            chain[at] += chain[suffix[at]]
        padding = [int(r) for n in range(ORDER, 0, -1) if (r := table.find(_key(np.zeros(1, np.uint64) + np.uint64(int.from_bytes(PAD, "big")), n))[0]) >= 0]
        short = (padding[0] if padding else 0, *(table.find(_key(np.arange(256**n, dtype=np.uint64), n)) for n in (1, 2)))
        # strings of full length come last
        self._longest = int(np.flatnonzero(size == ORDER + 1)[0]) if (size == ORDER + 1).any() else len(keys)
        return table, short, suffix, parent, chain

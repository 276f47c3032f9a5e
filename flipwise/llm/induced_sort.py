"""Suffix sorting by external induced sorting: suffixes and common prefixes of neighbours, from disk-backed priority queues.

The suffixes that begin a rising run (S*) are sorted first: their substrings
are sorted as packed tuples and named, and where names repeat the text of
names is sorted by recursion.  Two scans then induce all others.  A scan takes
tuples (suffix, prefix shared with the tuple before) from a priority queue in
order of their first symbol; each one puts the suffix that starts one symbol
earlier into the queue.  What that suffix shares with the one queued before it
under the same symbol is one symbol more than the least shared by the tuples
scanned between their causes, so common prefixes need no look at the text.

The queue is monotone: symbols fall into bins of bounded content, a bin is a
list of blocks in order of arrival, and only the bin at the front is sorted.
Blocks beyond the memory limit, of the queue and of the scans' output, go to
files in the shared folder.  Tuples are taken in batches, as many as no tuple
that the batch itself causes must precede, and worked on as arrays.  The text
and two arrays about it stay in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from .common import open_folder

#: Tuples of a bin (a symbol with more has a bin of its own), bins of a coarse bin, tuples of a batch.
BIN, COARSE, BATCH = 4096, 16, 1 << 16
#: Bytes of tuples in memory beyond which blocks go to files.
MEMORY = 256_000_000
INF = np.int64(2**62)


class Disk:
    """Memory account and spill files of one sort; ``folder`` None keeps everything in memory."""

    def __init__(self, folder: str | None, memory: int = MEMORY):
        self.memory, self.held, self.spilled, self.files = memory, 0, 0, 0
        self.fs, self.path = open_folder(folder) if folder else (None, None)
        if self.fs:
            self.path = f"{self.path}/{uuid.uuid4().hex}"
            self.fs.create_dir(self.path, recursive=True)

    def write(self, block: tuple[np.ndarray, ...]) -> str:
        name = f"{self.path}/{self.files}"
        self.files += 1
        with self.fs.open_output_stream(name) as out:
            for column in block:
                out.write(np.ascontiguousarray(column, np.int64).tobytes())
        self.spilled += len(block[0])
        return name

    def read(self, name: str, columns: int) -> tuple[np.ndarray, ...]:
        with self.fs.open_input_stream(name) as stream:
            block = np.frombuffer(stream.read(), np.int64)
        self.fs.delete_file(name)
        return tuple(block.reshape(columns, -1))

    def close(self) -> None:
        if self.fs:
            self.fs.delete_dir(self.path)


class Spool:
    """Blocks of tuples in order of arrival, the later ones in files while memory is short."""

    def __init__(self, disk: Disk, columns: int):
        self.disk, self.columns = disk, columns
        self.blocks: list = []
        self.open: list[tuple[np.ndarray, ...]] = []
        self.n_open = self.length = 0

    def append(self, *block: np.ndarray) -> None:
        n = len(block[0])
        if not n:
            return
        self.open.append(block)
        self.n_open += n
        self.length += n
        self.disk.held += 8 * n * self.columns
        if self.disk.fs and self.disk.held > self.disk.memory and self.n_open >= 1024:
            self.blocks.append((self.disk.write(self._joined()), self.n_open))
            self._freed(self.n_open)
            self.open, self.n_open = [], 0
        elif self.n_open >= BATCH:
            self.blocks.append((self._joined(), self.n_open))
            self.open, self.n_open = [], 0

    def _joined(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([b[k] for b in self.open]) for k in range(self.columns))

    def _freed(self, n: int) -> None:
        self.disk.held -= 8 * n * self.columns

    def drain(self, backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """The blocks, which leave the spool; backwards, the last first and each reversed."""
        if self.open:
            self.blocks.append((self._joined(), self.n_open))
            self.open, self.n_open = [], 0
        self.blocks.reverse()
        if backwards:
            self.blocks.reverse()
        while self.blocks:
            block, n = self.blocks.pop()
            if isinstance(block, str):
                block = self.disk.read(block, self.columns)
            else:
                self._freed(n)
            self.length -= n
            yield tuple(c[::-1] for c in block) if backwards else block

    def all(self, backwards: bool = False) -> tuple[np.ndarray, ...]:
        blocks = list(self.drain(backwards))
        return tuple(np.concatenate([b[k] for b in blocks]) if blocks else np.empty(0, np.int64) for k in range(self.columns))


class MonotoneQueue:
    """Tuples (key, suffix, shared) that leave in order of key, equal keys in order of arrival; no key below the bin in front arrives."""

    def __init__(self, weight: np.ndarray, disk: Disk):
        total = np.cumsum(weight)
        alone = weight > BIN
        # a new bin begins with each full BIN, and around symbols that have one of their own
        mark = (total - weight) // BIN + np.cumsum(alone) + np.cumsum(np.concatenate([[False], alone[:-1]]))
        self.bin_of = np.concatenate([[0], np.cumsum(np.diff(mark) > 0)]) if len(weight) else np.empty(0, np.int64)
        self.n_bins = int(self.bin_of[-1]) + 1 if len(weight) else 0
        self.disk = disk
        self.coarse = [Spool(disk, 3) for _ in range(self.n_bins // COARSE + 1)]
        self.fine: list[Spool] = []
        self.at = -1

    def push(self, key: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queue tuples; those of the bin in front are handed back."""
        where = self.bin_of[key]
        now = where == self.at
        place = np.where(where // COARSE == self.at // COARSE, where % COARSE, COARSE + where // COARSE)
        order = np.flatnonzero(~now)
        order = order[np.argsort(place[order], kind="stable")]
        sorted_place = place[order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_place[1:] != sorted_place[:-1]])) if len(order) else np.empty(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            p, part = int(sorted_place[a]), order[a:b]
            spool = self.fine[p] if p < COARSE else self.coarse[p - COARSE]
            spool.append(key[part], suffix[part], shared[part])
        return key[now], suffix[now], shared[now]

    def next_bin(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Move to the next bin and give its tuples, in blocks in order of arrival."""
        self.at += 1
        if self.at % COARSE == 0:
            self.fine = [Spool(self.disk, 3) for _ in range(COARSE)]
            for key, suffix, shared in self.coarse[self.at // COARSE].drain():
                place = self.bin_of[key] % COARSE
                for p in np.unique(place):
                    self.fine[p].append(key[place == p], suffix[place == p], shared[place == p])
        return self.fine[self.at % COARSE].drain()


def _least_between(shared: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(shared[begin:end]) of each pair of places, begin < end, by a table of minima of 2^k neighbours."""
    out = np.empty(len(begin), shared.dtype)
    width = end - begin
    level = np.frexp(width)[1] - 1
    table, span = shared, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[begin[at]], table[end[at] - span])
        if 2 * span <= len(shared):
            table = np.minimum(table[:-span], table[span:])
            span *= 2
    return out


class _Least:
    """Least value of the batches behind a given one: a stack of the batches that no later one undercuts."""

    def __init__(self):
        self.batch: list[int] = []
        self.value: list[int] = []

    def add(self, batch: int, value: int) -> None:
        while self.value and self.value[-1] >= value:
            self.batch.pop()
            self.value.pop()
        self.batch.append(batch)
        self.value.append(value)

    def after(self, batch: np.ndarray) -> np.ndarray:
        return np.array([*self.value, INF], np.int64)[np.searchsorted(np.array(self.batch, np.int64), batch, "right")]


class _Seeds:
    """The given tuples, taken key by key."""

    def __init__(self, blocks: Iterator[tuple[np.ndarray, ...]], text: np.ndarray, flip: int | None):
        self.blocks, self.text, self.flip = blocks, text, flip
        self.key = self.suffix = self.shared = np.empty(0, np.int64)
        self.done = False

    def keys(self, suffix: np.ndarray) -> np.ndarray:
        symbol = self.text[suffix].astype(np.int64)
        return symbol if self.flip is None else self.flip - symbol

    def upto(self, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while not self.done and (not len(self.key) or self.key[-1] <= last):
            block = next(self.blocks, None)
            if block is None:
                self.done = True
            else:
                self.key = np.concatenate([self.key, self.keys(block[0])])
                self.suffix, self.shared = np.concatenate([self.suffix, block[0]]), np.concatenate([self.shared, block[1]])
        n = int(np.searchsorted(self.key, last, "right"))
        out = self.key[:n], self.suffix[:n], self.shared[:n]
        self.key, self.suffix, self.shared = self.key[n:], self.suffix[n:], self.shared[n:]
        return out


def _induce(text: np.ndarray, size: int, target: np.ndarray, run: np.ndarray, seeds: Iterator[tuple[np.ndarray, ...]], flip: int | None,
            disk: Disk, keep_seeds: bool) -> Spool:
    """One scan: (suffix, shared with the one before) of the suffixes of type ``target`` in order of key, induced from the seeds.

    ``flip`` None scans symbols upwards, else downwards (key = flip - symbol).
    With ``keep_seeds`` the output holds the seeds too, in their places.
    """
    out = Spool(disk, 2)
    source = _Seeds(seeds, text, flip)
    weight = np.bincount(text, minlength=size)
    queue = MonotoneQueue(weight if flip is None else weight[::-1], disk)
    last_key = np.searchsorted(queue.bin_of, np.arange(queue.n_bins), "right") - 1
    # per key: the batch that pushed it last (-1: none) and the least shared behind that push in this batch
    pushed, behind = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    batch, since = 0, _Least()
    before = (-1, -1, False)  # key, suffix and whether a seed, of the tuple scanned last
    none = np.empty(0, np.int64)
    for b in range(queue.n_bins):
        blocks = list(queue.next_bin())
        given = source.upto(int(last_key[b]))
        arrived = [(2 * k, s, h) for k, s, h in blocks] + [(2 * given[0] + 1, given[1], given[2])]
        key, suffix, shared = (np.concatenate([a[c] for a in arrived]) for c in range(3))
        order = np.argsort(key, kind="stable")
        key, suffix, shared = key[order], suffix[order], shared[order]
        while len(key):
            some = slice(0, min(len(key), BATCH))
            causes = (suffix[some] > 0) & target[suffix[some] - 1]
            child = np.where(causes, suffix[some] - 1, 0)
            child_key = np.where(causes, 2 * source.keys(child), INF)
            limit = np.minimum.accumulate(child_key)
            blocked = np.flatnonzero(key[some][1:] > limit[:-1])
            t = int(blocked[0]) + 1 if len(blocked) else len(limit)
            k, s, seed = key[:t] // 2, suffix[:t], (key[:t] & 1).astype(bool)
            # shared with the tuple before, also across batches
            same = np.empty(t, bool)
            crossing = np.empty(t, bool)
            same[0], crossing[0] = k[0] == before[0], bool(seed[0]) != before[2]
            same[1:], crossing[1:] = k[1:] == k[:-1], seed[1:] != seed[:-1]
            earlier = np.concatenate([[max(before[1], 0)], s[:-1]])
            common = np.where(same, np.where(crossing, np.minimum(run[s], run[earlier]), shared[:t]), 0)
            before = int(k[-1]), int(s[-1]), bool(seed[-1])
            keep = slice(None) if keep_seeds else ~seed
            out.append(s[keep], common[keep])
            # what each caused suffix shares with the last one queued under its symbol
            at = np.flatnonzero(causes[:t])
            ckey = child_key[at] // 2
            by = np.argsort(ckey, kind="stable")
            at, ckey = at[by], ckey[by]
            repeat = np.zeros(len(at), bool)
            repeat[1:] = ckey[1:] == ckey[:-1]
            upto = np.minimum.accumulate(common)
            value = np.minimum(np.minimum(behind[ckey], upto[at]), since.after(pushed[ckey]))
            if repeat.any():
                r = np.flatnonzero(repeat)
                value[r] = _least_between(common, at[r - 1] + 1, at[r] + 1)
            final = np.flatnonzero(np.append(~repeat[1:], True)) if len(at) else none
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], INF)
            behind[ckey[final]], pushed[ckey[final]] = after[at[final] + 1], batch
            since.add(batch, int(upto[-1]))
            batch += 1
            nkey, nsuffix, nshared = queue.push(ckey, s[at] - 1, np.minimum(value, INF - 1) + 1)
            key, suffix, shared = key[t:], suffix[t:], shared[t:]
            if len(nkey):
                key = np.concatenate([key, 2 * nkey])
                order = np.argsort(key, kind="stable")
                key = key[order]
                suffix, shared = np.concatenate([suffix, nsuffix])[order], np.concatenate([shared, nshared])[order]
    return out


def _names(text: np.ndarray, size: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each substring text[start..stop], both ends included; an ended one is greater than its continuation."""
    bits = int(size + 1).bit_length()
    per = max(1, 63 // bits)
    rank = np.zeros(len(start), np.int64)
    live, offset = np.arange(len(start)), 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for k in range(offset, offset + per):
            at = start[live] + k
            inside = at <= stop[live]
            word = (word << bits) | np.where(inside, text[np.minimum(at, len(text) - 1)], size)
        order = np.lexsort((word, rank[live]))
        r, w = rank[live][order], word[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        new = group | np.concatenate([[True], w[1:] != w[:-1]])
        # ranks have gaps of the group's size, so parts of a group keep their order among the others
        first = np.maximum.accumulate(np.where(group, np.arange(len(r)), 0))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        rank[live[order]] = r + begin - first
        count = np.diff(np.append(np.flatnonzero(new), len(r)))
        tied = np.repeat(count > 1, count)
        offset += per
        live = live[order][tied]
        # one that ended with this word gets a word of marks, which tells it from its continuations
        live = live[start[live] + offset <= stop[live] + 1]
    names, rank = np.unique(rank, return_inverse=True)
    return rank, len(names)


def _more_common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes a and b share, given that they share ``known``."""
    out = known.copy()
    live = np.arange(len(a))
    while len(live):
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
    return out


def sort_suffixes(text: np.ndarray, size: int, disk: Disk) -> Spool:
    """All suffixes of ``text`` but the last, in descending order, each with what it shares with the one before.

    Symbols are 0 .. size - 1; the last one is 0 and the only 0.
    """
    n = len(text)
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))  # of runs of equal symbols
    length = np.diff(np.concatenate([[-1], ends]))
    rising = np.concatenate([text[ends[:-1]] < text[ends[1:]], [True]])
    is_s = np.repeat(rising, length)
    run = np.repeat(ends, length) - np.arange(n) + 1
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    m = len(star)
    if m > 1:
        name, kinds = _names(text, size, star, np.append(star[1:], n - 1))
        if kinds < m:
            found = sort_suffixes(name, kinds, disk).all(backwards=True)
            order = np.concatenate([[m - 1], found[0]])
            # common names: what a suffix shares with the one after it in descending order, moved to the later of both
            names_shared = np.concatenate([[0, 0], found[1][:-1]])
        else:
            order = np.argsort(name)
            names_shared = np.zeros(m, np.int64)
        a, b = order[:-1], order[1:]
        known = star[a + names_shared[1:]] - star[a]
        shared = np.concatenate([[0], _more_common(text, star[a], star[b], known)])
        seeds = star[order]
    else:
        seeds, shared = star, np.zeros(m, np.int64)
    spool = Spool(disk, 2)
    for at in range(0, m, BATCH):
        spool.append(seeds[at:at + BATCH], shared[at:at + BATCH])
    del seeds, shared
    falling = _induce(text, size, ~is_s, run, spool.drain(), None, disk, False)
    return _induce(text, size, is_s, run, _turned(falling), size - 1, disk, True)


def _turned(spool: Spool) -> Iterator[tuple[np.ndarray, ...]]:
    """The tuples backwards; what each shares with its new predecessor is what that one shared with it before."""
    carried = np.zeros(1, np.int64)
    for suffix, shared in spool.drain(backwards=True):
        moved = np.concatenate([carried, shared[:-1]])
        carried = shared[-1:]
        yield suffix, moved

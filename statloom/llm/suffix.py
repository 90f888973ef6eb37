"""Suffix arrays with common-prefix values by external induced sorting, for shards that need not fit in memory.

Symbols are bytes shifted by two; 1 separates texts and 0 ends the shard.  A suffix is S if it is smaller than the one
after it, else L; an S suffix behind an L suffix is a seed.  Seeds are sorted by their first induction and the ranks of
their substrings; all other suffixes follow by induction: walking the sorted suffixes upwards places every L suffix
behind its successor, walking downwards every S suffix.  What waits to be placed stands in one queue for each first symbol.
As sources are walked in order, a queue is first in first out, so the queues together are the priority queue over (symbol,
rank of the source), and they go to disk beyond a memory limit.  Each entry carries its suffix and the length of the
prefix it shares with the entry before it, cut at ``DEPTH``: one more than the least value its sources passed.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

from statloom.llm import tokens

DEPTH = 200
SYMBOLS = 258
MEMORY = 64 << 20  # bytes of queued entries held in memory
PIECE = 1 << 20  # entries taken from a queue at a time
_FAR = 255  # no entry yet


class Spool:
    """First-in-first-out queues of (suffix, common prefix) arrays by symbol, on disk beyond ``memory`` bytes."""

    def __init__(self, file, memory: int):
        self.file, self.memory, self.held = file, memory, 0
        self.queues = [deque() for _ in range(SYMBOLS)]

    def put(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        size = suffixes.nbytes + common.nbytes
        if self.held + size > self.memory:
            at = self.file.seek(0, 2)
            self.file.write(suffixes.tobytes())
            self.file.write(common.tobytes())
            self.queues[symbol].append((at, len(suffixes)))
        else:
            self.held += size
            self.queues[symbol].append((suffixes, common))

    def take(self, symbol: int, limit: int = PIECE):
        """The next entries of a queue, about ``limit`` at most, or None."""
        queue, parts, n = self.queues[symbol], [], 0
        while queue and n < limit:
            a, b = queue.popleft()
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(b), np.uint8)
            parts.append((a, b))
            n += len(a)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class _Induction:
    """Takes a stream of sorted suffixes and queues the suffix before each, if ``chosen`` wants it."""

    def __init__(self, text: np.ndarray, spool: Spool):
        self.text, self.spool = text, spool
        self.least = np.full(SYMBOLS, _FAR, np.uint8)  # least common prefix since a queue's last entry
        self.started = np.zeros(SYMBOLS, bool)

    def pass_on(self, suffixes: np.ndarray, common: np.ndarray, chosen: np.ndarray) -> None:
        at = np.flatnonzero(chosen)
        symbols = self.text[suffixes[at] - 1]
        order = np.argsort(symbols, kind="stable")
        symbols, at = symbols[order], at[order]
        first = np.flatnonzero(np.diff(symbols, prepend=SYMBOLS + 1) != 0)
        present = symbols[first]
        after = self.least.copy()
        np.minimum(after, common.min(), out=after)
        for s, i, j in zip(present.tolist(), first.tolist(), np.append(first[1:], len(at)).tolist()):
            rows = at[i:j]
            cuts = np.empty(len(rows) + 1, np.int64)
            cuts[0] = 0
            cuts[1:] = rows + 1
            whole = cuts[-1] == len(common)
            least = np.minimum.reduceat(common, cuts[:-1] if whole else cuts)
            shared = least[:len(rows)]
            shared[0] = min(shared[0], self.least[s])
            shared = np.minimum(shared, DEPTH - 1) + np.uint8(1)
            if not self.started[s]:
                shared[0] = 0
                self.started[s] = True
            after[s] = _FAR if whole else least[-1]
            self.spool.put(s, suffixes[rows] - 1, shared)
        self.least = after


def _runs(text: np.ndarray) -> np.ndarray:
    """How often the symbol at each place repeats from there on, cut at DEPTH."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    lengths = np.diff(ends, prepend=-1)
    return np.minimum(np.repeat(ends, lengths) - np.arange(len(text)) + 1, DEPTH).astype(np.uint8)


def _is_small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one, the end, is."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[:-1].astype(np.int32) - text[1:]).astype(np.int8)
    step[-1] = -1
    known = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return step[known] < 0


def _induce(text, small, runs, seeds, seed_common, folder, memory):
    """Place all suffixes from sorted seeds.  Yields for each symbol, downwards, (L suffixes upwards, their common
    prefixes, S suffixes downwards, theirs)."""
    bounds = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1)) if len(seeds) else np.zeros(SYMBOLS + 1, int)
    with tempfile.TemporaryFile(dir=folder) as waiting, tempfile.TemporaryFile(dir=folder) as placed:
        spool, large = Spool(waiting, memory), Spool(placed, memory)
        up = _Induction(text, spool)
        end = len(text) - 1
        for s in range(SYMBOLS):
            last = None
            if s == 0:  # the end itself induces first
                spare = np.array([end], np.int64)
                up.pass_on(spare, np.zeros(1, np.uint8), np.array([end > 0]))
            while (entry := spool.take(s)) is not None:
                suffixes, common = entry
                large.put(s, suffixes, common)
                before = np.maximum(suffixes - 1, 0)
                up.pass_on(suffixes, common, (suffixes > 0) & ~small[before])
                last = suffixes[-1]
            a, b = bounds[s], bounds[s + 1]
            for i in range(a, b, PIECE):
                suffixes, common = seeds[i:min(i + PIECE, b)], seed_common[i:min(i + PIECE, b)].copy()
                if i == a:
                    common[0] = 0 if last is None else min(runs[last], runs[suffixes[0]])
                if s > 0:
                    up.pass_on(suffixes, common, suffixes > 0)
        down = _Induction(text, spool)
        for s in range(SYMBOLS - 1, -1, -1):
            out_small, last = [], None
            while (entry := spool.take(s)) is not None:
                suffixes, common = entry
                out_small.append(entry)
                before = np.maximum(suffixes - 1, 0)
                down.pass_on(suffixes, common, (suffixes > 0) & small[before])
                last = suffixes[-1]
            parts = []
            while (entry := large.take(s)) is not None:
                parts.append(entry)
            l_suffixes, l_common = ((np.concatenate([p[k] for p in parts]) for k in (0, 1)) if parts
                                    else (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
            if len(l_suffixes):
                # walked downwards, an entry is compared with the one above it
                above = np.empty(len(l_common), np.uint8)
                above[:-1] = l_common[1:]
                above[-1] = 0 if last is None else min(runs[last], runs[l_suffixes[-1]])
                suffixes, common = l_suffixes[::-1], above[::-1]
                before = np.maximum(suffixes - 1, 0)
                for i in range(0, len(suffixes), PIECE):
                    cut = slice(i, i + PIECE)
                    down.pass_on(suffixes[cut], common[cut], (suffixes[cut] > 0) & small[before[cut]])
            s_suffixes, s_common = ((np.concatenate([p[k] for p in out_small]) for k in (0, 1)) if out_small
                                    else (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
            yield l_suffixes, l_common, s_suffixes, s_common


def _sorted_seeds(text, small, runs, folder, memory):
    """Seeds in order (to ``DEPTH`` symbols) and the prefix each shares with the one before."""
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(seeds):
        return seeds, np.zeros(0, np.uint8)
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    # first induction: from seeds in the order of their first symbols it sorts the substrings from seed to seed
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    found = []
    for _, _, s_suffixes, _ in _induce(text, small, runs, rough, np.zeros(len(rough), np.uint8), folder, memory):
        found.append(s_suffixes[is_seed[s_suffixes]])
    order = np.concatenate(found)[::-1]
    order = np.concatenate((seeds[-1:], order))  # the end, a seed that nothing induces
    number = np.full(len(text), -1, np.int64)
    number[seeds] = np.arange(len(seeds))
    until = np.append(seeds[1:], len(text) - 1) + 1
    prints = tokens.range_hashes(text.astype(np.uint64) + np.uint64(1), seeds, np.minimum(until, len(text)), tokens.BASE)
    index = number[order]
    new = np.ones(len(order), bool)
    new[1:] = prints[index[1:]] != prints[index[:-1]]
    rank = np.empty(len(seeds), np.int64)
    rank[index] = np.cumsum(new)
    # the string of ranks is sorted by doubling: its alphabet is too large for queues by symbol
    reach = 1
    while reach < DEPTH and len(rank) and rank.max() < len(rank):
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-reach] = rank[reach:]
        key = rank * (len(rank) + 1) + ahead
        index = np.argsort(key)
        new[1:] = key[index[1:]] != key[index[:-1]]
        rank = np.empty(len(seeds), np.int64)
        rank[index] = np.cumsum(new)
        reach *= 2
    order = seeds[np.argsort(rank)]
    return order, _common(text, order)


def _common(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix each suffix shares with the one before it in ``order``, cut at DEPTH; four symbols a step."""
    out = np.zeros(len(order), np.uint8)
    end = len(text)
    # beyond the end every place has symbols of its own
    padded = np.concatenate((text, np.zeros(4, text.dtype))).astype(np.uint64)
    packed = padded[:end] | padded[1:end + 1] << np.uint64(16) | padded[2:end + 2] << np.uint64(32) | padded[3:end + 3] << np.uint64(48)
    left, depth = np.arange(1, len(order)), 0
    while len(left) and depth < DEPTH:
        a, b = order[left - 1] + depth, order[left] + depth
        inside = (a < end) & (b < end)
        left, a, b = left[inside], a[inside], b[inside]
        differ = packed[a] ^ packed[b]
        equal = (differ & np.uint64(0xFFFF)) == 0
        step = equal.astype(np.uint8)
        for k in (1, 2, 3):
            equal &= (differ >> np.uint64(16 * k)) & np.uint64(0xFFFF) == 0
            step += equal
        out[left] += np.minimum(step, np.minimum(end - a, end - b)).astype(np.uint8)
        left = left[equal]
        depth += 4
    return np.minimum(out, DEPTH)


def repeated_starts(texts: list[bytes], length: int = DEPTH, folder: str | None = None, memory: int = MEMORY) -> list[np.ndarray]:
    """For each text the starts of the ``length``-byte strings that also start at another place of these texts."""
    if length > DEPTH:
        raise ValueError(f"common prefixes are cut at {DEPTH}")
    sizes = np.array([len(t) for t in texts], np.int64)
    limits = np.concatenate(([0], np.cumsum(sizes + 1)))
    with tempfile.TemporaryDirectory(dir=folder) as own:
        text = np.ones(int(limits[-1]) + 1, np.uint16)
        text[-1] = 0
        raw = np.frombuffer(b"\0".join(texts), np.uint8)
        text[:len(raw)] = raw.astype(np.uint16) + 2
        text[limits[1:] - 1] = 1
        small, runs = _is_small(text), _runs(text)
        seeds, common = _sorted_seeds(text, small, runs, own, memory)
        marked = np.zeros(len(text), bool)
        for l_suffixes, l_common, s_suffixes, s_common in _induce(text, small, runs, seeds, common, own, memory):
            for suffixes, shared in ((l_suffixes, l_common), (s_suffixes, s_common)):
                again = np.flatnonzero(shared >= length)
                marked[suffixes[again]] = True
                marked[suffixes[again - 1]] = True
            if len(l_suffixes) and len(s_suffixes) and min(runs[l_suffixes[-1]], runs[s_suffixes[-1]]) >= length:
                marked[l_suffixes[-1]] = marked[s_suffixes[-1]] = True
    out = []
    for a, n in zip(limits[:-1], sizes):
        out.append(np.flatnonzero(marked[a:a + max(n - length + 1, 0)]))
    return out

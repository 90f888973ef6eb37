"""Periodic runs of words: stretches that repeat one period four times or more.

For a period q, places 2q apart are looked at over all texts of a batch: a run must show three equal words in a row at one
of them.  How far the words agree before and behind such a place is a longest common extension, answered from a
difference cover: only suffixes at cover places are sorted, two places reach cover places together after a few
words, and from there the answer is the minimum of a range of common-prefix lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.tokens import joined_words, slices, text_buffer, word_array, word_spans

# fixed values: a cover of the differences modulo 13, each of which is the difference of one pair of members
CYCLE = 13
COVER = (0, 1, 3, 9)
LEAST = 6  # words a run has at least
TIMES = 4  # periods a run has at least
LOOK = 3  # equal words in a row that a run must show at a place of the grid
PLACES = 1 << 18  # places of the grid looked at together
CHUNK = 32  # entries of the common-prefix array that one entry of the sparse table stands for

_SLOT = np.full(CYCLE, -1, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _meeting() -> np.ndarray:
    """Words after which places with remainders a and b are both in the cover."""
    out = np.zeros((CYCLE, CYCLE), np.int64)
    for a in range(CYCLE):
        for b in range(CYCLE):
            out[a, b] = min(d for d in range(CYCLE) if _SLOT[(a + d) % CYCLE] >= 0 and _SLOT[(b + d) % CYCLE] >= 0)
    return out


_MEETING = _meeting()


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row among the distinct rows; the first key counts most."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(fresh)
    return out


class RangeMinimum:
    """Minimum of any range: a sparse table over chunks, running minima inside them."""

    def __init__(self, values: np.ndarray):
        chunks = max(-(-len(values) // CHUNK), 1)
        full = np.full(chunks * CHUNK, np.iinfo(values.dtype).max, values.dtype)
        full[:len(values)] = values
        self.values = full
        square = full.reshape(chunks, CHUNK)
        self.before = np.minimum.accumulate(square, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [square.min(axis=1)]
        while 2 ** len(self.table) <= chunks:
            last, reach = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-reach], last[reach:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low:high] for each pair, low < high."""
        last = high - 1
        first_chunk, last_chunk = low // CHUNK, last // CHUNK
        out = np.minimum(self.behind[low], self.before[last])
        between = last_chunk - first_chunk - 1
        for level, table in enumerate(self.table):
            here = np.flatnonzero((between >= 2 ** level) & (between < 2 ** (level + 1)))
            if len(here):
                a, b = first_chunk[here] + 1, last_chunk[here] - 2 ** level
                out[here] = np.minimum(out[here], np.minimum(table[a], table[b]))
        inside = np.flatnonzero(first_chunk == last_chunk)
        if len(inside):
            at, end = low[inside], last[inside]
            small = self.values[at]
            for step in range(1, CHUNK):
                small = np.minimum(small, self.values[np.minimum(at + step, end)])
            out[inside] = small
        return out


class Extensions:
    """How many words agree from two places on; the last word must be one that occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.full(CYCLE, -1)])
        whole = -(-n // CYCLE)
        places = (np.arange(whole)[:, None] * CYCLE + np.array(COVER)[None]).reshape(-1)
        places = places[places < n]
        levels = [_ranks(self._blocks(places))]
        step, size = len(COVER), len(places)
        while size and int(levels[-1].max()) + 1 < size:
            behind = np.full(size, -1, np.int64)
            behind[:max(size - step, 0)] = levels[-1][step:]
            levels.append(_ranks([levels[-1].astype(np.int64) * (size + 1) + behind + 1]))
            step *= 2
        self.rank = levels[-1]
        order = np.empty(size, np.int64)
        order[self.rank] = np.arange(size)
        self.common = RangeMinimum(self._neighbours(levels, order, places))

    def _blocks(self, places: np.ndarray) -> list[np.ndarray]:
        """The CYCLE words from each place on, packed into as few numbers as hold them."""
        bits = int(self.words.max() + 1).bit_length()
        each, keys = max(62 // bits, 1), []
        for first in range(0, CYCLE, each):
            key = np.zeros(len(places), np.int64)
            for shift in range(first, min(first + each, CYCLE)):
                key = (key << bits) | (self.words[places + shift] + 1)
            keys.append(key)
        return keys

    def _neighbours(self, levels, order: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Words that neighbours in sorted order have in common: whole blocks by falling powers of two, then single words."""
        a, b = order[:-1].copy(), order[1:].copy()
        size, blocks = len(order), np.zeros(max(len(order) - 1, 0), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank = levels[level]
            inside = np.flatnonzero((a < size) & (b < size))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            blocks[same] += 1 << level
            a[same] += len(COVER) << level
            b[same] += len(COVER) << level
        # a place after whole common blocks is a place of the sample, as no common part holds the last word
        out = blocks * CYCLE
        x, y = places[a], places[b]
        live = np.arange(len(out))
        for shift in range(CYCLE):
            live = live[self.words[x[live] + shift] == self.words[y[live] + shift]]
            out[live] += 1
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from each pair of different places on."""
        meet = _MEETING[a % CYCLE, b % CYCLE]
        out = meet.copy()
        live = np.arange(len(a))
        for shift in range(CYCLE):
            live = live[meet[live] > shift]
            differ = self.words[a[live] + shift] != self.words[b[live] + shift]
            out[live[differ]] = shift
            live = live[~differ]
        met = np.flatnonzero(out == meet)
        x, y = a[met] + meet[met], b[met] + meet[met]
        x = self.rank[x // CYCLE * len(COVER) + _SLOT[x % CYCLE]]
        y = self.rank[y // CYCLE * len(COVER) + _SLOT[y % CYCLE]]
        out[met] += self.common(np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64))
        return out


def _fenced(words: np.ndarray, limits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows one after the other with a word that occurs once before, between and behind them, and each row's first place."""
    sizes = np.diff(limits)[rows]
    first = np.cumsum(sizes + 1) - sizes
    total = int(sizes.sum()) + len(rows) + 1
    out = np.empty(total, np.int64)
    fence = np.concatenate([[0], first + sizes])
    alphabet = int(words.max()) + 1 if len(words) else 0
    out[fence] = alphabet + np.arange(len(fence))
    inner = np.ones(total, bool)
    inner[fence] = False
    out[inner] = np.concatenate([words[limits[r]:limits[r + 1]] for r in rows]) if len(rows) else []
    return out, first


def _grid(sizes: np.ndarray, ends: np.ndarray):
    """Every period with the places 2 periods apart in rows that can hold a run of it; rows stand longest first.

    Periods with many places come one by one, the others many at once.
    """
    q = np.arange(1, int(sizes[0]) // TIMES + 1)
    end = ends[np.searchsorted(-sizes, -np.maximum(LEAST, TIMES * q), "right") - 1]
    counts = np.maximum(-(-(end - q - 1) // (2 * q)), 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    now = 0
    while now < len(q):
        if counts[now] > PLACES // 64:
            yield np.arange(1, end[now] - q[now], 2 * q[now]), q[now]
            now += 1
            continue
        until = max(int(np.searchsorted(total, total[now] + PLACES, "right")) - 1, now + 1)
        each = np.repeat(q[now:until], counts[now:until])
        at = np.arange(len(each)) - np.repeat(total[now:until] - total[now], counts[now:until])
        yield 1 + at * (2 * each), each
        now = until


def find_runs(words: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row, length and period of every run, by row, start and period.

    ``words`` are numbers, ``limits`` where rows begin and end.  A run has a smallest period q, at least max(LEAST,
    TIMES * q) words, and no longer stretch of period q holds it.  Grid places that show fewer than LOOK equal words are
    no part of a run; only rows with other places are sorted.
    """
    sizes = np.diff(limits)
    rows = np.argsort(-sizes, kind="stable")
    rows = rows[sizes[rows] >= LEAST]
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(rows):
        return nothing
    line, first = _fenced(words, limits, rows)
    line = np.concatenate([line, -1 - np.arange(LOOK)])
    ordered = sizes[rows]
    places, periods = [], []
    for at, q in _grid(ordered, first + ordered + 1):
        hit = line[at] == line[at + q]
        for shift in range(LOOK):
            at, q = at[hit], (q[hit] if np.ndim(q) else q)
            if shift + 1 < LOOK:
                hit = line[at + shift + 1] == line[at + q + shift + 1]
        if len(at):
            places.append(at)
            periods.append(np.broadcast_to(q, len(at)))
    if not places:
        return nothing
    place, period = np.concatenate(places), np.concatenate(periods)
    number = np.searchsorted(first, place, "right") - 1
    one_row = place + period < (first + ordered)[number]
    place, period, number = place[one_row], period[one_row], number[one_row]
    used = np.unique(number)
    if not len(used):
        return nothing
    place = place - first[number]
    number = np.searchsorted(used, number)
    line, first = _fenced(words, limits, rows[used])
    place = place + first[number]
    ahead = Extensions(line)(place, place + period)
    back = len(line) - place
    behind = Extensions(line[::-1])(back, back - period)
    start, length = place - behind, behind + ahead + period
    long = length >= np.maximum(LEAST, TIMES * period)
    row, start, length, period = rows[used][number[long]], (start - first[number])[long], length[long], period[long]
    order = np.lexsort((period, length, start, row))
    row, start, length, period = row[order], start[order], length[order], period[order]
    # one stretch is found under its period and under multiples of it: the smallest stays
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    row, start, length, period = row[~again], start[~again], length[~again], period[~again]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for low, high in slices(offsets, 4 << 20):
            part, limits = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            starts, ends, limits = word_spans(part, limits)
            words = word_array(part, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
            row, start, length, period = find_runs(words, limits)
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, limits[row] + start + period, 1)
            np.add.at(edges, limits[row] + start + length, -1)
            text = joined_words(part, starts, ends, limits, np.cumsum(edges[:-1]) == 0)
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), runs, text], ["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``runs`` (start, length and period in words, by start and period) and ``collapsed`` text of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  Runs are those of ``find_runs``.  ``collapsed`` keeps the
    words that no run holds after its first period, joined by one space.

    A null or empty text, or one of white space, has no runs and an empty text.  Rows are judged alone: repeated and null
    ids stay as they are, other columns are left out.  A row of any length is one piece of work.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(_runs, schema).withColumnRenamed("id", id_col)


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tenth of the texts, by the checksum of the id, with a tail that repeats its own beginning 3 to 10 times.

    The words are joined by one space there.  Other texts, those without words and those with a null id stay as they are.
    """
    check = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    tenth = F.floor(check / 10)
    first = tenth % F.greatest(n, F.lit(1))
    left = n - first
    period = F.floor(left / (tenth % 8 + 3)) + 1
    tail = F.slice(words, (first + 1).cast("int"), F.greatest(period, F.lit(1)).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(tail, 11)), 1, F.greatest(left, F.lit(0)).cast("int"))
    text = F.array_join(F.concat(F.slice(words, 1, first.cast("int")), tail), " ")
    return docs.withColumn(text_col, F.when((check % 10 == 0) & (n > 0), text).otherwise(F.col(text_col)))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One line a row of ``periodic_runs``: number of runs, the longest one, and digests of all runs and of the text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("place"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       _digest(F.array_join(lines, "")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select(id_col, "n_runs", (-F.col("best.place")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.period")).alias("period"),
                      F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

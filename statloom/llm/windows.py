"""Repeated word windows: count-min sketches of window fingerprints, then exact groups of what may repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import tokens
from statloom.llm.store import keep, lean, settled

WINDOW = 20
CORE = 10  # a window is counted by the rarest-hashed run of so many words inside it
SHARD = 1 << 20  # cells in a shard of the sketch
LARGEST = 1 << 30  # cells: 128 MB of bits
CHECK_BASE = 0xD6E8FEB86659FD93  # multiplier of the second window hash


def _cores(words: np.ndarray, limits: np.ndarray, window: int, core: int):
    """For every window that fits: its first word, and the first word of its core."""
    runs = tokens.sequence_hashes(words, core)
    places = tokens.minimisers(runs, window - core + 1)
    fits = tokens.window_starts(limits, window)[:len(places)]
    starts = np.flatnonzero(fits)
    return starts, places[starts], runs


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's cells in the two rows of the sketch, each half of it."""
    half = np.uint64(cells // 2)
    return hashes % half, half + tokens.mix(hashes ^ np.uint64(CHECK_BASE)) % half


def counted(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Whether the smaller of a hash's two counts is two or more."""
    out = np.ones(len(hashes), bool)
    for cell in _cells(hashes, cells):
        out &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _core_values(window: int, core: int):
    """Hashes of the cores of a text column, each place once."""
    def values(column):
        data, offsets = tokens.text_buffer(column)
        for a, b in tokens.slices(offsets):
            words, _, _, limits = tokens.word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], False)
            _, places, runs = _cores(words, limits, window, core)
            yield runs[np.unique(places)]
    return values


def _sketches(values, cells: int):
    """One partition's sketch: counts (1, or 2 for more) of the cells it touches, by shard, as packed bytes."""
    def run(batches):
        once = np.zeros(0, np.uint64)
        twice = np.zeros(0, np.uint64)

        def fold(parts, once, twice):
            every = np.concatenate([once, *parts])
            every.sort()
            same = every[1:] == every[:-1]
            first = np.ones(len(every), bool)
            first[1:] = ~same
            return every[first], np.union1d(twice, every[1:][same])

        parts, held = [], 0
        for batch in batches:
            for found in values(batch.column(0)):
                parts.extend(_cells(found, cells))
                held += 2 * len(found)
                if held > 1 << 20:
                    once, twice = fold(parts, once, twice)
                    parts, held = [], 0
        once, twice = fold(parts, once, twice)
        shards, first = np.unique(once // np.uint64(SHARD), return_index=True)
        ends = np.append(first[1:], len(once))
        for s, i, j in zip(shards, first, ends):
            low = np.uint64(int(s) * SHARD)
            again = twice[np.searchsorted(twice, low):np.searchsorted(twice, low + np.uint64(SHARD))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(s)]), pa.array([_pack((once[i:j] - low).astype(np.uint32))]),
                 pa.array([_pack((again - low).astype(np.uint32))])], ["shard", "once", "twice"])
    return run


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as gaps: two bytes each, a longer gap as 65535s and a rest."""
    gaps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    long = gaps // 65535
    if not long.any():
        return gaps.astype("<u2").tobytes()
    at = np.arange(len(gaps)) + np.cumsum(long)
    out = np.full(int(at[-1]) + 1, 65535, "<u2")
    out[at] = gaps % 65535
    return out.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, "<u2").astype(np.int64)
    end = gaps < 65535
    return (np.cumsum(gaps) + np.cumsum(end) - 1)[end]


def _merge(batches):
    """Add up the sketches of each shard, which come one after the other; give cells counted twice or more as bits."""
    seen, again, shard = None, None, None

    def bits():
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([np.packbits(again, bitorder="little").tobytes()])], ["shard", "bits"])

    for batch in batches:
        for s, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != shard:
                if shard is not None and again.any():
                    yield bits()
                seen, again, shard = np.zeros(SHARD, bool), np.zeros(SHARD, bool), s
            cells = _unpack(once)
            again[cells[seen[cells]]] = True
            seen[cells] = True
            again[_unpack(twice)] = True
    if shard is not None and again.any():
        yield bits()


def _first_of_row(row: np.ndarray, starts: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Marks what stands in its row for the first time, by all keys."""
    order = np.lexsort((starts, *keys, row))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in (row, *keys)])
    return ~again


def _slices(batches, window: int, core: int, cells: int, bits: np.ndarray):
    """Words, row limits, window starts and core places of windows whose core is counted in the bits, and the rows' keys."""
    for batch in batches:
        data, offsets = tokens.text_buffer(batch.column(2))
        for a, b in tokens.slices(offsets):
            words, _, _, limits = tokens.word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], False)
            starts, places, runs = _cores(words, limits, window, core)
            likely = counted(bits, runs[places], cells)
            if likely.any():
                yield words, limits, starts[likely], places[likely], runs, [batch.column(c).slice(a, b - a) for c in (0, 1)]


def _surroundings(window: int, core: int, cells: int, shared):
    """For every core place that may repeat: its windows as one stretch of words, with a hash of the stretch and the core's place in it."""
    def run(batches):
        for words, limits, starts, places, runs, keys in _slices(batches, window, core, cells, shared.value):
            first = np.flatnonzero(np.diff(places, prepend=-1) != 0)
            last = np.append(first[1:], len(places)) - 1
            low, high, place = starts[first], starts[last] + window, places[first]
            prints = tokens.mix(tokens.range_hashes(words, low, high, tokens.WORD_BASE) + (place - low).astype(np.uint64))
            row = np.searchsorted(limits, low, "right") - 1
            fresh = _first_of_row(row, low, prints, runs[place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[place].view(np.int64)), pa.array(prints.view(np.int64)), *[k.take(pa.array(row)) for k in keys],
                 pa.array((low - limits[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(~fresh)],
                ["core", "print", "doc_id", "twin", "start", "n", "again"])
    return run


def _windows(window: int, core: int, cells: int, shared):
    """Every window whose core is counted in the bits, with 96 bits of hash."""
    def run(batches):
        for words, limits, starts, _, _, keys in _slices(batches, window, core, cells, shared.value):
            first = tokens.range_hashes(words, starts, starts + window, tokens.WORD_BASE)
            second = tokens.range_hashes(words, starts, starts + window, CHECK_BASE) >> np.uint64(32)
            row = np.searchsorted(limits, starts, "right") - 1
            fresh = _first_of_row(row, starts, second, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.view(np.int64)), pa.array(second.astype(np.uint32).view(np.int32)), *[k.take(pa.array(row)) for k in keys],
                 pa.array((starts - limits[row]).astype(np.int32)), pa.array(~fresh)],
                ["hash", "check", "doc_id", "twin", "start", "again"])
    return run


def _bits_of(cells: int):
    """Cells of hashes, each hash taken as if it had been counted twice, as one sketch."""
    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            every = np.unique(np.concatenate(_cells(hashes, cells))) if len(hashes) else np.zeros(0, np.uint64)
            shards, first = np.unique(every // np.uint64(SHARD), return_index=True)
            for s, i, j in zip(shards, first, np.append(first[1:], len(every))):
                some = _pack((every[i:j] - np.uint64(int(s) * SHARD)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([some]), pa.array([some])], ["shard", "once", "twice"])
    return run


def _cut(window: int):
    """Digest of the words outside the marked windows."""
    def run(batches):
        for batch in tokens.pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            n_words, n_removed, digests = [], [], []
            for text, marks in zip(texts, batch.column("marks")):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                first, last, _ = tokens.word_spans(data, np.array([0, len(data)]))
                gone = np.zeros(len(first) + 1, np.int64)
                if marks.is_valid and len(marks.values):
                    low, n = (marks.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    np.add.at(gone, low, 1)
                    np.add.at(gone, np.minimum(low + n - 1 + window, len(first)), -1)
                keep_at = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                raw = data.tobytes()
                kept = b" ".join([raw[i:j] for i, j in zip(first[keep_at].tolist(), last[keep_at].tolist())])
                n_words.append(len(first))
                n_removed.append(len(first) - len(keep_at))
                digests.append((kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array([d for _, d in digests], pa.string()), pa.array([t for t, _ in digests], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def core_bits(docs: DataFrame, values, rate: float, cells: int | None = None) -> tuple[np.ndarray, int]:
    """Bits of the cells that the hashes given by ``values`` fall into twice or more, and the number of cells.

    ``values`` turns a text column into arrays of hashes; ``rate`` is how many it gives a byte, for the sketch's size.
    """
    if cells is None:
        n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
        cells = min(max(1 << int(8 * n * rate).bit_length(), SHARD), LARGEST)
    return _merged(docs.select("text").mapInArrow(lean(_sketches(values, cells)), SKETCH), cells), cells


SKETCH = "shard long, once binary, twice binary"


def _merged(sketches: DataFrame, cells: int) -> np.ndarray:
    rows = sketches.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_merge), "shard long, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for r in rows.toLocalIterator():
        bits[r["shard"] * (SHARD // 8):(r["shard"] + 1) * (SHARD // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


@settled
def repeated_windows(docs: DataFrame, window: int = WINDOW, core: int = CORE, cells: int | None = None) -> DataFrame:
    """(doc_id, twin, start, n): from ``start`` on, ``n`` windows of ``docs(doc_id, twin, text)`` whose words also start earlier.

    1. A window is counted through its core, the run of ``core`` words in it with the smallest hash.  Equal windows have
       equal cores at different places, so a core occurs at least as often as the window.  Every partition sketches the
       counts of its cores; the sketches are merged shard by shard.  A core has a cell in each of two rows; a cell
       counts whatever falls into it, so the smaller of the two counts is never too low.  The sketch has at least eight cells a core up to ``LARGEST``; beyond it more windows
       pass, none less.
    2. The cells counted twice or more go to all tasks as bits (``LARGEST`` / 8 bytes at most).  The windows of one core place,
       about six, are sent as one stretch of words, by 128 bits of hash.  What repeats as a whole inside a row is marked there;
       a stretch in several documents stays in the smallest and is marked in the others.
    3. Cores that stand in different stretches are given back to the tasks as bits of the same kind.  Their windows are grouped one by
       one, by 96 bits of hash, in the same way.

    Groups are reduced before the shuffle, and marked rows come from a join with one row a group, so the windows of one very
    common passage are never in one task.
    """
    # about six bytes a word, and one core in (window - core + 2) / 2 words
    bits, cells = core_bits(docs, _core_values(window, core), 1 / (3 * (window - core + 2)), cells)
    context, texts = docs.sparkSession.sparkContext, docs.select("doc_id", "twin", "text")
    row = "doc_id long, twin long, start int"
    parts = keep(texts.mapInArrow(lean(_surroundings(window, core, cells, context.broadcast(bits))),
                                  f"core long, print long, {row}, n int, again boolean"), "stretches")
    groups = keep(parts.filter("not again").groupBy("core", "print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "groups")
    mixed = groups.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core")
    mixed = context.broadcast(_merged(mixed.mapInArrow(lean(_bits_of(cells)), SKETCH), cells))
    single = keep(texts.mapInArrow(lean(_windows(window, core, cells, mixed)), f"hash long, check int, {row}, again boolean"), "windows")

    def later(found: DataFrame, keys: list[str], lowest: DataFrame) -> DataFrame:
        known = lowest.filter("low < high").select(*keys, "low")
        return found.filter("not again").join(known, keys).filter("doc_id > low").unionByName(found.filter("again"), allowMissingColumns=True)

    alone = single.filter("not again").groupBy("hash", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return (later(parts, ["core", "print"], groups).select("doc_id", "twin", "start", "n")
            .unionByName(later(single, ["hash", "check"], alone).select("doc_id", "twin", "start", F.lit(1).alias("n"))))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                          core: int = CORE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space) for every row.

    A word goes if a ``window``-word run over it also starts earlier in the corpus: in a smaller id, or before in the same
    row.  Runs are judged on the input.  A null text has no words.  A null id comes last.  Rows that repeat an
    id, or have none, are documents of their own, of which none is earlier than another; a row is known by its id and a hash of its text.
    Other columns are not read.
    """
    last = F.lit(2**63 - 1)
    text = F.col(text_col).cast("string")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    marks = repeated_windows(source, window, core).groupBy("doc_id", "twin").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    cut = source.join(marks, ["doc_id", "twin"], "left").select("doc_id", "text", "marks").mapInArrow(
        lean(_cut(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return cut.withColumn("doc_id", F.nullif("doc_id", last))

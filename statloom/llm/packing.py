"""Harmonic packing: pieces of like length share sequences, a fixed number of them each.

A piece of length in (capacity / (k + 1), capacity / k] belongs to class k, and a sequence of class k holds k pieces of it.
What such a sequence leaves free, and pieces below the last class, is the part of the loose stream, which is cut freely.
Every task packs its own documents.
"""

from __future__ import annotations

import os
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.tokens import slices, text_buffer, word_array, word_spans

CAPACITY = 4096
CLASSES = 8  # shorter pieces than capacity / (CLASSES + 1) are loose
KNOWN = 1 << 20  # words after which a worker forgets those it has met
LINE = 100  # words of letters that are encoded together
WORD_END = "</w>"  # fixed value: ends the name of an id that ends a word
STEP = 1 << 20  # words whose ids are laid out at a time
SLICE = 8 << 20  # bytes of text encoded at a time
OUT = 8 << 20  # bytes of ids in one Arrow batch

_tokenizers: dict = {}

_KIND = np.full(256, 3, np.uint8)  # other ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the places inside ranges that do not overlap."""
    edges = np.zeros(size + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8) > 0


def parts_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with small ASCII letters, start and end of each part of a word, and the row limits in the list of parts.

    A word is split where an ASCII letter meets another kind of ASCII character, and around ASCII digits.  Nothing is changed next to other
    characters, which may combine with their neighbours, nor in words with an apostrophe or ``<``, which begin contractions and special tokens.
    """
    starts, ends, _ = word_spans(data, offsets)
    kind = _KIND[data]
    marks = np.flatnonzero((data == 39) | (data == 60))
    odd = np.unique(np.searchsorted(starts, marks, "right") - 1)
    plain = ~_covered(len(data), starts[odd], ends[odd])
    small = plain.copy()
    small[:-1] &= kind[1:] != 4
    split = np.zeros(len(data) + 1, bool)
    left, right = kind[:-1], kind[1:]
    split[1:-1] = (left > 0) & (left < 4) & (right > 0) & (right < 4) & ((left != right) | (left == 2)) & plain[1:]
    split[offsets] = False
    begins, stops = split.copy(), split
    begins[starts] = True
    stops[ends] = True
    # a row may begin where another ends, so a place can be both
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    return np.where(small, _LOWER[data], data), begins, stops, np.searchsorted(begins, offsets)


class WordIds:
    """Ids of words under a tokenizer that lower-cases, never looks across ASCII white space and gives it no ids, and splits letters,
    single digits and other characters from each other."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.limits = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list) -> list:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Ids of words not met before.

        Words of letters alone go to the tokenizer many at a time: each ends with the only id that may end a word.  If a
        line doesn't give as many ends as words, its words are encoded alone, as are all others.
        """
        letters = pc.utf8_is_alpha(words)
        joined, single = words.filter(letters).to_pylist(), words.filter(pc.invert(letters)).to_pylist()
        lines = [joined[i:i + LINE] for i in range(0, len(joined), LINE)]
        order, ids, sizes = [], [], []
        for line, found in zip(lines, self._encode([" ".join(line) for line in lines])):
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(line) or ends[-1] != len(found):
                single += line
                continue
            order += line
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        alone = self._encode(single)
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        self.words = pa.concat_arrays([self.words, pa.array(order + single, pa.large_string())])
        self.flat = np.concatenate([self.flat, *ids, *alone])
        self.limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum(np.concatenate(sizes))])

    def _lookup(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known ones."""
        if len(self.words) > KNOWN:
            self._forget()
        new = words.filter(pc.invert(pc.is_in(words, value_set=self.words)))
        if len(new):
            self._learn(new)
        return pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's ids begin and end."""
        data, starts, ends, limits = parts_of_words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), limits
        coded = word_array(data, starts, ends).dictionary_encode()
        word = self._lookup(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        first, sizes = self.limits[:-1], np.diff(self.limits)
        ahead = np.zeros(len(word) + 1, np.int64)
        np.cumsum(sizes[word], out=ahead[1:])
        out = np.empty(int(ahead[-1]), np.uint32)
        for low in range(0, len(word), STEP):
            high = min(low + STEP, len(word))
            some = word[low:high]
            place = np.repeat(first[some] - ahead[low:high], sizes[some]) + np.arange(ahead[low], ahead[high])
            out[ahead[low]:ahead[high]] = self.flat[place]
        return out, ahead[limits]


class Packer:
    """Sequences of one task.  ``done`` collects (document, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, capacity: int, classes: int, first: int = 0):
        self.capacity, self.classes, self.sequence = capacity, classes, first
        self.open: dict = {k: [] for k in range(1, classes + 1)}
        self.loose: deque = deque()
        self.free = 0  # loose ids
        self.done: list = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._emit([(doc, start, ids[start:start + self.capacity], total)])
            start += self.capacity
        if start == total:
            return
        piece = doc, start, ids[start:], total
        k = self.capacity // (total - start)
        if k > self.classes or self.free < self.capacity // (k + 1):
            self._loosen(piece)
            while self.free >= 2 * self.capacity:
                self._emit(self._take(self.capacity))
            return
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            used = sum(len(p[2]) for p in self.open[k])
            self._emit(self.open[k] + self._take(self.capacity - used))
            self.open[k] = []

    def finish(self) -> None:
        """Pieces of unfinished sequences become loose; the rest goes into full sequences and powers of two."""
        for k, pieces in self.open.items():
            for piece in pieces:
                self._loosen(piece)
            self.open[k] = []
        while self.free:
            self._emit(self._take(min(self.capacity, 1 << (self.free.bit_length() - 1)) if self.free < self.capacity else self.capacity))

    def _loosen(self, piece) -> None:
        self.loose.append(piece)
        self.free += len(piece[2])

    def _take(self, size: int) -> list:
        out, self.free = [], self.free - size
        while size:
            doc, start, ids, total = self.loose.popleft()
            if len(ids) > size:
                self.loose.appendleft((doc, start + size, ids[size:], total))
                ids = ids[:size]
            out.append((doc, start, ids, total))
            size -= len(ids)
        return out

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


def _table(done: list, kind: pa.DataType) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*done)
    sizes = [len(i) for i in ids]
    limits = np.concatenate([[0], np.cumsum(sizes)]) * 4
    data = np.concatenate(ids).astype("<u4")
    binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), binary, pa.array(total, pa.int64()),
         pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
        ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _pack(shared, capacity: int, classes: int, end_id: int):
    def run(batches):
        name, vocabulary = shared.value
        if name not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[name] = WordIds(vocabulary)
        encode = _tokenizers[name]
        packer, kind, size = Packer(capacity, classes, TaskContext.get().partitionId() << 40), None, 0
        for batch in batches:
            kind = batch.column(0).type
            docs = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for low, high in slices(offsets, SLICE):
                ids, limits = encode(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                closed = np.insert(ids, limits[1:], end_id)
                edges = limits + np.arange(len(limits))
                for row in range(high - low):
                    packer.add(docs[low + row], closed[edges[row]:edges[row + 1]])
                size += closed.nbytes
                if size >= OUT and packer.done:
                    yield _table(packer.done, kind)
                    packer.done, size = [], 0
        packer.finish()
        if packer.done:
            yield _table(packer.done, kind)
    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, classes: int = CLASSES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the id, ``start`` and ``length`` in its document, ``ids`` (little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` there.

    ``vocabulary`` is the path of a file of ``tokenizers`` of the kind that ``WordIds`` needs, so that a text's ids are
    those of the parts of its words; the driver reads it and the tasks get its contents, which do not grow with the data.  A document is
    its text's ids and ``end_id``.  A document of ``capacity`` ids or more gives whole sequences first.  The rest goes
    to its class as one piece while the loose stream can fill what the class leaves free, else to the stream.  A task ends with the
    stream in full sequences and what is left in powers of two, so no sequence needs padding.

    A null or empty text is ``end_id`` alone.  Rows that repeat an id are documents of their own, null ids stay null,
    other columns are left out; no rows give no pieces.  A task holds one sequence a class, two of loose ids and
    one Arrow batch.  Which documents meet depends on how the rows are partitioned.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, file.read()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, "
              "sequence_id long, offset long")
    return rows.mapInArrow(_pack(shared, capacity, classes, end_id), schema).withColumnRenamed("id", id_col)

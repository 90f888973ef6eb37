"""Repeated byte strings: text around repeated anchors is dealt to shards, and each shard's suffix array finds the repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import suffix, tokens
from statloom.llm.store import keep, lean, release, settled
from statloom.llm.windows import core_bits, counted

LENGTH = 200
ANCHOR = 16  # bytes hashed for an anchor
SHARD_BYTES = 2 << 20  # text a suffix array is meant to get; a larger shard spills
CROWD = 20_000  # different surroundings of one anchor beyond which its strings are grouped by hash instead

SEGMENT = "anchor long, print_a long, print_b long, doc_id long, twin int, start long, size int, text binary"  # size: bytes * 256 + anchor's place
KEY = ["anchor", "print_a", "print_b"]


def _anchor_values(data: np.ndarray) -> np.ndarray:
    return tokens.sequence_hashes(tokens.byte_values(data), ANCHOR)


def _anchors(batch_text, length: int):
    """For every row of a column: its bytes, the hashes of its anchors-to-be and each string's anchor place."""
    data, offsets = tokens.text_buffer(batch_text)
    for i in range(len(offsets) - 1):
        one = data[offsets[i]:offsets[i + 1]]
        if len(one) >= length:
            values = _anchor_values(one)
            yield i, one, values, tokens.minimisers(values, length - ANCHOR + 1)


def _sketch_values(length: int):
    def values(column):
        for _, _, hashes, places in _anchors(column, length):
            yield hashes[np.unique(places)]
    return values


def _segments(length: int, cells: int, shared):
    """The surroundings of every anchor that may repeat: all strings that have it as theirs, as one piece of text.

    Equal surroundings in one batch send their text once.
    """
    def run(batches):
        bits = shared.value
        for batch in batches:
            parts, texts = [], []
            for i, one, values, places in _anchors(batch.column(1), length):
                first = np.flatnonzero(np.diff(places, prepend=-1) != 0)
                last = np.append(first[1:], len(places)) - 1
                maybe = counted(bits, values[places[first]], cells)
                first, last = first[maybe], last[maybe]
                if not len(first):
                    continue
                ends, lead = last + length, places[first] - first  # where the anchor stands is part of the identity
                base = tokens.byte_values(one)
                a = tokens.mix(tokens.range_hashes(base, first, ends, tokens.WORD_BASE) + lead.astype(np.uint64))
                b = tokens.mix(tokens.range_hashes(base, first, ends, tokens.BASE) ^ lead.astype(np.uint64))
                parts.append((values[places[first]].view(np.int64), a.view(np.int64), b.view(np.int64), np.full(len(first), i),
                              first, ends - first, lead))
                raw = one.tobytes()
                texts.extend([raw[s:e] for s, e in zip(first.tolist(), ends.tolist())])
                if len(texts) >= 16384:
                    yield _segment_batch(batch.column(0), batch.column(2), parts, texts)
                    parts, texts = [], []
            if texts:
                yield _segment_batch(batch.column(0), batch.column(2), parts, texts)
    return run


def _segment_batch(ids, twins, parts, texts):
    anchor, a, b, row, start, n, lead = (np.concatenate(x) for x in zip(*parts))
    _, first = np.unique(a, return_index=True)
    again = np.ones(len(a), bool)
    again[first] = False
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor), pa.array(a), pa.array(b), ids.take(pa.array(row)), twins.take(pa.array(row)), pa.array(start), pa.array((n * 256 + lead).astype(np.int32)),
         pa.array(texts, pa.binary(), mask=again)], ["anchor", "print_a", "print_b", "doc_id", "twin", "start", "size", "text"])


STEPS = 8


def _alike(anchors: np.ndarray, leads: np.ndarray, texts: list, length: int) -> np.ndarray:
    """Which texts share enough with another one of their anchor to hold a common string.

    A string reaches some bytes to the left of its anchor and the rest to the right.  Cut by how far left in ``STEPS`` classes,
    all strings of a class hold one stretch around the anchor; without another text that has the same stretch there is none.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    place = ends - sizes + leads
    base = tokens.byte_values(np.frombuffer(b"".join(texts), np.uint8))
    room = length - ANCHOR
    step = -(-room // STEPS)
    out = np.zeros(len(texts), bool)
    for c in range(STEPS):
        low, high = place - step * c, place + ANCHOR + max(0, room - step * (c + 1))
        inside = np.flatnonzero((low >= ends - sizes) & (high <= ends))
        key = tokens.mix(tokens.range_hashes(base, low[inside], high[inside], tokens.WORD_BASE) ^ tokens.mix(anchors[inside]))
        _, group, n = np.unique(key, return_inverse=True, return_counts=True)
        out[inside[n[group] > 1]] = True
    return out


def _shard(length: int):
    """One task's surroundings through one suffix array; the repeated strings of those that are there once."""
    def run(batches):
        keys, texts = [], []
        for batch in batches:
            keys.append(np.stack([batch.column(k).to_numpy() for k in range(5)]))
            texts.extend(batch.column(5).to_pylist())
        if not texts:
            return
        keys = np.concatenate(keys, axis=1)
        chosen = np.flatnonzero(_alike(keys[0].view(np.uint64), keys[4] % 256, texts, length))
        keys, texts = keys[:, chosen], [texts[i] for i in chosen]
        out: list[list] = [[] for _ in range(5)]
        for i, starts in enumerate(suffix.repeated_starts(texts, length) if texts else []):
            if keys[3, i] == 1 and len(starts):
                new = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
                for s, e in zip(starts[new].tolist(), starts[np.append(new[1:], len(starts)) - 1].tolist()):
                    for k, v in enumerate((*keys[:3, i].tolist(), s, e + length)):
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [*KEY, "low", "high"])
    return run


def _strings(length: int):
    """Every string of the given surroundings with 128 bits of hash, for anchors with too many of them."""
    def run(batches):
        for batch in batches:
            for anchor, a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5))):
                base = tokens.byte_values(np.frombuffer(text, np.uint8))
                at = np.arange(len(text) - length + 1)
                x = tokens.range_hashes(base, at, at + length, tokens.WORD_BASE).view(np.int64)
                y = tokens.range_hashes(base, at, at + length, tokens.BASE).view(np.int64)
                same = [pa.array(np.full(len(at), v)) for v in (anchor, a, b)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at), pa.array(x), pa.array(y)], [*KEY, "low", "x", "y"])
    return run


@settled
def repeated_spans(docs: DataFrame, length: int = LENGTH, cells: int | None = None, shard_bytes: int = SHARD_BYTES,
                   crowd: int = CROWD) -> DataFrame:
    """(doc_id, twin, low, high): byte ranges that together are all ``length``-byte strings of ``docs(doc_id, twin, text)`` that also
    start anywhere else.

    1. The anchor of a string is its ``ANCHOR``-byte run with the smallest hash; equal strings have equal anchors.
       A sketch of anchor counts, as bits of bounded size, rules out most text.
    2. The rest is sent as surroundings: the union of a place's strings with one anchor.  Equal surroundings repeat as a
       whole and are reduced to one before the shuffle.  Where an anchor has several surroundings, and one of them only
       once, they are dealt to shards by the anchor.  A shard leaves out those that share no long enough stretch
       with another, and its suffix array marks the strings that are in it twice.
    3. An anchor with over ``crowd`` different surroundings (a passage that very many documents quote) is not given to one
       shard: its strings are counted by hash, with partial sums, and joined back.
    """
    bits, cells = core_bits(docs, _sketch_values(length), 2.0 / (length - ANCHOR + 2), cells)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    places = keep(docs.select("doc_id", "text", "twin").mapInArrow(lean(_segments(length, cells, shared)), SEGMENT), "segments")
    groups = keep(places.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("text").alias("text"), F.min("size").cast("long").alias("size")),
                  "surroundings")
    several = keep(groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest"), F.sum(F.floor(F.col("size") / 256)).alias("bytes"))
                   .filter("kinds > 1 and fewest = 1").select("anchor", "kinds", "bytes"), "several")
    total = several.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).collect()[0]["n"]
    shards = max(1, -(-total // shard_bytes))
    mixed = groups.join(several, "anchor").select(*KEY, "copies", "size", "text", "kinds")
    small, large = mixed.filter(F.col("kinds") <= crowd).drop("kinds"), mixed.filter(F.col("kinds") > crowd).drop("kinds")
    spans = "anchor long, print_a long, print_b long, low long, high long"
    parts = small.repartition(shards, "anchor").mapInArrow(lean(_shard(length)), spans)
    counted = large.mapInArrow(lean(_strings(length)), "anchor long, print_a long, print_b long, low long, x long, y long")
    repeated = counted.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1").select("x", "y")
    crowded = counted.join(repeated, ["x", "y"]).select(*KEY, "low", (F.col("low") + length).alias("high"))
    whole = groups.filter("copies > 1").select(*KEY, F.lit(0).cast("long").alias("low"), F.floor(F.col("size") / 256).cast("long").alias("high"))
    marks = keep(parts.unionByName(crowded).unionByName(whole), "marks")
    return places.select(*KEY, "doc_id", "twin", "start").join(marks, KEY).select(
        "doc_id", "twin", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def _cut(batches):
    """Digest and rest of each text without its marked ranges."""
    for batch in tokens.pieces(batches, "text"):
        counts, removed, spans, digests, rest = [], [], [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks")):
            raw = (text or "").encode("utf-8", "surrogatepass")
            change = np.zeros(len(raw) + 1, np.int64)
            if marks.is_valid and len(marks.values):
                low, high = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                np.add.at(change, np.minimum(low, len(raw)), 1)
                np.add.at(change, np.minimum(high, len(raw)), -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            counts.append(len(raw))
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            rest.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digests, pa.string()), pa.array(rest, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _marked(docs: DataFrame, id_col: str, text_col: str, length: int, options: dict) -> tuple[list, DataFrame]:
    """What a row is known by, 96 bits of hash of its id and text, and the marks of each such row.

    Rows that agree in both are cut alike, so they may share their marks.
    """
    text = F.col(text_col).cast("string")
    key = [F.xxhash64(F.col(id_col), text).alias("__row"), F.hash(text, F.col(id_col)).alias("__twin")]
    source = docs.select(key[0].alias("doc_id"), key[1].alias("twin"), text.alias("text"))
    marks = repeated_spans(source, length, **options).groupBy("doc_id", "twin").agg(F.collect_set(F.struct("low", "high")).alias("__marks"))
    return key, marks.withColumnsRenamed({"doc_id": "__row", "twin": "__twin"})


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                          **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining UTF-8 bytes) for every row.

    Each byte goes that is covered by a ``length``-byte string which also starts anywhere else, in another document or
    the same one; strings are judged on the input.  A null text is empty.  Rows that repeat an id, or have none, are different
    documents.  Other columns are not read.
    """
    key, marks = _marked(docs, id_col, text_col, length, options)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key)
    return source.join(marks, ["__row", "__twin"], "left").select("doc_id", "text", F.col("__marks").alias("marks")).mapInArrow(
        lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated strings cut out of the text; other columns stay.

    Bytes of a character that was cut through go with it.
    """
    key, marks = _marked(docs, id_col, text_col, length, options)

    @F.arrow_udf("string")
    def rest(text: pa.Array, cuts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, text, cuts], ["doc_id", "text", "marks"])
        parts = [pa.array([k.decode("utf-8", "ignore") for k in found.column("kept").to_pylist()], pa.string()) for found in _cut([batch])]
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    rest = rest.asNondeterministic()  # or a filter on the text would cut every text again
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(*key, row).join(marks, ["__row", "__twin"], "left")
    text = F.when(F.col("__marks").isNull(), F.col(f"row.`{text_col}`")).otherwise(rest(F.col(f"row.`{text_col}`").cast("string"), F.col("__marks")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

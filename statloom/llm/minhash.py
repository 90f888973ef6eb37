"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate links, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm import tokens
from statloom.llm.graph import components
from statloom.llm.store import keep, lean, settled

SHINGLE = 5
BANDS, ROWS = 40, 4  # a pair at 0.75 is missed with probability (1 - 0.75**4)**40 = 3e-7
LEAST = 75  # per cent


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and the row limits.  A shorter row is one shingle."""
    words, _, _, limits = tokens.word_hashes(data, offsets, lower=True)
    counts = np.diff(limits)
    short = np.flatnonzero((counts > 0) & (counts < size))
    hashes = np.zeros(len(words), np.uint64)
    used = np.zeros(len(words), bool)
    if len(words) >= size:
        fits = tokens.window_starts(limits, size)[:len(words) - size + 1]
        hashes[:len(fits)] = tokens.sequence_hashes(words, size)
        used[:len(fits)] = fits
    if len(short):
        hashes[limits[short]] = tokens.range_hashes(words, limits[short], limits[short + 1], tokens.WORD_BASE)
        used[limits[short]] = True
    ends = np.concatenate(([0], np.cumsum(used)))[limits]
    hashes = hashes[used]
    for a, b in zip(ends[:-1], ends[1:]):
        hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[ends[:-1][np.diff(ends) > 0]] = True
    return hashes[first], np.concatenate(([0], np.cumsum(first)))[ends]


def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which an empty one looks at the others; the same for every document."""
    rng = np.random.default_rng(20170)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def _signatures(hashes: np.ndarray, limits: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One hash function, ``bins`` ranges of its values: the smallest of each range, empty ranges densified.

    An empty bin copies the first non-empty one in its own random order, so the copies are as independent as the bins.
    """
    rows = len(limits) - 1
    out = np.zeros(rows * bins, np.uint64)
    full = np.zeros(rows * bins, bool)
    row = np.repeat(np.arange(rows), np.diff(limits))
    place = row * bins + ((hashes >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out[place[first]] = hashes[first]
    full[place[first]] = True
    some = np.repeat(np.diff(limits) > 0, bins)
    empty = np.flatnonzero(~full & some)
    for turn in range(bins):
        if not len(empty):
            break
        source = empty - empty % bins + probes[empty % bins, turn]
        got = full[source]
        out[empty[got]] = out[source[got]]
        empty = empty[~got]
    return out.reshape(rows, bins)


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[limits[1:]] - total[limits[:-1]]


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches):
        probes = _probes(bands * rows)
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(1))
            for a, b in tokens.slices(offsets):
                hashes, limits = _shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                signature = _signatures(hashes, limits, bands * rows, probes).reshape(b - a, bands, rows)
                key = np.full((b - a, bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    key = tokens.mix(key * np.uint64(tokens.BASE) + signature[:, :, r])
                keys = pa.ListArray.from_arrays(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32), key.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(limits).astype(np.int64)),
                     pa.array(_sums(hashes, limits).view(np.int64)),
                     pa.array(_sums(tokens.mix(hashes ^ np.uint64(tokens.WORD_BASE)), limits).view(np.int64)), keys],
                    ["doc_id", "n_shingles", "print_a", "print_b", "bands"])
    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(1))
            for a, b in tokens.slices(offsets):
                hashes, limits = _shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(limits.astype(np.int32), hashes.view(np.int64))],
                    ["id", "shingles"])
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    both = F.size("set_a") + F.size("set_b")
    return pairs.join(right, "b").join(left, "a").filter(100 * common >= least * (both - common)).select("a", "b")


def _pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _prefix_pairs(open_ids: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs of documents in different parts that may be similar enough: none that is, is missing.

    With shingles ordered from rare to frequent, similar sets share one among their first, and the first they share leaves
    room for the whole common part behind it.  What makes a document differ from its neighbours is rare and comes first,
    so documents of one large group that are just too different meet in few shingles.  One side of each pair stands
    ``apart`` from the centre of its star.
    """
    tokens_ = sets.join(open_ids.select("id"), "id").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = keep(tokens_.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    rare_first = Window.partitionBy("id").orderBy("df", "s")
    ranked = tokens_.join(counts, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", F.row_number().over(rare_first))
    prefix = ranked.filter((F.col("df") > 1) & (100 * (F.col("n") - F.col("at") + 1) >= least * F.col("n")))
    prefix = keep(prefix.join(open_ids, "id").select("id", "n", "s", "part", "apart", (F.col("n") - F.col("at") + 1).alias("room")), "prefix")
    left = prefix.filter("apart").select(*[F.col(c).alias(f"{c}_") for c in ("id", "n", "s", "part", "room")])
    fits = (100 + least) * F.least("room", "room_") >= least * (F.col("n") + F.col("n_"))
    return _pairs(left.join(prefix, (F.col("s_") == F.col("s")) & (F.col("part_") != F.col("part")) & fits), "id_", "id")


@settled
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document id.

    Words are runs of non-space characters with A-Z lowered; a document's set holds its distinct ``shingle``-word runs, or
    the whole sequence if it has fewer words.  Documents are linked if the sets share ``least`` per cent of their union.

    1. Documents with equal sets fall together by a 128-bit sum of their hashes; the smallest id stands for them.
    2. Signatures of these are cut into bands; a bucket holds the documents that agree in a band.
    3. Shingles that no other candidate has bound what a document can share with any.  Members and pairs that cannot
       reach the threshold for that reason are left out, exactly.
    4. Each bucket emits a star: a centre, the member that shares most, with every other member; links are confirmed on
       the full sets.  Members whose bucket still holds another component, which they could belong to, are
       compared with those that share one of their rarest shingles, which misses no link.  So links are as complete as
       the buckets, and a group of copies costs about one comparison a member.

    Texts that are null or without words have an empty set and no links.  Rows that repeat an id are one document with
    the links of all of them; the largest set size is reported.  A null id has no links and is kept.  Other columns are
    not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = keep(source.mapInArrow(lean(_sketch(shingle, bands, rows)),
                                    "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"), "sketch")
    plain = sketch.drop("bands")
    prints = ["print_a", "print_b", "n_shingles"]
    classes = keep(plain.filter("n_shingles > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("id")), "classes")
    chosen = classes.select("id", F.col("n_shingles").alias("n"))
    buckets = (sketch.withColumnRenamed("doc_id", "id").join(chosen.select("id").distinct(), "id", "left_semi")
               .select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("bucket")
    members = keep(buckets.join(shared, "bucket").distinct(), "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = keep(source.join(wanted, "doc_id").mapInArrow(lean(_sets(shingle)), "id long, shingles array<long>"), "sets")

    # shingles that no other candidate has can be in no common part: the rest bounds what a document can share
    owned = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("high"))
    alone = owned.filter("id = high").groupBy("id").agg(F.count("*").alias("alone"))
    members = keep(members.join(alone, "id", "left").select(
        "bucket", "id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m")), "bounded")
    may = lambda m, n: (100 + least) * m >= least * n  # noqa: E731  m shared of n in both sets together

    # stars: every member against the one that shares most
    best = F.max(F.struct(F.round(F.col("m") / F.col("n"), 3).alias("shares"), (-F.col("id")).alias("back"), "n", "m")).alias("c")
    centres = keep(members.groupBy("bucket").agg(best, F.min("n").alias("shortest")).select(
        "bucket", (-F.col("c.back")).alias("centre"), F.col("c.n").alias("cn"), F.col("c.m").alias("cm"), "shortest"), "centres")
    star = members.join(centres, "bucket")
    pairs = star.filter((F.col("id") != F.col("centre")) & may(F.least("m", "cm"), F.col("n") + F.col("cn")))
    links = keep(_confirmed(_pairs(pairs, "id", "centre"), sets, least).distinct(), "stars")
    labels = components(links)

    # the rest: members whose bucket holds another component that they could still belong to
    part = labels.select(F.col("node").alias("id"), F.col("label").alias("part"))
    heads = part.select(F.col("id").alias("centre"), F.col("part").alias("cpart"))
    able = star.filter(may(F.col("m"), F.col("n") + F.col("shortest"))).join(part, "id", "left").join(heads, "centre", "left")
    able = able.select("bucket", "id", "n", F.coalesce("part", "id").alias("part"), F.coalesce("cpart", "centre").alias("cpart"))
    spread = able.groupBy("bucket").agg(F.min(F.least("part", "cpart")).alias("low"), F.max(F.greatest("part", "cpart")).alias("high")).filter("low != high")
    open_ids = keep(able.join(spread.select("bucket"), "bucket").groupBy("id").agg(
        F.first("part").alias("part"), F.max(F.col("part") != F.col("cpart")).alias("apart")), "open")
    if not open_ids.isEmpty():
        more = keep(_confirmed(_prefix_pairs(open_ids, sets, least), sets, least).distinct(), "rest")
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    found = plain.join(classes, prints, "left").withColumn(
        "id", F.when(F.col("doc_id").isNotNull(), F.col("id"))).join(labels.withColumnRenamed("node", "id"), "id", "left")
    out = found.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"),
                                      F.min(F.coalesce("label", "id", "doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

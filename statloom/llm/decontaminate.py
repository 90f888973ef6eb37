"""Benchmark items inside documents, up to an edit budget: exact pieces find places, Myers' bit vectors verify them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.06  # edits allowed for each character of an item
BLOCK = 4_000_000  # characters of items that one automaton holds
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normalise(text: str | None) -> str:
    """Lower case, each run of white space as one space, trimmed."""
    return _SPACE.sub(" ", (text or "").lower()).strip(" ")


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate + 1e-9)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` adjoining pieces with their offsets: whatever the edits, one piece stays whole."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def best_match(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``item`` to any substring of ``text`` and that substring's end, if within ``limit``.

    Myers' algorithm: one column of the distance table is two bit vectors, here integers of len(item) bits.
    """
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    match: dict[str, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | (1 << i)
    up, down, score, best = full, 0, len(item), None
    if score <= limit:
        best = (score, 0)
    for j, c in enumerate(text):
        eq = match.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        vertical = eq | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Finder:
    """An automaton over the pieces of all items; made once a task."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick
        self.items = [(key, text, budget(len(text), rate)) for key, text in items]
        places: dict[str, list] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, raw: str | None) -> list[dict]:
        text, starts = normalise(raw), {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            key, item, edits = self.items[n]
            best, low, last = None, None, None
            for at in [*sorted(found), None]:
                if low is not None and (at is None or at - last > 2 * edits + 1):
                    a = max(0, low - edits)
                    got = best_match(item, text[a:last + len(item) + edits], edits)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], a + got[1])
                    low = None
                if at is not None:
                    low, last = (at if low is None else low), at
            if best:
                distance, end = best
                back = best_match(item[::-1], text[max(0, end - len(item) - edits):end][::-1], distance)
                out.append({"item_id": key, "distance": distance, "match_start": end - back[1], "match_end": end})
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"] or 0))


HITS = "array<struct<item_id:bigint,distance:int,match_start:bigint,match_end:bigint>>"


def hits_column(benchmark: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text",
                rate: float = RATE, block: int = BLOCK) -> Column:
    """All benchmark items found in ``text``, as an array.

    Items go to the tasks in blocks of about ``block`` characters, whatever the benchmark's size; each block is one
    automaton and one column expression over the same scan.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    n_blocks = -(-total // block) or 1
    parts = []
    for b in range(n_blocks):
        one = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b)
        items = sorted({(r["item_id"], normalise(r["text"])) for r in one.toLocalIterator()} , key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        items = [x for x in items if x[1]]
        if items:
            parts.append(_column(benchmark.sparkSession, items, rate)(text))
    return F.concat(*parts) if parts else F.lit(None).cast(HITS)


def _column(spark, items: list, rate: float):
    shared = spark.sparkContext.broadcast(items)
    state: dict = {}

    @F.pandas_udf(HITS)
    def find(text: pd.Series) -> pd.Series:
        if "finder" not in state:
            state["finder"] = Finder(shared.value, rate)
        return pd.Series([state["finder"].hits(t) for t in text], dtype=object)

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
                 block: int = BLOCK) -> DataFrame:
    """One row for each (document, item) whose text holds the item within ``rate`` edits a character.

    doc_id, item_id, distance (smallest), match_start and match_end (its place in the normalised document text).  Both
    sides are compared in lower case with white space folded.  An item with budget k is split into k + 1 pieces; a match
    with k edits leaves a piece whole, so the automaton misses none.  Null or empty texts and items match nothing; rows
    that repeat an id each give their rows, repeated items too; ids may be null; other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), hits_column(benchmark, F.col(text_col).cast("string"), rate=rate, block=block).alias("hits"))
    return found.select("doc_id", F.inline("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    hits = hits_column(benchmark, F.col(f"`{text_col}`").cast("string"), rate=rate)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.coalesce(F.size(hits), F.lit(0)).alias("n")).filter("n <= 0").select("row.*")

"""Near copies, repeated strings and repeated windows against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("statloom.llm")

from statloom.llm import suffix, tokens, windows
from statloom.llm.graph import components
from statloom.llm.minhash import near_duplicates
from statloom.llm.substrings import cut_documents, drop_repeated_strings
from statloom.llm.windows import drop_repeated_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0, schema=SCHEMA):
    rows = [(i + first, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words_of(text, lower):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    w = words_of(text, True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(texts):
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return sets, low


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "One", "a b c", "A  b\tc", prose(rng, 3000)]
    for _ in range(6):
        base = prose(rng, rng.choice([8, 30, 150]), 5000).split(" ")
        texts += [" ".join(base)] * 2
        for share in (0.01, 0.03, 0.05, 0.08, 0.2):
            texts.append(" ".join(f"x{rng.random()}" if rng.random() < share else w for w in base))
    sets, low = linked(texts)
    got = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == low
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_group_of_mutations_keeps_every_link(spark):
    """Copies of copies: some are too far from the centre, and linked only through others."""
    rng = random.Random(9)
    base = prose(rng, 120, 100_000).split(" ")
    texts = [base]
    for _ in range(120):
        parent = rng.choice(texts[-12:])
        texts.append([f"m{rng.random()}" if rng.random() < 0.02 else w for w in parent])
    texts = [" ".join(t) for t in texts]
    _, low = linked(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == low


def test_near_duplicates_null_and_repeated_ids_extra_columns_empty(spark):
    schema = "doc_id long, text string, n long, kept string, bucket string"
    long = "a b c d e f g h i j"
    rows = [(None, long, 1, "x", "y"), (3, long, 1, "x", "y"), (3, long, 1, "x", "y"), (7, long, None, None, None)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(None, 6, None, True), (3, 6, 3, True), (7, 6, 3, False)]
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(50, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 109)}}


@pytest.mark.parametrize("memory", [0, 500, 1 << 20])
def test_suffix_arrays_mark_repeats_from_disk_and_memory(memory):
    rng = random.Random(memory)
    for turn in range(120):
        length = rng.choice([1, 2, 3, 5, 40])
        letters = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        if turn % 3 == 0:
            texts = [t[:9] + b"=" * rng.randint(0, 450) + t[9:] for t in texts]
        count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if count[t[i:i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix.repeated_starts(texts, length, memory=memory)] == want if texts else True


def strings_by_hand(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 70, 5000) + " é", prose(rng, 45, 5000), "=" * 320]
    texts = [None, "", "x" * 199, "ab" * 300, shared[0], prose(rng, 4000, 9000)]
    for _ in range(25):
        texts.append(" ".join([prose(rng, rng.randint(0, 60), 9000), rng.choice(shared), prose(rng, rng.randint(0, 60), 9000)]))
    return texts + texts[-3:]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeated_strings_match_brute_force(spark, crowd):
    """With a crowd limit of 1 every mixed anchor goes the way of the very common passages."""
    texts = passages(2)
    got = {r.doc_id: tuple(r)[1:] for r in drop_repeated_strings(table(spark, texts), crowd=crowd, shard_bytes=5000).collect()}
    assert [got[i] for i in range(len(texts))] == strings_by_hand(texts)


def test_cut_documents_keeps_columns_and_whole_characters(spark):
    shared = "".join(chr(0x100 + i) for i in range(150))  # two bytes each
    rows = [(1, "a" + shared, "x", 5), (2, "b" + shared[:120] + "c", "y", 6), (None, None, None, None), (4, "only here", "z", 7)]
    got = cut_documents(spark.createDataFrame(rows, "doc_id long, text string, marks string, low int")).collect()
    assert {(r.doc_id, r.text, r.marks, r.low) for r in got} == {(1, "a" + shared[120:], "x", 5), (2, "bc", "y", 6), (None, None, None, None), (4, "only here", "z", 7)}
    assert drop_repeated_strings(spark.createDataFrame([], SCHEMA)).collect() == []


def windows_by_hand(texts, size=20):
    seen, out = set(), []
    words = [words_of(t, False) for t in texts]
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if key in seen:
                gone[i:i + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("cells", [None, windows.SHARD])
def test_repeated_windows_match_brute_force(spark, cells, monkeypatch):
    rng = random.Random(6)
    texts = passages(5) + [" ".join(["same"] * 90), " ".join(["no space"] * 30), prose(rng, 25) * 2]
    got = {r.doc_id: tuple(r)[1:] for r in drop_repeated_windows(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == windows_by_hand(texts)


def test_a_full_sketch_loses_no_window(spark, monkeypatch):
    """With hardly any cells nearly every window passes the sketch, and the result is the same."""
    monkeypatch.setattr(windows, "SHARD", 64)
    monkeypatch.setattr(windows, "LARGEST", 64)
    texts = passages(8)
    got = {r.doc_id: tuple(r)[1:] for r in drop_repeated_windows(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == windows_by_hand(texts)


def test_repeated_windows_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(25)))
    rows = [(None, text), (2, text), (2, text), (5, text + " more"), (6, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", 25, 0), ("2", 25, 0), ("5", 26, 25), ("6", 0, 0), ("None", 25, 25)]
    assert drop_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_follow_the_words():
    import pyarrow as pa
    texts = ["Hello  world a\tb", None, "", " x", "é È hello", "Hello world", "z" * 3_000_000 + " end"]
    data, offsets = tokens.text_buffer(pa.array(texts))
    hashes, starts, ends, limits = tokens.word_hashes(data, offsets, True)
    words = [w for t in texts for w in words_of(t, True)]
    assert [bytes(data[a:b]).decode().lower().replace("È".lower(), "È") for a, b in zip(starts[:5], ends[:5])] == ["hello", "world", "a", "b", "x"]
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        by_word.setdefault(w, set()).add(h)
    assert len(words) == len(hashes) and all(len(h) == 1 for h in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    values = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    assert all(p == i + np.argmin(values[i:i + 37]) for i, p in enumerate(tokens.minimisers(values, 37)))


def with_odd_ids(texts, seed):
    """Texts under ids of which many are null or repeated, also with equal texts."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, None, 3, 5, i + 10]), t) for i, t in enumerate(texts)]
    return rows + [(None, texts[6]), (None, texts[6]), (3, texts[7]), (3, texts[7]), (5, "unrelated " + prose(rng, 80, 10**6)),
                   (None, "unrelated " + prose(rng, 80, 10**6)), (None, None), (None, "")]


def test_strings_of_rows_with_null_and_repeated_ids(spark):
    rows = with_odd_ids(passages(9), 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in drop_repeated_strings(docs, shard_bytes=5000).collect()), key=str)
    want = strings_by_hand([t for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    cut = sorted((str(r.doc_id), r.text or "") for r in cut_documents(docs).collect())
    assert cut == sorted((str(i), w[4].decode("utf-8", "ignore")) for (i, _), w in zip(rows, want))


def test_windows_of_rows_with_null_and_repeated_ids(spark):
    rows = with_odd_ids(passages(10), 2)
    got = sorted((tuple(r) for r in drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    place = lambda i: 2**63 if i is None else i
    first: dict = {}
    for i, t in rows:
        w = words_of(t, False)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            first[key] = min(first.get(key, 2**64), place(i))
    want = []
    for i, t in rows:
        w, seen = words_of(t, False), set()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen or first[key] < place(i):
                gone[k:k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == sorted(want, key=str)

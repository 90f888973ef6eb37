"""Periodic runs, packing and hard negatives against direct computation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("statloom.llm")

from pyspark.sql import functions as F

from statloom.llm import negatives as neg
from statloom.llm.negatives import hard_negatives
from statloom.llm.packing import Packer, pack_documents
from statloom.llm.periodic import Extensions, RangeMinimum, find_runs, periodic_runs, run_digests, with_planted_tails

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and i > s:
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_find_runs_is_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        rows = []
        for _ in range(rng.randrange(1, 9)):
            row = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.choice([0, 1, 5, 6, 7, 24, 80, 300]))]
            if len(row) > 9 and rng.random() < 0.6:
                a = rng.randrange(len(row))
                p = 1 + (len(row) - a) // rng.randrange(3, 11)
                row = [row[i] if i < a else row[a + (i - a) % p] for i in range(len(row))]
            rows.append(row)
        limits = np.cumsum([0] + [len(r) for r in rows])
        found = find_runs(np.array([x for r in rows for x in r], np.int64), limits)
        assert list(zip(*(x.tolist() for x in found))) == [(i, *r) for i, row in enumerate(rows) for r in brute_runs(row)]


def test_extensions_and_range_minimum():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1000, 5000)
    low = rng.integers(0, 4999, 3000)
    high = low + 1 + rng.integers(0, 5000, 3000) % (5000 - low)
    assert RangeMinimum(values)(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high)]
    for alphabet in (1, 2, 50):
        words = np.append(rng.integers(0, alphabet, 700), 1000)
        a, b = rng.integers(0, 701, 500), rng.integers(0, 701, 500)
        a, b = a[a != b], b[a != b]
        want = [next(t for t in range(702) if max(x, y) + t > 700 or words[x + t] != words[y + t]) for x, y in zip(a, b)]
        assert Extensions(words)(a, b).tolist() == want


def test_periodic_runs_of_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a b " * 9, "x " * 3000, " é é  é é é é é é", "a  a\na\ta a\x0ba \x0ca", "ab ab ab ab ab aba"]
    for _ in range(40):
        texts.append(" ".join(rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randrange(9)}" for _ in range(rng.randrange(400))))
    rows = [(None if i % 9 == 4 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int").repartition(3)
    for plant in (False, True):
        made = with_planted_tails(docs) if plant else docs
        got = sorted((tuple(r) for r in run_digests(periodic_runs(made)).collect()), key=str)
        want = []
        for doc_id, text, *_ in rows:
            w = WORD.findall(text or "")
            if plant and doc_id is not None:
                w = planted(doc_id, w)
            runs = brute_runs(w)
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            want.append((doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(),
                         hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    empty = run_digests(periodic_runs(docs.limit(0)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def vocabulary():
    places = pytest.importorskip("public_tokenizers")
    return places.path("word_bpe_49k.json")


def check_pieces(pieces, want, capacity=4096):
    """Pieces rebuild every document; sequences have no gap and are full or a power of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        docs[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], len(ids)))
    assert set(docs) == set(want)
    for name, parts in docs.items():
        ids = [i for _, part, _ in sorted(parts) for i in part]
        assert ids == want[name] and {n for *_, n in parts} == {len(ids)}
        assert [s for s, *_ in sorted(parts)] == np.cumsum([0] + [len(p) for _, p, _ in sorted(parts)])[:-1].tolist()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_is_the_tokenizer_on_whole_texts(spark):
    from tokenizers import Tokenizer
    path, rng = vocabulary(), random.Random(8)
    plain = Tokenizer.from_file(path)
    odd = ["", "I'll don't 's", "ΟΔΟΣ ΑΣ Σ", "é ́x  y z\u0085w", "<|endoftext|>a b<|startoftext|> <|end oftext|>", "１２ ab12cd", "가 ᆨ",
           "日本語 テキスト", "\x1c\x1d a\x00b", "naïve CAFÉ İstanbul ǅ", "🙂🙂 👨‍👩‍👧"]
    texts = [None, *odd, "abc" * 4000, "word " * 5000]
    for _ in range(150):
        texts.append(rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice(odd + ["plain", "Words", "of", "text"]) for _ in range(rng.randrange(900))))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    check_pieces(pack_documents(docs, path).collect(), want)
    assert pack_documents(docs.limit(0), path).count() == 0
    repeated = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a b"), (3, "a b")], "doc_id long, text string").coalesce(1)
    pieces = pack_documents(repeated, path).collect()
    assert sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0) == [("3", 3), ("3", 3), ("None", 2), ("None", 2)]


def test_packer_fills_classes_with_fixed_counts():
    rng = random.Random(1)
    packer, want = Packer(4096, 8), {}
    for doc in range(3000):
        want[doc] = [doc] * rng.choice([1, rng.randrange(1, 60), rng.randrange(1, 900), rng.randrange(1, 5000), 1365, 4096, 9000])
        packer.add(doc, np.array(want[doc], np.uint32))
    packer.finish()
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces = [dict(zip(names, row)) for row in packer.done]
    check_pieces([p | {"length": len(p["ids"]), "ids": p["ids"].astype("<u4").tobytes()} for p in pieces], want)
    assert len({p["sequence_id"] for p in pieces}) <= -(-sum(map(len, want.values())) // 4096) + 12
    whole = sum(len(p["ids"]) == min(p["doc_tokens"], 4096) or p["start"] >= 4096 for p in pieces if p["start"] % 4096 == 0)
    assert whole > 0.6 * len(want)


def brute_negatives(rows, anchor, positives=5, negatives=10):
    usable = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows
              if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(usable):
        if not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, other, w) in enumerate(usable) if m != n]
        best = sorted((r for r in scored if r[2] == label), key=order)[:positives]
        for p in best:
            fit = sorted((r for r in scored if r[2] != label and 30 * p[0] <= 100 * r[0] <= 90 * p[0]), key=order)[:negatives]
            out += [(i, p[1], k + 1, r[1], p[0], r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        vector = [float(x) for x in rng.normal(0.1, 0.2, 6).astype(np.float32)]
        if i % 5 == 0:
            vector = [0.25, 0.5, 0.0, 0.125, 0.25, 0.5]  # ties
        rows.append((i if i % 11 else None, int(rng.integers(0, 4)), vector))
    rows += [(500, None, [1.0] * 6), (501, 1, None), (502, 1, [float("nan")] + [1.0] * 5), (503, 1, [None] + [1.0] * 5),
             (504, 1, [float("inf")] + [1.0] * 5), (600, 2, [0.0] * 6), (610, 2, []), (620, 2, [0.5, 0.5]), (20, 1, rows[20][2]), (20, 1, rows[20][2])]
    schema = "vec_id long, label int, embedding array<double>, rank string, anchor string"
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5)
    anchors = F.col("vec_id") % 20 == 0
    want = brute_negatives(rows, lambda i: i is not None and i % 20 == 0)
    assert len(want) > 200
    for block, size in ((4096, 2048), (7, 33)):
        monkeypatch.setattr(neg, "ROWS", size)
        got = hard_negatives(table, anchors, block=block).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert hard_negatives(table.limit(0), anchors).count() == 0


def test_scores_are_exact_at_any_size():
    a = np.array([[2.0**40, 1.0, -3.0]])
    b = np.array([[2.0**20, 1.0, 5.0], [2.0**60, 0.0, 0.0]])
    assert neg._scores(a, b).tolist() == [[2**60 - 14, neg.LIMIT]]
    assert neg.window(-10, 30, 90)[0] > neg.window(-10, 30, 90)[1] and neg.window(0, 30, 90) == (0, 0) and neg.window(101, 30, 90) == (31, 90)

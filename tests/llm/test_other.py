"""Mixing, nearest neighbours, the registered queries and the pipeline."""

import numpy as np
import pytest

pytest.importorskip("statloom.llm")

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from statloom.llm import queries
from statloom.llm.decontaminate import contaminated
from statloom.llm.minhash import near_duplicates
from statloom.llm import mixing
from statloom.llm.mixing import mix_sources
from statloom.llm.neighbours import nearest_neighbours

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_sql(spark, key):
    from check_queries import compare, connect
    assert compare(queries.QUERIES[key](spark, FOLDER), connect(FOLDER), queries.ORACLES[key]) == ""


def test_all_operators_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_every_source_stays_within_a_block_of_its_weight(spark):
    rows = [(i, s, "x" * 10) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, parts=100, block=10).orderBy("mix_slot").collect()
    assert len(got) == 1000 and len({r.mix_slot for r in got}) == 1000
    weight, seen = {"a": 0.5, "b": 0.3, "c": 0.2}, dict.fromkeys("abc", 0)
    for r in got[:500]:  # c runs out after 500 slots
        seen[r.source] += 1
        assert all(abs(seen[s] - w * (r.mix_slot + 1)) < 1 for s, w in weight.items())


def test_given_weights_are_kept_and_zero_stays_zero(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "x" * 10) for i in range(90)], "doc_id long, source string, text string")
    got = mix_sources(docs, {"a": 1.0, "c": 0.0}, block=10).collect()
    assert sorted(r.mix_slot for r in got if r.source == "a") == list(range(30))
    assert len(got) == 90 and all(r.mix_slot is None for r in got if r.source != "a")
    rare = {r.mix_block: r.mix_slot for r in mix_sources(docs, {"a": 0.0006, "b": 0.9994}, block=10).collect() if r.source == "a"}
    assert all(rare[k] // 5000 == k // 3 for k in rare) and rare[3] - rare[0] == 5000  # 3 of 5000 slots
    assert mixing._whole({"a": 0.123456789, "b": 0.876543211}, 1000)[1] is False and mixing._whole({}, 1000) == ({}, True)


def test_many_sources_are_mixed(spark):
    docs = spark.createDataFrame([(i, f"s{i:04d}", "x" * 50) for i in range(400)], "doc_id long, source string, text string")
    slots = sorted(r.mix_slot for r in mix_sources(docs, block=10).collect())
    assert len(set(slots)) == 400


def test_mixing_edge_cases(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (None, "a", "", 6), (2, "a", "long" * 100, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    got = mix_sources(docs, block=50).collect()
    assert len(got) == 4 and docs.columns[:3] == got[0].__fields__[:3]
    assert sorted(r.mix_block for r in got) == [0, 0, 0, 8]  # md5 puts the long text before the empty one
    assert mix_sources(docs.limit(0)).collect() == []
    assert len(mix_sources(docs, {}).collect()) == len(mix_sources(docs, {"a": 1.0}).collect()) == 4


def nearest_by_hand(ids, vectors, q, k=10):
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0, fewest=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        answers = sorted(got[ids[q]])
        assert [a[0] for a in answers] == list(range(1, 11))
        assert [a[1:] for a in answers] == sorted([a[1:] for a in answers], key=lambda a: (a[1], a[0]))
        hits += len({a[1] for a in answers} & {i for i, _ in nearest_by_hand(ids, vectors, q)})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [0.0, 2.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (9, [1.0]), (10, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.414214), (0, 4, 8, 2.236068),
                           (100, 1, 8, 1.0), (100, 2, 0, 1.414214), (100, 3, 1, 1.414214), (100, 4, 2, 1.414214)]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(900001, "123 456", "en", "src1", 7), (900002, None, None, None, None), (None, "the of and " * 9, "en", None, 9)], docs.schema)
    docs, before = docs.unionByName(odd), None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.keep(stage(spark, docs, FOLDER), "test")
        ids, had = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
        assert ids <= had and docs.count() <= before.count()
        assert docs.columns[:5] == columns and (name == "mix" or docs.columns == columns)
        if name == "language":
            assert had - ids == {900001, 900002}
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in near_duplicates(before).filter("kept").collect()}
        elif name == "benchmark":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert had - ids == {r.doc_id for r in contaminated(before, bench).collect()}
        elif name == "mix":
            assert ids == had


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), "empty")
    assert docs.collect() == []

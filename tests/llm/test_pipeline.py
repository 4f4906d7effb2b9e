"""The pipeline's stages take effect and lose nothing else; the SQL twins agree."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_components, brute_fingerprint, prose
from tracecairn.llm import pfair, quality, queries, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for name_of in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name_of} AS SELECT * FROM '{SMALL}/{name_of}.parquet'")
    got = queries.all_queries()[name](spark, SMALL)
    want = db.sql(queries.all_sql()[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    at = [want.columns.index(c) for c in names]
    assert sorted(rows) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_stages_one_after_the_other(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, left = documents, {r["doc_id"] for r in documents.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= left
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert out.columns == documents.columns
        if name == "toxicity":
            model = toxicity.train(documents, spark.read.parquet(f"{SMALL}/labels.parquet"))
            gone = toxicity.score(docs, model).where("predicted = 1")
            assert set(before) - set(ids) == {r["doc_id"] for r in gone.collect()}
        elif name == "quality rules":
            kept = quality.judge(docs).where("kept")
            assert set(ids) == {r["doc_id"] for r in kept.collect()}
        elif name.startswith("SimHash"):
            order = sorted(before)
            roots = brute_components([brute_fingerprint(before[i]) for i in order])
            assert set(ids) == {order[r] for r in roots}
        elif name.startswith("mixing"):
            places = {r["doc_id"]: r["mix_position"] for r in pfair.interleave(
                docs, queries.MIX, queries.MIX_BLOCK, queries.MIX_SEED).collect()}
            assert set(ids) == left and ids == sorted(ids, key=places.get)
        else:
            assert set(ids) == left
            assert {r["doc_id"]: r["mix_position"] for r in out.collect()} == places
        left = set(ids)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_empty_and_odd_tables(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = documents.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(
        documents.limit(2).withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string")))
    odd = odd.unionByName(documents.limit(4).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        documents.limit(6).withColumn("doc_id", F.lit(7).cast("long")))
    for docs in (documents.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).collect()


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(300)]
    hot = [(7, t, "a", "s", k) for k, t in enumerate(texts[:100])]   # one id, unrelated texts
    rest = [(k, t, "a", "s", 0) for k, t in enumerate(texts[100:], 1000)]
    none = [(None, prose(rng, 40), "a", "s", 0), (None, prose(rng, 40), "a", "s", 1)]
    copies = [(7, texts[0], "a", "s", 0), (2000, texts[150], "a", "s", 0), (None, texts[151], "a", "s", 0),
              (3, texts[5], "a", "s", 0), (None, none[0][1], "a", "s", 0)]
    near = [(5000, texts[200].replace(" ", "  ") + " ", "a", "s", 0)]
    rows = hot + rest + none + copies + near
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    by_print = {}
    for r in rows:
        by_print.setdefault(brute_fingerprint(r[1]), []).append(r)
    prints = list(by_print)
    roots = brute_components(prints)
    want = {}
    for k, r in enumerate(roots):
        want.setdefault(r, []).extend((x, prints[k]) for x in by_print[prints[k]])
    assert len(kept) == len(want) and len(want) >= 302
    for group in want.values():
        mine = [x for x in kept if x in {r for r, _ in group}]
        first = min((r[0] for r, _ in group if r[0] is not None), default=None)
        assert len(mine) == 1 and mine[0][0] == first

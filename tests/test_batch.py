"""Searches of whole query tables by chunks of reviews, against the joins and against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harrow.operators import batch, index, rank

WORDS = ["the", "the", "the", "lid", "lid", "kettle", "sturdy", "rare", "odd"]


def texts_of(many, seed=1):
    import random

    chance = random.Random(seed)
    return [(d, None if d % 50 == 0 else " ".join(["every", *chance.choices(WORDS[: 9 if d % 40 == 0 else 7], k=chance.randint(0, 9))])) for d in range(1, many + 1)]


QUERIES = {1: ["the", "Lid"], 2: ["kettle", "Kettle", "sturdy"], 3: ["zzz", "lid"], 4: ["the"], 5: ["rare", "odd", "the"], 6: ["every"], 7: ["zzz"], 8: ["lid", "the"], 9: ["every", "rare"], 10: [None, "odd"]}


@pytest.fixture(scope="module")
def tables(spark):
    reviews = spark.createDataFrame(texts_of(3000), "doc_id long, text string").repartition(3)
    query = spark.createDataFrame([(q, t) for q, terms in QUERIES.items() for t in terms], "query_id int, term string")
    return reviews, query, index.posting_rows(reviews).cache()


def test_vector_search_is_that_of_the_joins(tables):
    reviews, query, posted = tables
    weights = rank.query_ltc(query, index.dictionary(posted), F.lit(3000))
    want = rank.top_k(rank.vector_scores(weights, posted), 7)
    found = batch.vector_search(reviews, query, 7)
    assert found.schema == want.schema or [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    assert {(r.query_id, r.rank): (r.doc_id, round(r.score, 11)) for r in found.collect()} == {(r.query_id, r.rank): (r.doc_id, round(r.score, 11)) for r in want.collect()}


def test_reviews_come_in_chunks_and_bounds_leave_none_out(monkeypatch):
    """Any size of chunks, and tables cut by their cells, give the best of plain sums; equal scores go to the smaller id."""
    chance = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(12)]
    order = chance.permutation(900) * 7 + 1
    texts = {int(d): " ".join(chance.choice(terms, chance.integers(0, 12), p=np.arange(12, 0, -1) / 78)) for d in order}
    queries = [(q, [(int(c), float(chance.choice([0.0, 0.5, 1.0]))) for c in chance.choice(12, chance.integers(1, 4), replace=False)]) for q in range(40)]
    table = pa.table({"query_id": [q for q, own in queries for _ in own], "term": [terms[c] for _, own in queries for c, _ in own], "weight": [w for _, own in queries for _, w in own]})
    want = {}
    for q, own in queries:
        sums = {d: round(sum(w * (1 + np.log10(t.split().count(terms[c]))) for c, w in own if terms[c] in t.split()), 12) for d, t in texts.items() if {terms[c] for c, _ in own} & set(t.split())}
        want[q] = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:5]
    for chunk, sub, cells in [(64, 4, 10**6), (500, 16, 1000), (16_384, 16, 10**6)]:
        monkeypatch.setattr(batch, "CHUNK", chunk)
        monkeypatch.setattr(batch, "SUB", sub)
        monkeypatch.setattr(batch, "CELLS", cells)
        source = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
        packed = list(batch._pack((source.slice(i, 70) for i in range(0, 900, 70)), terms))
        rows = [b for b in batch._best(iter(packed), batch.Queries(table, terms), lambda code, tf, length: 1 + np.log10(tf), lambda base, sums: batch.rounded(sums, 12), 5)]
        asked = batch.Queries(table, terms).asked
        found = {q: [] for q, _ in queries}
        for r in (r for b in rows for r in b.to_pylist()):
            for q in asked[r["query_id"]]:
                found[q].append((r["doc_id"], r["score"]))
        assert {q: [(d, round(s, 10)) for d, s in own] for q, own in found.items()} == {q: [(d, round(s, 10)) for d, s in own] for q, own in want.items()}


def test_language_model_search_is_that_of_the_joins(tables):
    reviews, query, posted = tables
    total = posted.agg(F.sum("tf")).first()[0]
    scores = rank.language_model_scores(query, index.dictionary(posted.drop("num_tokens")), posted, None, F.lit(total), 0.4).withColumn("score", F.log10("score"))
    found = batch.language_model_search(reviews, query, 0.4, 7).collect()
    near = lambda rows: {(r.query_id, r.rank): (r.doc_id, r.score and round(r.score, 10)) for r in rows}
    assert near(found) == near(rank.top_k(scores, 7).collect()) and {r.score for r in found if r.query_id == 3} == {None}
    every = batch.language_model_logarithms(reviews, query, 0.4, 6).collect()
    assert {(r.query_id, r.doc_id): r.score for r in every} == {(r.query_id, r.doc_id): r.score and round(r.score, 6) for r in scores.collect()}
    assert len(every) == scores.count()


def test_empty_tables(spark):
    none, query = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "query_id int, term string")
    some = spark.createDataFrame([(1, "the lid")], "doc_id long, text string")
    for reviews, asked in [(none, query), (some, query.limit(0)), (some, query.withColumn("term", F.lit(None).cast("string")))]:
        assert batch.vector_search(reviews, asked, 3).collect() == []
        assert batch.language_model_search(reviews, asked, 0.4, 3).collect() == batch.language_model_logarithms(reviews, asked, 0.4, 6).collect() == []


def test_every_score_is_made_without_a_shuffle(spark, tables, tmp_path):
    reviews, query, posted = tables
    reviews.selectExpr("doc_id", "'p' product_id", "1 helpfulness_num", "1 helpfulness_den", "5 score", "text", "timestamp '2024-01-01' received_at").write.parquet(f"{tmp_path}/reviews.parquet")
    query.write.parquet(f"{tmp_path}/query_terms.parquet")
    df = entry.queries()["batch_language_model_scores"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    hits = posted.join(rank.query_counts(query), "term").select("query_id", "doc_id").distinct()
    assert df.select("query_id", "doc_id").exceptAll(hits).count() == 0 and df.count() == hits.count()


@pytest.mark.parametrize("name", ["batch_vector_search", "batch_language_model_search"])
def test_a_search_shuffles_no_hit(spark, tables, tmp_path, name):
    reviews, query, _ = tables
    full = reviews.selectExpr("doc_id", "'p' product_id", "1 helpfulness_num", "1 helpfulness_den", "5 score", "text", "timestamp '2024-01-01' received_at")
    full.write.parquet(f"{tmp_path}/reviews.parquet")
    query.write.parquet(f"{tmp_path}/query_terms.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "term" not in plan
    assert df.count() == 9 * 10  # no review has the term of one query


@pytest.mark.parametrize("asked_at_once", [200_000, 4])
def test_doc_lnn_is_that_of_the_joins(spark, tables, monkeypatch, asked_at_once):
    """Also with a query without id, repeated terms, and more queries than go out at once."""
    monkeypatch.setattr(batch, "ASKED", asked_at_once)
    reviews, query, posted = tables
    query = query.union(spark.createDataFrame([(None, "Lid"), (2, "kettle")], query.schema))
    want = rank.doc_lnn(query, posted).withColumn("weight", F.round("weight", 9))
    found = batch.doc_lnn(reviews, query, 9)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in want.schema]
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and found.count() == want.count() > 3000


def test_doc_lnn_of_empty_tables(spark):
    some, query = spark.createDataFrame([(1, "the lid"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "query_id int, term string")
    for reviews, asked in [(some.limit(0), query), (some, query.limit(0)), (some, query.withColumn("term", F.lit(None).cast("string"))), (some.where("doc_id = 2"), query)]:
        assert batch.doc_lnn(reviews, asked, 9).collect() == []


def test_doc_lnn_shuffles_no_posting_and_weighs_each_once(spark, tables, tmp_path):
    """Whatever the size of the query table: queries are broadcast, and no logarithm is taken of a hit."""
    reviews, query, posted = tables
    reviews.selectExpr("doc_id", "'p' product_id", "1 helpfulness_num", "1 helpfulness_den", "5 score", "text", "timestamp '2024-01-01' received_at").write.parquet(f"{tmp_path}/reviews.parquet")
    query.write.parquet(f"{tmp_path}/query_terms.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["batch_doc_lnn"](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "log10" not in plan.lower() and "hashpartitioning(term" not in plan
        assert df.count() == posted.join(rank.query_counts(query), "term").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

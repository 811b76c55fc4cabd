"""The saved index and what reads it; tables cut from their plans; changed deliveries."""

import json
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harrow.operators import encoding, index, lookup, rank, scenario, skew
from harrow.plans import build, durable
from harrow.sources.tables import canonical_reviews, of_last_delivery
from harrow.streaming import ingest

ROWS = [(1, "p1", 1, 2, 5, "The kettle leaks, the KETTLE hums"), (2, " P1 ", 0, 0, 3, "Sturdy kettle"), (3, "p2", 3, 1, 9, "a sturdy lid"), (4, None, 1, 1, None, None), (5, "p2", 0, 4, 1, ""), (70000, "p2", 0, 0, 5, "the lid of the kettle")]
EXTRA = ("term", "tf", "weight", "mark", "rank")


@pytest.fixture
def folder(make_reviews, tmp_path):
    make_reviews([*ROWS, ROWS[0]]).drop(*EXTRA).write.parquet(f"{tmp_path}/reviews.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def opened(spark, make_reviews, tmp_path_factory):
    return build.build_from_table(make_reviews([*ROWS, ROWS[0]]), str(tmp_path_factory.mktemp("index")))


def test_terms_have_their_numbers(opened):
    reader = lookup.IndexReader(opened)
    terms = [r.term for r in opened.dictionary.orderBy("term_index").collect()]
    assert terms == sorted(terms) and [reader.get_index_of_token(t) for t in terms] == list(range(len(terms)))
    at = terms.index("kettle")
    assert (reader.get_term(at), reader.get_token_frequency_at(at), reader.get_token_collection_frequency_at(at)) == ("kettle", 3, 4)
    assert [tuple(r) for r in reader.get_doc_ids_and_freqs(at).collect()] == [(1, 2), (2, 1), (70000, 1)]
    assert (reader.get_term(-1), reader.get_token_frequency_at(99), reader.get_token_collection_frequency_at(-5), reader.get_doc_ids_and_freqs(99).count()) == (None, 0, 0, 0)


def test_product_reviews_are_sought_between_the_products_ends(opened):
    reader = lookup.IndexReader(opened)
    found = reader.get_product_reviews(" p2 ")
    assert [r.doc_id for r in found.collect()] == [3, 5, 70000] and reader.get_product_reviews("none").count() == 0
    assert "GreaterThanOrEqual(doc_id,3)" in found._jdf.queryExecution().toString()


def test_lengths_lie_in_the_postings(opened):
    assert {(r.doc_id, r.num_tokens) for r in opened.postings.collect()} == {(1, 6), (2, 2), (3, 3), (70000, 5)}
    assert {r.doc_id: r.num_tokens for r in opened.reviews.collect()} == {1: 6, 2: 2, 3: 3, 4: 0, 5: 0, 70000: 5}


def test_faulty_postings_are_not_saved(opened, spark, tmp_path):
    bad = spark.createDataFrame([("x", 0, 1, 1)], "term string, doc_id long, tf long, num_tokens long")
    broken = index.ReviewIndex(opened.reviews, bad, opened.dictionary, opened.products, opened.stats)
    with pytest.raises(ValueError, match="no index may hold"):
        broken.save(str(tmp_path / "out"))


def test_an_index_is_built_once_until_its_files_change(spark, folder, make_reviews):
    first = build.review_index(spark, folder)
    assert build.review_index(spark, folder) is first
    time.sleep(0.01)
    make_reviews([*ROWS, (6, "p", 1, 1, 5, "brandnew")]).drop(*EXTRA).write.mode("overwrite").parquet(f"{folder}/reviews.parquet")
    second = build.review_index(spark, folder)
    assert second is not first and second.dictionary.where("term = 'brandnew'").count() == 1


def test_searches_read_the_index_and_push_their_terms(spark, folder):
    df = entry.queries()["vector_space_search"](spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "PushedFilters: [Or(" in plan.replace("In(term", "Or(In(term") and "reviews.parquet" not in plan
    found = {r.doc_id for r in df.collect()}
    assert found == {1, 2, 3, 70000}


def test_long_queries_are_joined(spark, opened, monkeypatch):
    query = rank.query_table(spark, ["the", "Kettle", "lid", "zzz", None])
    pushed = {tuple(r) for r in rank.of_query(opened.postings, query).collect()}
    assert {r[0] for r in pushed} == {"the", "kettle", "lid"}
    monkeypatch.setattr(rank, "PUSHED_TERMS", 1)
    assert rank.of_query(opened.postings, query).count() == opened.postings.count()
    assert rank.term_doc_frequencies(query, rank.of_query(opened.postings, query)).count() == len(pushed)
    assert rank.of_query(opened.postings, query.limit(0)).count() == 0


def test_bytes_are_latin_1(spark, tmp_path):
    text = "product/productId: b1\nreview/helpfulness: 1/2\nreview/score: 4.0\nreview/text: caf\u00e9 na\u00efve \u00a3\n\nproduct/productId: b2\nreview/text: \u00fcber\n"
    (tmp_path / "in.txt").write_bytes(text.encode("latin-1"))
    from harrow.sources import review_text

    parsed = review_text.parse_records(review_text.read_records(spark, str(tmp_path / "in.txt")))
    assert sorted(r.text for r in parsed.collect()) == ["caf\u00e9 na\u00efve \u00a3", "\u00fcber"]
    writer = build.IndexWriter(spark)
    writer.slow_write(str(tmp_path / "in.txt"), str(tmp_path / "out"))
    assert sorted(r.term for r in index.ReviewIndex.load(spark, str(tmp_path / "out")).dictionary.collect()) == ["ber", "caf", "na", "ve"]
    writer.remove_index(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_scenario_lists_tell_where_builds_differ(opened, tmp_path):
    found = {(r.kind, r.name, r.block): [tuple(e) for e in r.entries] for r in scenario.scenario_lists(opened.reviews, opened.postings).collect()}
    assert found["term", "kettle", 0] == [(1, 2), (2, 1)] and found["term", "kettle", 1] == [(70000, 1)] and found["product", "P2", 0] == [(3, 1), (5, 1)]
    scenario.write_scenario(opened.reviews, opened.postings, str(tmp_path))
    lines = [json.loads(x) for f in (tmp_path / "lists").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == len(found)


def test_lists_and_terms_come_back_from_bytes(spark, opened):
    posted = {(r.term, r.doc_id, r.tf) for r in opened.postings.collect()}
    encoded = encoding.encoded_postings(encoding.posting_gaps(opened.postings))
    assert {tuple(r) for r in encoding.decoded_postings(encoded).collect()} == posted and encoded.where("term = 'kettle'").count() == 2
    coded = encoding.front_coding(opened.dictionary)
    back = encoding.front_decoded(coded.select("term_index", "block_pos", "prefix_length", F.substr("term", F.col("prefix_length") + 1).alias("suffix")))
    assert {(r.term_index, r.term) for r in back.collect()} == {(r.term_index, r.term) for r in opened.dictionary.collect()}
    assert encoding.decoded_postings(encoding.encoded_postings(encoding.posting_gaps(opened.postings.limit(0)))).count() == 0


def test_a_changed_delivery_replaces_all_terms(spark, make_reviews, tmp_path):
    for block, rows in enumerate([[(1, "p", 1, 1, 5, "old old shared", 1), (2, "p", 1, 1, 5, "kept", 5), (3, "p", 1, 1, 5, "gone", 1)], [(1, "p", 1, 1, 5, "new shared", 2), (2, "p", 1, 1, 5, "late", 4), (3, "p", 1, 1, 5, "", 2)]]):
        ingest.write_block(make_reviews(rows), block, str(tmp_path))
    assert {tuple(r) for r in ingest.merged_blocks(spark, str(tmp_path)).collect()} == {("new", 1, 1), ("shared", 1, 1), ("kept", 2, 1)}


def test_findings_come_from_the_last_delivery(spark, make_reviews):
    reviews = make_reviews([(1, "p", 1, 1, 5, "a", 1), (1, "p", 1, 1, 5, "b", 2), (2, "p", 1, 1, 5, "a", 1), (2, "p", 1, 1, 5, "a", 1), (3, "p", 1, 1, 5, "a", 3)])
    found = reviews.where("text = 'a'").select("doc_id", "received_at", F.lit("x").alias("what"))
    assert sorted(tuple(r) for r in of_last_delivery(found, reviews).collect()) == [(2, "x"), (3, "x")]
    assert of_last_delivery(found.limit(0), reviews).count() == 0


def test_placements_are_bounded(spark):
    df = spark.createDataFrame([(str(i % 500), i) for i in range(5000)] + [("hot", i) for i in range(4000)], "k string, i long")
    plan = skew.plan_placement(df, "k", 10, max_tasks=8)
    assert plan.num_tasks == 8 and len(plan.buckets) == 64 and plan.total == 9000 and set(plan.heavy) == {"hot"} and len(plan.heavy["hot"]) <= 8
    loads = [r["count"] for r in skew.place(df, "k", F.col("i"), plan).groupBy("__task").count().collect()]
    assert sum(loads) == 9000 and max(loads) < 9000 / 8 * 1.5


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], 0.5)], "i long, a array<string>, d double")
    kept = durable.cut(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert durable.cut(df.limit(0)).count() == 0
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path)
    durable.drop(kept)
    durable.drop(df)
    assert not os.path.exists(path)


def test_packed_postings_come_back_in_order(spark):
    import random

    from harrow.operators import packing

    rng = random.Random(2)
    rows = [(t, d, rng.choice([1, 3, 300, 2**33]), rng.choice([0, 9, 70000])) for t in ("a", "hot", "z\u00e9") for d in rng.sample(range(1, 2**40), 400 if t == "hot" else 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "term string, doc_id long, tf long, num_tokens long").repartition(5)
    for held in (packing.HELD, 50):
        found = packing.in_order(packing.packed(df, held), held).coalesce(1).collect()
        assert sorted(map(tuple, found)) == sorted(rows)
    whole = packing.in_order(packing.packed(df.coalesce(1))).withColumn("p", F.spark_partition_id()).collect()
    by_part = {}
    for r in whole:
        by_part.setdefault(r.p, []).append(r.term)
    assert all(terms == sorted(terms) for terms in by_part.values())
    assert packing.in_order(packing.packed(df.limit(0))).count() == 0

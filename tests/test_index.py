import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from harrow.operators import encoding, index, lookup, ordering, rank, scenario
from harrow.plans import build
from harrow.sources import review_text
from harrow.sources.tables import canonical_reviews
from harrow.streaming import ingest



@pytest.fixture(scope="module")
def tables(spark, make_reviews):
    rows = [
        (1, "p1", 1, 2, 5, "The kettle leaks, the KETTLE hums"), (2, " P1 ", 0, 0, 3, "Sturdy kettle"), (3, "p2", 3, 1, 9, "a sturdy lid"),
        (4, None, 1, 1, None, None), (5, "p2", 0, 4, 1, ""), (6, "", 2, 2, 4, "?!"), (1, "p1", 1, 2, 5, "The kettle leaks, the KETTLE hums", 3),
    ]
    return canonical_reviews(make_reviews(rows)).cache()


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_canonical_reviews(tables):
    found = {r.doc_id: tuple(r)[1:5] for r in tables.collect()}
    assert found == {1: ("P1", 1, 2, 5), 2: ("P1", 0, 0, 3), 3: ("P2", 1, 3, 1), 4: (None, 1, 1, 1), 5: ("P2", 0, 4, 1), 6: (None, 2, 2, 4)}


def test_last_delivery_wins(make_reviews):
    df = canonical_reviews(make_reviews([(1, "a", 0, 0, 1, "old", 5), (1, "a", 0, 0, 2, "new", 9), (1, "a", 0, 0, 3, "older", 1)]))
    assert [(r.text, r.score) for r in df.collect()] == [("new", 2)]


def test_postings_dictionary_stats(tables):
    posted = index.postings(tables)
    assert {(r.term, r.doc_id): r.tf for r in posted.collect()} == {
        ("the", 1): 2, ("kettle", 1): 2, ("leaks", 1): 1, ("hums", 1): 1, ("sturdy", 2): 1, ("kettle", 2): 1, ("a", 3): 1, ("sturdy", 3): 1, ("lid", 3): 1,
    }
    assert {r.term: (r.df, r.cf) for r in index.dictionary(posted).collect()}["kettle"] == (2, 3)
    assert tuple(index.stats(tables).first()) == (6, 11, 7, 9)
    assert index.postings(tables, ["lid"]).count() == 1
    assert index.postings(tables, tables.selectExpr("'Lid' AS term", "doc_id")).count() == 1
    assert {r.doc_id: r.num_tokens for r in index.lengths(tables).collect()} == {1: 6, 2: 2, 3: 3, 4: 0, 5: 0, 6: 0}


def test_products(tables):
    found = {r.product_id: (r.min_doc_id, r.max_doc_id, r.num_reviews, round(r.rank, 9)) for r in index.products(tables).collect()}
    assert found == {"P1": (1, 2, 2, 4.0), "P2": (3, 5, 2, 1.0)}


def test_index_round_trip_and_lookups(spark, tables, tmp_path):
    path = str(tmp_path / "index")
    index.ReviewIndex.build(tables).save(path)
    reader = lookup.IndexReader(index.ReviewIndex.load(spark, path))
    assert (reader.get_product_id(1), reader.get_product_id(99), reader.get_review_score(99), reader.get_review_score(2)) == ("P1", None, -1, 3)
    assert (reader.get_review_helpfulness_numerator(3), reader.get_review_helpfulness_denominator(3), reader.get_review_length(1), reader.get_review_length(-1)) == (1, 3, 6, -1)
    assert (reader.get_token_frequency("Kettle"), reader.get_token_frequency("it's"), reader.get_token_collection_frequency("kettle")) == (2, 0, 3)
    assert [tuple(r) for r in reader.get_reviews_with_token("KETTLE").collect()] == [(1, 2), (2, 1)]
    assert [r.doc_id for r in reader.get_product_reviews("p1").collect()] == [1, 2] and reader.get_product_reviews("zz").count() == 0
    assert (reader.get_number_of_reviews(), reader.get_token_size_of_reviews(), reader.get_unique_number_of_tokens()) == (6, 11, 7)
    assert (reader.get_index_of_token("a"), reader.get_index_of_token("the"), reader.get_index_of_token("b")) == (0, 6, -2)
    assert [r.term for r in reader.terms().collect()] == sorted(r.term for r in reader.terms().collect())
    assert reader.tokens().count() == 9
    plan = reader.get_reviews_with_token("kettle")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,kettle)]" in plan and "ReadSchema: struct<term:string,doc_id:bigint,tf:bigint>" in plan
    index.remove_index(spark, path)
    index.remove_index(spark, path)
    assert not (tmp_path / "index").exists()


def test_merge_and_check_postings(spark):
    blocks = spark.createDataFrame([("A", 1, 2, 1), ("a", 1, 2, 1), ("a", 1, 3, 2), ("b", 2, 1, 1), (None, 1, 1, 1), ("c", None, 1, 1)], "term string, doc_id long, tf long, block_id int")
    assert sorted(tuple(r) for r in index.merge_postings(blocks).collect()) == [("a", 1, 5), ("b", 2, 1)]
    assert {r.fault for r in index.check_postings(blocks).collect()} == {"repeated", "term", "doc_id"}


def query_model(docs, terms):
    """Plain ranking model: (vsm scores, lm scores at one half)."""
    tf = {d: Counter(t) for d, t in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    total = sum(map(len, docs.values()))
    weights = {t: (1 + math.log10(n)) * math.log10(len(docs) / df[t.lower()]) for t, n in Counter(terms).items() if df[t.lower()]}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    if norm >= rank.EPSILON:
        weights = {t: w / norm for t, w in weights.items()}
    wanted = {t.lower() for t in terms}
    vsm = {d: sum(w * (1 + math.log10(c[t.lower()])) for t, w in weights.items() if c[t.lower()]) for d, c in tf.items() if wanted & set(c)}
    lm = {d: math.prod(0.5 * tf[d][t.lower()] / len(docs[d]) + 0.5 * sum(c[t.lower()] for c in tf.values()) / total for t in set(terms)) for d in vsm}
    return vsm, lm


@pytest.mark.parametrize("terms", [["kettle", "Kettle", "sturdy"], ["the"], ["zzz", "lid"], ["zzz"], ["a", "a", "lid"]])
def test_rankings_match_a_plain_model(spark, tables, terms):
    docs = {1: "the kettle leaks the kettle hums".split(), 2: "sturdy kettle".split(), 3: "a sturdy lid".split(), 4: [], 5: [], 6: []}
    vsm, lm = query_model(docs, terms)
    posted = index.postings(tables)
    words, query = index.dictionary(posted), rank.query_table(spark, terms)
    scores = rank.vector_scores(rank.query_ltc(query, words, F.lit(6)), posted)
    assert {r.doc_id: round(r.score, 9) for r in scores.collect()} == {d: round(s, 9) for d, s in vsm.items()}
    found = rank.language_model_scores(query, words, posted, index.lengths(tables), F.lit(11), 0.5)
    assert {r.doc_id: round(r.score, 12) for r in found.collect()} == {d: round(s, 12) for d, s in lm.items()}
    alone = rank.language_model_scores(query, words, posted, index.lengths(tables), F.lit(11), 1.0)
    wanted = {d: math.prod(docs[d].count(t.lower()) / len(docs[d]) for t in set(terms)) for d in lm}
    assert {r.doc_id: round(r.score, 12) for r in alone.collect()} == {d: round(s, 12) for d, s in wanted.items()}
    best = rank.top_k(scores, 2).orderBy("rank").collect()
    assert [r.doc_id for r in best] == sorted(vsm, key=lambda d: (-round(vsm[d], 12), d))[:2]
    assert rank.top_k(scores, 0).count() == 0


def test_textbook_query_weights(spark):
    words = spark.createDataFrame([("best", 50000, 1), ("car", 10000, 1), ("insurance", 1000, 1)], "term string, df long, cf long")
    found = {r.term: round(r.weight, 2) for r in rank.query_ltc(rank.query_table(spark, ["best", "car", "insurance"]), words, F.lit(1_000_000)).collect()}
    assert found == {"best": 0.34, "car": 0.52, "insurance": 0.78}


def test_textbook_language_model(spark):
    words = spark.createDataFrame([("vacation", 1, 100000), ("enjoy", 1, 200000), ("your", 1, 500000)], "term string, df long, cf long")
    posted = spark.createDataFrame([("enjoy", 3, 4), ("vacation", 3, 2), ("your", 3, 1)], "term string, doc_id long, tf long")
    length = spark.createDataFrame([(3, 10)], "doc_id long, num_tokens long")
    found = rank.language_model_scores(rank.query_table(spark, ["enjoy", "your", "vacation"]), words, posted, length, F.lit(5_000_000), 0.5).collect()
    assert [(r.doc_id, round(r.score, 5)) for r in found] == [(3, 0.00242)]


def test_sparse_vectors(spark):
    make = lambda pairs: spark.createDataFrame([("v", t, w) for t, w in pairs], "key string, term string, weight double")
    a, b = make([("a", 2.0), ("b", 2.0)]), make([("a", 2.0), ("b", 2.0), ("c", 1337.0)])
    assert rank.dot(a, b).first()[0] == 8.0 and round(rank.norm(a).first()["norm"], 9) == round(math.sqrt(8), 9)
    assert {r.term: round(r.weight, 9) for r in rank.normalized(a).collect()} == {t: round(2 / math.sqrt(8), 9) for t in "ab"}
    assert {r.term: r.weight for r in rank.multiply(a, b).collect()} == {"a": 4.0, "b": 4.0}
    assert rank.dot(a, make([("z", 1.0)])).first()[0] == 0.0


def test_vector_order_breaks_ties_by_doc_id(spark):
    weights = spark.createDataFrame([(1, t, t, 1.0) for t in ("an", "amazing", "query")], "query_id int, raw_term string, term string, weight double")
    posted = spark.createDataFrame([("an", 100, 1), ("an", 1, 1), ("an", 3, 1), ("amazing", 3, 1), ("query", 4, 31)], "term string, doc_id long, tf long")
    assert [r.doc_id for r in rank.top_k(rank.vector_scores(weights, posted), 10).orderBy("rank").collect()] == [4, 3, 1, 100]


def test_product_search(spark, make_reviews):
    reviews = canonical_reviews(make_reviews([(1, "12345ABCDE", 1, 10, 5, "phone"), (2, "12345ABCDE", 1, 10, 5, "a phone"), (3, "12345ABCDE", 83, 100, 1, "phone x"), (4, "1234567890", 93, 100, 5, "phone")]))
    posted = index.postings(reviews)
    scorer = lambda q: rank.vector_scores(rank.query_ltc(q, index.dictionary(posted), F.lit(4)), posted)
    found = rank.product_search(rank.query_table(spark, ["phone"]), reviews, index.products(reviews), scorer, 5).orderBy("rank").collect()
    assert [r.product_id for r in found] == ["1234567890", "12345ABCDE"] and round(found[1].product_rank, 3) == 1.777
    one = rank.product_search(rank.query_table(spark, ["phone"]), reviews, index.products(reviews), scorer, 1).collect()
    assert [r.product_id for r in one] == ["1234567890"]


def test_empty_index(spark, make_reviews):
    reviews = canonical_reviews(make_reviews([]))
    posted = index.postings(reviews)
    query = rank.query_table(spark, ["x"])
    assert tuple(index.stats(reviews).first()) == (0, 0, 0, 0) and index.products(reviews).count() == 0
    scores = rank.vector_scores(rank.query_ltc(query, index.dictionary(posted), F.lit(0)), posted)
    assert scores.count() == 0 and rank.top_k(scores, 3).count() == 0
    assert ordering.number_rows(posted, [F.col("term")]).count() == 0
    assert encoding.front_coding(index.dictionary(posted)).count() == 0 and encoding.term_length_records(index.dictionary(posted)).count() == 0
    assert encoding.posting_gaps(posted).count() == 0


def test_orders(spark):
    rows = [(g, i * 7 % 50, i) for i in range(50) for g in ("a", "b", None)]
    df = spark.createDataFrame(rows, "g string, p long, v long").withColumn("total", F.lit(-1))
    numbered = ordering.number_rows(df, [F.col("p"), F.col("g"), F.col("v")], "n", 0).orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(150)) and [r.p for r in numbered] == sorted(r[1] for r in rows)
    sums = ordering.running_sum(df, ["g"], [F.col("p")], "v", "total").collect()
    own = defaultdict(list)
    for g, p, v in sorted(rows, key=lambda r: r[1]):
        own[g].append((p, v))
    for r in sums:
        assert r.total == sum(v for p, v in own[r.g] if p <= r.p)
    before = ordering.previous_in_group(df, "g", "p", block=8).collect()
    assert all(r.previous == (None if r.p == 0 else r.p - 1) for r in before) and len(before) == 150


def test_gaps_and_sizes(spark):
    from harrow.functions import codecs

    posted = spark.createDataFrame([("t", 3, 1), ("t", 10, 300), ("t", 100000, 2), ("u", 5, 1)], "term string, doc_id long, tf long")
    gaps = encoding.posting_gaps(posted)
    assert {(r.term, r.doc_id): r.gap for r in gaps.collect()} == {("t", 3): 3, ("t", 10): 7, ("t", 100000): 99990, ("u", 5): 5}
    sizes = {r.term: r.num_bytes for r in encoding.group_varint_sizes(gaps).collect()}
    assert sizes == {"t": len(codecs.group_varint_encode([3, 1, 7, 300, 99990, 2])), "u": len(codecs.group_varint_encode([5, 1]))}


def test_front_coding_and_records_match_plain(spark):
    from harrow.functions import codecs

    words = sorted({"lamp", "lampshade", "lantern", "latch", "late", "a", "ab", "zz", "zzz", "b" * 9})
    df = spark.createDataFrame([(w, 1, 1) for w in words], "term string, df long, cf long")
    coded = encoding.front_coding(df).orderBy("term_index").collect()
    assert [(r.term, r.prefix_length, r.suffix_length) for r in coded] == [(w, m[1], m[2]) for w, m in zip(words, codecs.front_encode(words)[1], strict=True)]
    longest, wanted = 0, []
    for w in words:
        if len(w) > longest:
            longest = len(w)
            wanted.append(w)
    assert sorted(r.term for r in encoding.term_length_records(df).collect()) == wanted


def test_scenario(tables):
    found = as_dict(scenario.scenario(tables, index.postings(tables)), "kind", "name")
    assert tuple(found["term", "kettle"])[2:] == (2, 3, 1, 2, 4) and tuple(found["product", "P2"])[2:] == (2, None, 3, 5, 8) and found["total", ""].num_tokens == 11


TEXT = """product/productId: b1
review/helpfulness: 3/1
review/score: 4.9
review/text: first: text

product/productId: b2
product/price: 7
review/text: second

product/productId: b3
review/score: x
"""


def test_text_parsers(spark, tmp_path):
    (tmp_path / "reviews.txt").write_text(TEXT)
    records = review_text.parse_records(review_text.read_records(spark, str(tmp_path / "reviews.txt"))).collect()
    assert sorted(tuple(r) for r in records) == [("B1", 1, 3, 4, "first: text"), ("B2", 0, 1, 1, "second"), ("B3", 0, 1, 1, "")]
    lines = spark.createDataFrame(list(enumerate(TEXT.split("\n"))), "n int, value string")
    carried = review_text.parse_lines(lines, ["n"]).orderBy("line_num").collect()
    assert [tuple(r)[1:] for r in carried] == [("B1", 1, 3, 4, "first: text"), ("B2", 1, 3, 4, "second")]
    many = spark.createDataFrame([(i, f"review/text: {i}" if i != 3 else "review/score: 3") for i in range(200)], "n int, value string").repartition(7)
    scores = [r.score for r in review_text.parse_lines(many, ["n"]).orderBy("line_num").collect()]
    assert scores == [1] * 3 + [3] * 196
    assert review_text.parse_lines(lines.limit(0), ["n"]).count() == 0


def test_build_from_file_numbers_in_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for f in range(3):
        (source / f"{f}.txt").write_text("\n".join(f"product/productId: p{f}\nreview/text: w{f}x{i}\n" for i in range(20)))
    built = build.build_from_file(spark, str(source), str(tmp_path / "out"))
    found = {r.term: r.doc_id for r in built.postings.collect()}
    assert found == {f"w{f}x{i}": f * 20 + i + 1 for f in range(3) for i in range(20)}
    assert {r.product_id: r.num_reviews for r in built.products.collect()} == {"P0": 20, "P1": 20, "P2": 20}


def test_stream_of_reviews(spark, make_reviews, tmp_path):
    rows = [(i, "p", 1, 1, 5, f"word{i} word") for i in range(6)]
    df = make_reviews(rows)
    df.where("doc_id < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "blocks"), str(tmp_path / "state")).awaitTermination()
    run()
    df.where("doc_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    merged = {(r.term, r.doc_id): r.tf for r in ingest.merged_blocks(spark, str(tmp_path / "blocks")).collect()}
    assert merged == {(r.term, r.doc_id): r.tf for r in index.postings(canonical_reviews(df)).collect()}

"""Queries over all the rows of a small data folder, against plain Python."""

import math
import re

import pytest

import __spark_entry__ as entry

TEXTS = {1: "The kettle leaks, the KETTLE hums", 2: "Sturdy kettle", 3: "a sturdy lid", 5: None, 7: "the lid", 70000: "the lid of the kettle"}

QUERIES = {1: ["the", "Lid"], 2: ["kettle", "Kettle", "sturdy"], 3: ["zzz", "lid"], 4: ["the"]}


@pytest.fixture(scope="module")
def folder(spark, make_reviews, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    rows = [(d, "p1" if d < 3 else "P0" if d == 3 else None if d == 5 else "p2", 1, 2, 5, t) for d, t in TEXTS.items()]
    make_reviews([*rows, (1, "p1", 1, 2, 5, TEXTS[1], 3)]).drop("term", "tf", "weight", "mark", "rank").write.parquet(f"{path}/reviews.parquet")
    spark.createDataFrame([(q, t) for q, terms in QUERIES.items() for t in terms], "query_id int, term string").write.parquet(f"{path}/query_terms.parquet")
    return path


def tokens(doc):
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", TEXTS[doc] or "")]


def test_gaps_of_every_term_are_decoded(spark, folder):
    found = entry.queries()["posting_gaps_decoded"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted((t, d, d) for d in TEXTS for t in set(tokens(d)))


def test_byte_lists_are_made_and_read_while_postings_arrive(monkeypatch):
    """One term of many spans and many short lists: a task holds a bounded number of postings, not the lists of a batch."""
    import pyarrow as pa

    from harrow.operators import encoding

    monkeypatch.setattr(encoding, "HELD", 1000)
    posted = [("the", d * 700 + 1, d % 300 + 1) for d in range(9000)] + [(f"u{i}", 5 * i + 1, 2) for i in range(3000)]
    arrived = sorted(posted, key=lambda p: p[1] % 97)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("term", "doc_id", "tf"), p, strict=True)) for p in arrived[i : i + 400]]) for i in range(0, len(arrived), 400)]
    runs = sorted((r for b in encoding._runs(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["term"], r["span"]))
    assert max(len(r["ids"]) for r in runs) <= 4 * encoding.RUN and len(runs) < len(posted)
    schema = pa.schema([("term", pa.string()), ("span", pa.int64()), ("ids", pa.binary()), ("tf", pa.binary())])
    read = []
    source = (read.append(i) or pa.RecordBatch.from_pylist(runs[i : i + 50], schema) for i in range(0, len(runs), 50))
    encoded = [(len(read), b) for b in encoding._encode(source)]
    assert encoded[0][0] < len(read) / 2
    rows = [r for _, b in encoded for r in b.to_pylist()]
    assert len({(r["term"], r["block"]) for r in rows}) == len(rows) == 3000 + len({p[1] >> 16 for p in posted[:9000]})
    decoded = [tuple(r.values()) for b in encoding._decode(b for _, b in encoded) for r in b.to_pylist()]
    assert sorted(decoded) == sorted(posted)


def test_every_list_comes_back_from_bytes(spark, folder):
    df = entry.queries()["group_varint_decoded"](spark, folder)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == sorted((t, d, tokens(d).count(t)) for d in TEXTS for t in set(tokens(d)))


def test_exports_recover_after_a_broken_record(spark, tmp_path):
    rows = [(3, "b", "x,1/1,4,two"), (1, "a", "p,1/2,5,one"), (2, "a", 'q,1/2,"5,never closed'), (4, "a", 'r,0/0,1,"last, of\nall"'), (5, "b", None), (6, "b", "y,2/1,3,z")]
    spark.createDataFrame(rows, "rec_id long, src_file string, raw string").write.parquet(f"{tmp_path}/raw_records.parquet")
    found = entry.queries()["p7_exports"](spark, str(tmp_path)).collect()
    assert sorted((r.src_file, r.start, r.reason, r.text) for r in found) == [
        ("a", 0, None, "one"), ("a", 12, "quoting", None), ("a", 34, None, "last, of\nall"), ("b", 0, None, "two"), ("b", 12, "columns", None), ("b", 13, "helpfulness", None),
    ]


def language_model(terms):
    """doc_id to score, over the reviews with any of the terms."""
    every = [t for d in TEXTS for t in tokens(d)]
    wanted = {t.lower() for t in terms}
    return {
        d: math.prod(0.4 * tokens(d).count(t.lower()) / len(tokens(d)) + 0.6 * every.count(t.lower()) / len(every) for t in set(terms))
        for d in TEXTS if wanted & set(tokens(d))
    }


def log(score):
    return round(math.log10(score), 6) if score else None


def test_language_model_takes_every_query(spark, folder):
    queries = entry.queries()
    scores = {(r.query_id, r.doc_id): r.log_score for r in queries["batch_language_model_scores"](spark, folder).collect()}
    assert scores == {(q, d): log(s) for q, terms in QUERIES.items() for d, s in language_model(terms).items()}
    best = {(r.query_id, r.rank): (r.doc_id, r.log_score) for r in queries["batch_language_model_search"](spark, folder).collect()}
    ordered = {q: sorted(language_model(terms).items(), key=lambda x: (-round(x[1], 15), x[0])) for q, terms in QUERIES.items()}
    assert best == {(q, i + 1): (d, log(s)) for q, found in ordered.items() for i, (d, s) in enumerate(found[:10])}


def test_term_frequencies_of_every_query(spark, folder):
    queries = entry.queries()
    wanted = {(q, t, d): tokens(d).count(t.lower()) for q, terms in QUERIES.items() for t in terms for d in TEXTS if t.lower() in tokens(d)}
    assert {(r.query_id, r.raw_term, r.doc_id): r.tf for r in queries["batch_term_doc_freqs"](spark, folder).collect()} == wanted
    found = queries["batch_doc_lnn"](spark, folder).collect()
    assert {(r.query_id, r.raw_term, r.doc_id): r.weight for r in found} == {k: round(1 + math.log10(n), 9) for k, n in wanted.items()}


def test_language_model_takes_an_everyday_term(spark, folder):
    rows = entry.queries()["language_model_everyday"](spark, folder).collect()
    assert {1, 2, 3, 7, 70000} == {r.doc_id for r in rows}


def test_reviews_of_every_product_are_listed(spark, folder):
    found = entry.queries()["product_reviews"](spark, folder).collect()
    assert sorted(map(tuple, found)) == [("P0", 3), ("P1", 1), ("P1", 2), ("P2", 7), ("P2", 70000)]

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow.llm import fusion, ngrams, weights
from harrow.functions.batches import tokens


def texts_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts, 1)], "doc_id long, text string, term string, df int, cf int")


def words(text):
    import re

    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)] if text is not None else []


def random_texts(seed, count=120):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "The", "a", "b", "kettle", "x1", "é", "-"]) for _ in range(rng.randint(0, 9))) for _ in range(count)] + [None, "", "?!", "long " * 3000, "a b a b a b"]


def test_tokens_of_batches():
    import pyarrow as pa

    texts = random_texts(1) + ["ab", "cd", "ÉtÉ", "K", None]
    found, rows = tokens(pa.array(texts).slice(3))
    wanted = [(w, i) for i, t in enumerate(texts[3:]) for w in words(t)]
    assert list(zip(found.to_pylist(), rows.tolist(), strict=True)) == wanted
    assert len(tokens(pa.array([None, ""], pa.string()))[0]) == 0 and len(tokens(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("most", [1, 2, 4])
def test_ngrams_match_brute_force(spark, most):
    texts = random_texts(most)
    cf, df = Counter(), Counter()
    for t in texts:
        w = words(t)
        grams = [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    counts = ngrams.ngram_counts(texts_of(spark, texts).repartition(5), most).collect()
    assert {r.ngram: (r.df, r.cf) for r in counts if r.num_terms} == {g: (df[g], cf[g]) for g in cf}
    assert all(len(r.ngram.split()) == r.num_terms for r in counts) and len(counts) == len(cf) + 1
    assert next(r.df for r in counts if not r.num_terms) == sum(t is not None for t in texts)


def test_partial_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "HELD_ROWS", 20)
    texts = [f"w{i} w{i % 7} common" for i in range(200)]
    found = {r.ngram: (r.df, r.cf) for r in ngrams.ngram_counts(texts_of(spark, texts), 1).collect()}
    assert found["common"] == (200, 200) and found["w3"] == (29, 29 + 1) and found["w150"] == (1, 1)


def test_marks(spark, make_reviews):
    rows = [(i, "p", 1, 1, 5, "all " + ("some" if i < 5 else "") + (" few" if i < 2 else "")) for i in range(10)] + [(0, "p", 1, 1, 5, "all some few", 4), (99, "p", 1, 1, 5, None)]
    counts = ngrams.review_ngrams(make_reviews(rows)).cache()
    assert {r.ngram: r.mark for r in ngrams.marked(counts).collect()} == {"all": "common", "some": "common", "few": "rare"}
    assert {r.ngram: r.mark for r in ngrams.marked(counts, 1, 0.5).collect()} == {"all": "common", "some": None, "few": None}
    empty = ngrams.review_ngrams(make_reviews([])).cache()
    assert ngrams.marked(empty).count() == 0


def brute_weights(texts, mu, min_df):
    tf = {i: Counter(words(t)) for i, t in enumerate(texts, 1) if t is not None}
    df, cf = Counter(t for c in tf.values() for t in c), Counter()
    for c in tf.values():
        cf.update(c)
    total, out = sum(cf.values()), {}
    for d, c in tf.items():
        for t, n in c.items():
            if df[t] >= min_df:
                p = (n + mu * cf[t] / total) / (sum(c.values()) + mu)
                out[d, t] = (n, df[t], cf[t], p * math.log2(p / (cf[t] / total)), (1 + math.log10(n)) * math.log10(len(tf) / df[t]))
    return out


@pytest.mark.parametrize("limit", [weights.LEXICON_BYTES, 0])
def test_weights_match_brute_force(spark, limit):
    texts = random_texts(5) + ["single rare word", "rare kettle kettle"]
    wanted = brute_weights(texts, 100.0, 2)
    df = texts_of(spark, texts)
    found = weights.term_weights(df, lexicon_bytes=limit).collect()
    assert {(r.doc_id, r.term) for r in found} == set(wanted)
    for r in found:
        assert (r.tf, r.df, r.cf) == wanted[r.doc_id, r.term][:3]
        assert abs(r.kl - wanted[r.doc_id, r.term][3]) < 1e-9 and abs(r.weight - wanted[r.doc_id, r.term][4]) < 1e-9
    best = {r.doc_id: r.term for r in weights.term_weights(df, best="weight", lexicon_bytes=limit).collect()}
    for d in {d for d, _ in wanted}:
        assert best[d] == min((-round(w[4], 12), t) for (e, t), w in wanted.items() if e == d)[1]
    assert weights.term_weights(df.limit(0), lexicon_bytes=limit).count() == 0


def brute_fusion(rows, constant=60.0):
    groups = {}
    for g, item, *values in set(rows):
        held = groups.setdefault(g, {}).setdefault(item, [None] * len(values))
        for i, v in enumerate(values):
            if v is not None and (held[i] is None or v > held[i]):
                held[i] = v
    out = {}
    for g, items in groups.items():
        for m in range(len(next(iter(items.values())))):
            low = float("-inf")
            values = [low if v[m] is None else v[m] for v in items.values()]
            for item, v in items.items():
                own = low if v[m] is None else v[m]
                place = sum(x > own for x in values) + (values.count(own) + 1) / 2
                out[g, item] = out.get((g, item), 0.0) + 1 / (constant + place)
    return out


def test_fusion_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(1, 25), rng.choice([0.1, 0.5, 1e9, None, -3.0]), rng.choice([1.0, 2.0, None])) for _ in range(150)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows + rows[:20]], "q int, d int, a double, b double, fused double")
    fused = fusion.fuse(df, "q", "d", {"a": F.col("a"), "b": F.col("b")})
    found = {(r.q, r.d): r.fused for r in fused.collect()}
    wanted = brute_fusion(rows)
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    first = {r.q: r.d for r in fusion.first_of_each(fused, "q", "d").collect()}
    assert first == {q: min((-round(v, 12), d) for (g, d), v in wanted.items() if g == q)[1] for q in {q for q, _ in wanted}}
    ranks = sorted((r["rank"], r.d) for r in fusion.in_order(fused, "q", "d").where("q = 1").collect())
    assert [d for _, d in ranks] == [d for _, d in sorted((-round(v, 12), d) for (g, d), v in wanted.items() if g == 1)] and [n for n, _ in ranks] == list(range(1, len(ranks) + 1))
    assert fusion.first_of_each(fusion.fuse(df.limit(0), "q", "d", {"a": F.col("a")}), "q", "d").count() == 0


def test_no_score_dominates_by_its_range(spark, make_reviews):
    reviews = make_reviews([(1, "p", 9, 10, 5, "x"), (2, "p", 0, 0, 1, "x"), (3, "p", 1, 9, None, "x"), (1, "p", 9, 10, 5, "x", 2)])
    listed = spark.createDataFrame([(1, 1, 2.0, 1e-9), (1, 2, 1e6, 1e-12), (1, 3, 1.0, 1e-10), (1, 1, 2.0, 1e-9), (2, 7, 1.0, 1.0)], "query_id int, doc_id long, vsm_score double, lm_score double")
    first = fusion.first_of_each(fusion.fuse_candidates(listed, reviews), "query_id", "doc_id")
    assert sorted(tuple(r) for r in first.collect()) == [(1, 1), (2, 7)]

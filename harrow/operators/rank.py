"""Ranked retrieval: vector space (lnn.ltc), unigram language model with mixture smoothing, two-stage product search.

Queries are tables (query_id, term) of terms as typed; one query and many take the same plans. Terms as typed are the
dimensions of a query ("Phone" and "phone" are two), their lower-case form is looked up. Query tables are joined by
size: Spark broadcasts one that is small by its statistics and shuffles a large one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors shorter than this are not scaled to length 1.
EPSILON = 1e-7


def query_table(spark: SparkSession, terms: list[str], query_id: int = 1) -> DataFrame:
    return spark.createDataFrame([(query_id, t) for t in terms], "query_id int, term string")


def query_counts(query: DataFrame) -> DataFrame:
    """(query_id, raw_term, term, qtf); null terms are left out."""
    return query.where("term is not null").groupBy("query_id", F.col("term").alias("raw_term")).agg(F.count("*").alias("qtf")).withColumn("term", F.lower("raw_term"))


#: Queries with at most so many distinct terms reach the scan of the postings as filters; larger ones are joined.
PUSHED_TERMS = 1000


def of_query(postings: DataFrame, query: DataFrame) -> DataFrame:
    """The postings of a query table's terms. Up to PUSHED_TERMS terms go into the scan, ten to a condition, as Parquet
    compares longer lists with row groups by their ends only; more are left to the join that follows."""
    terms = [r[0] for r in query.where("term is not null").select(F.lower("term")).distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(terms) > PUSHED_TERMS:
        return postings
    wanted = F.lit(False)
    for at in range(0, len(terms), 10):
        wanted = wanted | F.col("term").isin(sorted(terms)[at : at + 10])
    return postings.where(wanted)


def query_ltc(query: DataFrame, dictionary: DataFrame, num_reviews: Column) -> DataFrame:
    """(query_id, raw_term, term, weight): (1 + log10 qtf) * log10(N / df), scaled to length 1 within the query.

    Terms that no review has are left out of vector and length; a zero vector stays zero.
    """
    known = query_counts(query).join(dictionary.select("term", "df"), "term")
    raw = known.withColumn("__w", (1 + F.log10("qtf")) * F.log10(num_reviews.cast("double") / F.col("df")))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    weight = F.when(F.col("__norm") < EPSILON, F.col("__w")).otherwise(F.col("__w") / F.col("__norm"))
    return raw.join(norms, "query_id").select("query_id", "raw_term", "term", weight.alias("weight"))


def doc_lnn(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw_term, weight): 1 + log10 tf of the query's terms in each review that has any."""
    return query_counts(query).join(postings, "term").select("query_id", "doc_id", "raw_term", (1 + F.log10("tf")).alias("weight"))


def vector_scores(weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from query_ltc(); reviews that match only terms of weight 0 score 0 and stay."""
    hits = postings.join(weights, "term")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * (1 + F.log10("tf"))).alias("score"))


def top_k(scores: DataFrame, k: int, item: str = "doc_id", decimals: int = 12) -> DataFrame:
    """The k best of each query: (query_id, item, score, rank), score descending, item ascending.

    Scores are rounded before the comparison, as sums of doubles may differ in the last digits between runs. k below 1
    gives no rows. Each task keeps k rows of a query before the shuffle.
    """
    rounded = scores.withColumn("score", F.round("score", decimals))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(item))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", item, "score", "rank")


def vector_space_search(query: DataFrame, dictionary: DataFrame, postings: DataFrame, num_reviews: Column, k: int) -> DataFrame:
    return top_k(vector_scores(query_ltc(query, dictionary, num_reviews), postings), k)


def corpus_frequencies(query: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, raw_term, cf), 0 for terms that no review has."""
    return query_counts(query).join(dictionary.select("term", "cf"), "term", "left").select("query_id", "raw_term", F.coalesce("cf", F.lit(0)).alias("cf"))


def term_doc_frequencies(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, raw_term, doc_id, tf)."""
    return query_counts(query).join(postings, "term").select("query_id", "raw_term", "doc_id", "tf")


def language_model_scores(query: DataFrame, dictionary: DataFrame, postings: DataFrame, lengths: DataFrame | None, total_tokens: Column, mixture: float) -> DataFrame:
    """(query_id, doc_id, score): product over distinct terms of mixture * tf / length + (1 - mixture) * cf / T.

    Only reviews with at least one of the terms; a term that no review has makes every score 0. Logarithms are summed, so
    terms that a review lacks cost no row: a query's sum over the background of all its terms, and for each term of the
    review what it adds to that. lengths: (doc_id, num_tokens), or None where the postings have num_tokens, as those of an
    index do.
    """
    counted = query_counts(query).join(dictionary.select("term", "cf"), "term", "left")
    counted = counted.withColumn("__base", (1 - mixture) * F.coalesce("cf", F.lit(0)) / total_tokens)
    log_base = F.when(F.col("__base") > 0, F.log("__base")).otherwise(0.0)
    whole = counted.groupBy("query_id").agg(F.sum(log_base).alias("__all"), F.count_if(F.col("__base") <= 0).alias("__needed"))
    hits = postings if lengths is None else postings.join(lengths, "doc_id")
    hits = hits.join(counted.select("query_id", "term", "__base"), "term")
    own = mixture * F.col("tf") / F.col("num_tokens") + F.col("__base")
    # Without background, a score is above 0 only if the review has every such term.
    summed = hits.groupBy("query_id", "doc_id").agg(F.sum(F.log(own) - log_base).alias("__more"), F.count_if(F.col("__base") <= 0).alias("__met"))
    score = F.when(F.col("__met") >= F.col("__needed"), F.exp(F.col("__all") + F.col("__more"))).otherwise(0.0)
    return summed.join(whole, "query_id").select("query_id", "doc_id", score.alias("score"))


def product_relevance(scores: DataFrame, reviews: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, product_id, relevance): summed scores of a product's reviews over the number of all its reviews."""
    owned = scores.join(reviews.select("doc_id", "product_id"), "doc_id").where("product_id is not null")
    summed = owned.groupBy("query_id", "product_id").agg(F.sum("score").alias("__sum"))
    return summed.join(products.select("product_id", "num_reviews"), "product_id").select("query_id", "product_id", (F.col("__sum") / F.col("num_reviews")).alias("relevance"))


def product_search(query: DataFrame, reviews: DataFrame, products: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(query_id, product_id, relevance, product_rank, rank): the k most relevant products, then ordered by their rank.

    `scorer` makes (query_id, doc_id, score) of a query table; any ranking function does. Ties: relevance, then id.
    """
    relevance = product_relevance(scorer(query), reviews, products).select("query_id", "product_id", F.col("relevance").alias("score"))
    best = top_k(relevance, k, "product_id").select("query_id", "product_id", F.col("score").alias("relevance"))
    ranked = best.join(products.select("product_id", F.round("rank", 12).alias("product_rank")), "product_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("product_rank"), F.desc("relevance"), F.asc("product_id"))  # k rows at most
    return ranked.select("query_id", "product_id", "relevance", "product_rank", F.row_number().over(order).alias("rank"))


def norm(vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, norm) of sparse vectors (key, term, weight)."""
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def normalized(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Vectors of length 1; one shorter than EPSILON stays as it is."""
    scaled = F.when(F.col("norm") < EPSILON, F.col("weight")).otherwise(F.col("weight") / F.col("norm"))
    return vectors.join(norm(vectors, key), key).select(key, "term", scaled.alias("weight"))


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term, weight) of two vectors (term, weight): products of the terms in both."""
    both = left.select("term", F.col("weight").alias("__a")).join(right.select("term", F.col("weight").alias("__b")), "term")
    return both.select("term", (F.col("__a") * F.col("__b")).alias("weight"))


def dot(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (dot); 0 without common terms."""
    return multiply(left, right).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("dot"))

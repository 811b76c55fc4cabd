"""The tables of a data folder and the canonical form of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.text import ordered_votes, product_key


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def one_delivery(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key: the delivery that came last, of equal times the largest content.

    Rows with a null key are left out. The maximum is taken on the map side first, so many deliveries of one key
    shrink to one row for each map task before the shuffle.
    """
    best = F.max(F.struct(order, *columns)).alias("__best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"__best.{c}").alias(c) for c in columns))


def distinct_reviews(reviews: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and the given columns, each doc_id once."""
    return one_delivery(reviews, "doc_id", "received_at", columns)


def of_last_delivery(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of `found` that come from the last delivery of their doc_id, each doc_id once, without received_at.

    found: doc_id, received_at and what an operator found in single deliveries; reviews: all deliveries. So texts are
    looked through where they are read and never shuffled. Of equal times a delivery with a finding counts, of several
    the one with the largest. Rows with a null doc_id are left out.
    """
    times = reviews.where("doc_id is not null").groupBy("doc_id").agg(F.max("received_at").alias("__last"), F.count("*").alias("__n"))
    repeated = times.where("__n > 1").select("doc_id", "__last")
    columns = [c for c in found.columns if c not in ("doc_id", "received_at")]
    # One finding for each doc_id before the join, so a review delivered very often fills no task.
    best = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("received_at", *columns)).alias("__best"))
    kept = best.join(repeated, "doc_id", "left").where(F.col("__last").isNull() | (F.col("__best.received_at") == F.col("__last")))
    return kept.select("doc_id", *(F.col("__best")[c].alias(c) for c in columns))


def canonical_reviews(reviews: DataFrame, with_text: bool = True) -> DataFrame:
    """Each doc_id once: product_id folded (null is no product), votes ordered, score 1 outside 1..5 or null, text as stored.

    Without text, the scan does not read it.
    """
    texts = ["text"] if with_text else []
    votes = ordered_votes(F.col("helpfulness_num"), F.col("helpfulness_den"))
    return (
        distinct_reviews(reviews, ["product_id", "helpfulness_num", "helpfulness_den", "score", *texts])
        .withColumn("__votes", votes)
        .select(
            "doc_id", product_key(F.col("product_id")).alias("product_id"),
            F.col("__votes.num").alias("helpfulness_num"), F.col("__votes.den").alias("helpfulness_den"),
            F.when(F.col("score").between(1, 5), F.col("score")).otherwise(1).cast("int").alias("score"), *texts,
        )
    )

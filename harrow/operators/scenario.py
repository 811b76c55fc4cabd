"""Independent roll-up of an index, for comparing two builds: totals, terms and products as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scenario(reviews: DataFrame, postings: DataFrame) -> DataFrame:
    """(kind, name, num_docs, num_tokens, first_doc, last_doc, doc_sum) with kind total, term or product.

    doc_sum, the sum of doc_id * tf (of doc_id for products), stands for the lists themselves, which scenario_lists()
    gives in blocks.
    """

    def rows(df: DataFrame, kind: str, name: Column, tokens: Column, weight: Column) -> DataFrame:
        return df.groupBy(name.alias("name")).agg(
            F.count("*").alias("num_docs"), F.sum(tokens).alias("num_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum(F.col("doc_id") * weight).alias("doc_sum")
        ).select(F.lit(kind).alias("kind"), "*")

    tf, none = F.col("tf"), F.lit(None).cast("long")
    terms = rows(postings, "term", F.col("term"), tf, tf)
    total = terms.agg(F.sum("num_docs").alias("num_docs"), F.sum("num_tokens").alias("num_tokens"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("doc_sum").alias("doc_sum"))
    total = total.select(F.lit("total").alias("kind"), F.lit("").alias("name"), "*")
    owned = rows(reviews.where("product_id is not null"), "product", F.col("product_id"), none, F.lit(1))
    return terms.unionByName(total).unionByName(owned)


#: Ids of one row of scenario_lists(): a list of any length comes in rows of bounded size.
LIST_BLOCK = 1 << 16


def scenario_lists(reviews: DataFrame, postings: DataFrame) -> DataFrame:
    """(kind, name, block, entries): every term's list of (doc_id, tf) and every product's list of (doc_id, 1), in order.

    block: doc_id over LIST_BLOCK; so a difference between two builds is found in its row. Terms and products without
    reviews have none.
    """

    def rows(df: DataFrame, kind: str, name: str, tf: Column) -> DataFrame:
        entry = F.struct("doc_id", tf.cast("long").alias("tf"))
        grouped = df.groupBy(F.col(name).alias("name"), F.floor(F.col("doc_id") / LIST_BLOCK).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        return grouped.select(F.lit(kind).alias("kind"), "*")

    owned = reviews.where("product_id is not null").select("product_id", "doc_id")
    return rows(postings.select("term", "doc_id", "tf"), "term", "term", F.col("tf")).unionByName(rows(owned, "product", "product_id", F.lit(1)))


def write_scenario(reviews: DataFrame, postings: DataFrame, path: str) -> None:
    """The roll-up and the lists as lines of JSON in the folders totals and lists below path."""
    scenario(reviews, postings).write.mode("overwrite").json(f"{path}/totals")
    scenario_lists(reviews, postings).write.mode("overwrite").json(f"{path}/lists")

"""One ranking from several scores: reciprocal rank fusion.

Within a group each score ranks its items on its own, best first; an item's fused score is the sum of 1 / (constant +
rank). Ranks come from running sums over counts of equal values, which follow range partitions: a group that holds a
third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import ordered_votes
from harrow.operators.ordering import running_sum
from harrow.plans.durable import cut
from harrow.sources.tables import distinct_reviews


def fuse(rows: DataFrame, group: str, item: str, scores: dict[str, Column], constant: float = 60.0) -> DataFrame:
    """(group, item, fused) from columns of rows; higher is better for every score.

    Repeated rows count once; an item with several different rows in a group gets the sum of its best values. Equal
    values share the mean of their ranks; null and NaN come last, as equals. An empty table gives an empty result.
    Items of a null group form a group; a null item is an item.
    """
    values = [F.max(F.when(~F.isnan(c.cast("double")), c.cast("double"))).alias(f"__s{i}") for i, c in enumerate(scores.values())]
    items = cut(rows.groupBy(F.col(group).alias("__g"), F.col(item).alias("__i")).agg(*values))
    entries = F.array(*(F.struct(F.lit(n).alias("m"), F.col(f"__s{i}").alias("v")) for i, n in enumerate(scores)))
    long = items.select("__g", "__i", F.explode(entries).alias("__e")).select("__g", "__i", F.col("__e.m").alias("__m"), F.col("__e.v").alias("__v"))
    counts = long.groupBy("__g", "__m", "__v").agg(F.count("*").alias("__n"))
    summed = running_sum(counts, ["__g", "__m"], [F.col("__v").desc_nulls_last()], "__n", "__upto")
    part = 1 / (F.lit(constant) + F.col("__upto") - (F.col("__n") - 1) / 2)
    parts = summed.select(F.col("__g").alias("__h"), F.col("__m").alias("__k"), F.col("__v").alias("__w"), part.alias("__part"))
    same = F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__m") == F.col("__k")) & F.col("__v").eqNullSafe(F.col("__w"))
    fused = long.join(parts, same).groupBy("__g", "__i").agg(F.round(F.sum("__part"), 12).alias("fused"))
    return fused.select(F.col("__g").alias(group), F.col("__i").alias(item), "fused")


def in_order(fused: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, fused, rank): fused descending, item ascending."""
    ones = fused.withColumn("__one", F.lit(1))
    return running_sum(ones, [group], [F.desc("fused"), F.asc(item)], "__one", "rank").drop("__one")


def first_of_each(fused: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item): the first of in_order(), by a grouping that shrinks on the map side."""
    best = fused.groupBy(group).agg(F.min(F.struct((-F.col("fused")).alias("a"), F.col(item).alias("i"))).alias("__b"))
    return best.select(group, F.col("__b.i").alias(item))


def candidate_scores(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """(query_id, doc_id, vsm_score, lm_score, score, votes, ratio) of logged result lists.

    A null score of a review stays null here (it ranks last), unlike in the index; a candidate without review has null
    votes and the ratio of no votes.
    """
    wanted = candidates.select("doc_id").distinct()
    known = distinct_reviews(reviews.join(wanted, "doc_id", "left_semi"), ["helpfulness_num", "helpfulness_den", "score"])
    votes = ordered_votes(F.col("helpfulness_num"), F.col("helpfulness_den"))
    known = known.select("doc_id", "score", votes["num"].alias("votes"), votes["den"].alias("__den"))
    joined = candidates.select("query_id", "doc_id", "vsm_score", "lm_score").distinct().join(known, "doc_id", "left")
    ratio = F.when(F.coalesce("__den", F.lit(0)) == 0, F.lit(0.5)).otherwise(F.col("votes") / F.col("__den"))
    return joined.select("query_id", "doc_id", "vsm_score", "lm_score", "score", "votes", ratio.alias("ratio"))


METRICS = ("vsm_score", "lm_score", "score", "votes", "ratio")


def fuse_candidates(candidates: DataFrame, reviews: DataFrame, constant: float = 60.0) -> DataFrame:
    """fuse() of the five scores of the candidates of each query."""
    return fuse(candidate_scores(candidates, reviews), "query_id", "doc_id", {m: F.col(m) for m in METRICS}, constant)

"""The queries of this subpackage; their SQL, where SQL can express them on whole tables, is in sql.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.llm import fusion, leakage, markup, mixing, mojibake, ngrams, spam, sql, weights
from harrow.plans.durable import cut
from harrow.plans.registry import Registry
from harrow.sources.tables import distinct_reviews, read

llm = Registry()


#: Terms of the suffixes that the token counts of p1_found and p1_terms come from.
SUFFIX_TERMS = 2


def _marked_terms(spark, folder):
    """(term, df, cf, mark) of single tokens, the prefixes of length one of sorted suffixes."""
    counts = cut(ngrams.review_ngrams(read(spark, folder, "reviews"), SUFFIX_TERMS).where("num_terms < 2"))
    return ngrams.marked(counts).select(F.col("ngram").alias("term"), "df", "cf", "mark")


@llm.query("p1_found", sql.P1_FOUND)
def p1_found(spark, folder):
    return _marked_terms(spark, folder).where("mark is not null").select("term", "mark")


@llm.query("p1_terms", sql.P1_TERMS)
def p1_terms(spark, folder):
    return _marked_terms(spark, folder)


@llm.query("p1_ngrams", sql.P1_NGRAMS)
def p1_ngrams(spark, folder):
    """Every run of up to three terms, the rare and the common ones marked."""
    return ngrams.marked(cut(ngrams.review_ngrams(read(spark, folder, "reviews"), 3)))


@llm.query("p2_found", sql.P2_FOUND)
def p2_found(spark, folder):
    return weights.term_weights(distinct_reviews(read(spark, folder, "reviews"), ["text"]), best="weight").select("doc_id", "term")


@llm.query("p2_distinctive", sql.P2_DISTINCTIVE)
def p2_distinctive(spark, folder):
    """The term of each review with the largest divergence."""
    heaviest = weights.term_weights(distinct_reviews(read(spark, folder, "reviews"), ["text"]), best="kl")
    return heaviest.select("doc_id", "term", F.round("kl", 6).alias("kl"))


@llm.query("p2_term_weights", sql.P2_WEIGHTS)
def p2_term_weights(spark, folder):
    weighed = weights.term_weights(distinct_reviews(read(spark, folder, "reviews"), ["text"]))
    return weighed.withColumns({c: F.round(c, 6) for c in ("kl", "weight")})


@llm.query("p3_found", sql.P3_FOUND)
def p3_found(spark, folder):
    fused = fusion.fuse_candidates(read(spark, folder, "candidates"), read(spark, folder, "reviews"))
    return fusion.first_of_each(fused, "query_id", "doc_id")


@llm.query("p3_fused", sql.P3_FUSED)
def p3_fused(spark, folder):
    fused = fusion.fuse_candidates(read(spark, folder, "candidates"), read(spark, folder, "reviews"))
    return fusion.in_order(fused, "query_id", "doc_id").withColumn("fused", F.round("fused", 9))


@llm.query("p6_found")
def p6_found(spark, folder):
    return mojibake.garbled_reviews(read(spark, folder, "reviews"), restored=False)


@llm.query("p6_restored")
def p6_restored(spark, folder):
    return mojibake.garbled_reviews(read(spark, folder, "reviews"))


@llm.query("p4_found")
def p4_found(spark, folder):
    return markup.review_residue(read(spark, folder, "reviews"), cleaned=False)


@llm.query("p4_cleaned")
def p4_cleaned(spark, folder):
    return markup.review_residue(read(spark, folder, "reviews")).withColumn("roles", F.array_join("roles", " "))


@llm.query("p8_found")
def p8_found(spark, folder):
    return leakage.leaked(read(spark, folder, "documents"), read(spark, folder, "eval_items")).select("doc_id", "item_id")


@llm.query("p8_passages")
def p8_passages(spark, folder):
    return leakage.leaked(read(spark, folder, "documents"), read(spark, folder, "eval_items"))


@llm.query("p9_found", sql.P9_FOUND)
def p9_found(spark, folder):
    _, report = mixing.mix(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))
    return report.where("exhausted").select("source")


@llm.query("p9_report")
def p9_report(spark, folder):
    return mixing.mix(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))[1]


@llm.query("p9_mix")
def p9_mix(spark, folder):
    return mixing.copies_of(mixing.mix(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))[0])


@llm.query("p10_found")
def p10_found(spark, folder):
    return spam.classify(read(spark, folder, "documents")).where("spam").select("doc_id")


@llm.query("p10_scores")
def p10_scores(spark, folder):
    return spam.classify(read(spark, folder, "documents"))

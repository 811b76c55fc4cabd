"""How characteristic each term is of its record: divergence of smoothed language models, and the index's own weight.

kl: the term's part of the relative entropy between the record's distribution, smoothed with mu tokens of the
collection (Dirichlet), and the collection's; in bits. weight: (1 + log10 tf) * log10(N / df), as the searches use it.
Terms in fewer than min_df records are left out.

The heaviest term by weight is looked for among those that the divergence leaves: kl over the record's probability gives
the collection's, hence cf, and df lies between cf / s and cf, s being the largest cf / df of any term. So each term's
weight has bounds; terms whose upper bound is below another's lower one are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import raw_tokens
from harrow.llm.ngrams import ngram_counts
from harrow.plans.durable import cut

#: The lexicon (terms in min_df records or more) goes to all executors only up to this many bytes, measured before.
LEXICON_BYTES = 24_000_000
WEIGHTS = "doc_id long, term string, tf long, df long, cf long, kl double, weight double"


def _weigh(lexicon, records: int, total: int, mu: float, best: str):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from harrow.functions.batches import coded

    schema = pa.schema([("doc_id", pa.int64()), ("term", pa.large_string()), ("tf", pa.int64()), ("df", pa.int64()), ("cf", pa.int64()), ("kl", pa.float64()), ("weight", pa.float64())])

    def run(batches):
        known = pa.ipc.open_stream(lexicon.value).read_all().combine_chunks()
        all_terms = known["term"].combine_chunks().cast(pa.large_string())
        all_df, all_cf = known["df"].to_numpy(), known["cf"].to_numpy()
        most = float((all_cf / all_df).max()) if len(all_df) else 1.0
        for batch in batches:
            terms, codes, rows = coded(batch.column("text"))
            length = np.bincount(rows, minlength=batch.num_rows)
            places = pc.fill_null(pc.index_in(terms, value_set=all_terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            places = places[codes] if len(codes) else np.zeros(0, np.int64)
            found = places >= 0
            # Lexicon places follow byte order, so the smallest place is the first term.
            pairs, tf = np.unique(rows[found] * len(all_terms) + places[found], return_counts=True)
            row, place = np.divmod(pairs, max(1, len(all_terms)))
            df, cf = all_df[place], all_cf[place]
            background = cf / total
            smoothed = (tf + mu * background) / (length[row] + mu)
            kl = smoothed * np.log2(smoothed / background)
            if best == "weight" and len(row):
                # log10 of records / cf, from the divergence; the margin covers rounding.
                rarity = np.log10(records / total) - np.log10(smoothed) + kl / smoothed * np.log10(2)
                low, high = ((1 + np.log10(tf)) * (rarity + more) for more in (0.0, np.log10(most)))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                floor = np.repeat(np.maximum.reduceat(low, first), np.diff(np.append(first, len(row))))
                left = high >= floor - 1e-6
                row, place, tf, df, cf, kl = (x[left] for x in (row, place, tf, df, cf, kl))
            weight = np.round((1 + np.log10(tf)) * np.log10(records / df), 12)
            if best:
                order = np.lexsort((place, -(weight if best == "weight" else np.round(kl, 12)), row))
                keep = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                row, place, tf, df, cf, kl, weight = (x[keep] for x in (row, place, tf, df, cf, kl, weight))
            ids = batch.column("doc_id").take(pa.array(row))
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                columns = [ids[part], all_terms.take(pa.array(place[part])), *(pa.array(x[part]) for x in (tf.astype(np.int64), df, cf, kl, weight))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _joined(texts: DataFrame, lexicon: DataFrame, records: int, total: int, mu: float) -> DataFrame:
    """The same rows by a join on the term, for lexicons beyond the bound; adaptive execution splits frequent terms."""
    length = F.size(raw_tokens(F.col("text")))
    exploded = texts.where("text is not null").select("doc_id", length.alias("__length"), F.explode(raw_tokens(F.col("text"))).alias("__raw"))
    counted = exploded.groupBy("doc_id", "__length", F.lower("__raw").alias("term")).agg(F.count("*").alias("tf"))
    met = counted.join(lexicon.hint("merge"), "term").withColumn("__b", F.col("cf") / F.lit(total))
    smoothed = (F.col("tf") + mu * F.col("__b")) / (F.col("__length") + mu)
    weight = F.round((1 + F.log10("tf")) * F.log10(F.lit(float(records)) / F.col("df")), 12)
    return met.select("doc_id", "term", "tf", "df", "cf", (smoothed * F.log2(smoothed / F.col("__b"))).alias("kl"), weight.alias("weight"))


def term_weights(texts: DataFrame, mu: float = 100.0, min_df: int = 2, best: str = "", lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(doc_id, term, tf, df, cf, kl, weight) of every record's terms; best: weight or kl, of its term with the largest only.

    texts: doc_id (each once) and text; other columns are ignored. Among equal weights (to 12 decimals) the term first
    in byte order is the heaviest. Records without a term in the lexicon, null texts included, give no row; so does an
    empty table. Counts are those of all given texts. A term in all records has weight 0. The texts are written to the
    shared folder once, as they are read twice.
    """
    spark = texts.sparkSession
    rows = cut(texts.select("doc_id", "text"))
    counts = cut(ngram_counts(rows))
    lexicon = counts.where((F.col("num_terms") == 1) & (F.col("df") >= min_df)).select(F.col("ngram").alias("term"), "df", "cf")
    totals = counts.agg(F.sum(F.when(F.col("num_terms") == 0, F.col("df"))).alias("records"), F.sum(F.when(F.col("num_terms") == 1, F.col("cf"))).alias("total")).first()
    records, total = totals["records"] or 0, totals["total"] or 0
    size = lexicon.agg(F.coalesce(F.sum(F.length("term") + 20), F.lit(0))).first()[0]
    if size > lexicon_bytes:
        weighed = _joined(rows, lexicon, records, total, mu)
        if best:
            top = F.min(F.struct((-F.round(best, 12)).alias("a"), "term", "tf", "df", "cf", "kl", "weight")).alias("b")
            weighed = weighed.groupBy("doc_id").agg(top).select("doc_id", *(f"b.{c}" for c in ("term", "tf", "df", "cf", "kl", "weight")))
        return weighed

    import pyarrow as pa

    table = lexicon.toArrow().sort_by("term")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return rows.mapInArrow(_weigh(sent, records, total, mu, best), WEIGHTS)

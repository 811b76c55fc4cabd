"""Suffix-sorted n-gram counting: how often every term or n-gram occurs, and in how many records.

Each position of a record gives its suffix, cut after max_terms terms. Suffixes go to the partition of their first term,
are sorted in descending order there, and one pass with a stack adds up the counts of all their prefixes.

The record set of a prefix is kept as a number: of the suffixes of one record that share a prefix, only the first counts
it, so the numbers of records add up like the numbers of occurrences, and equal suffixes shrink to one row before the
shuffle however frequent their first term is. With max_terms above 1 the suffixes of one first term are spread by their
second term over as many partitions as the shuffle has, and a last sum joins the counts of single terms.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.tables import distinct_reviews

#: Rows of partial counts that a task holds before it hands them on.
HELD_ROWS = 400_000


def _partial_counts(max_terms: int):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from harrow.functions.batches import coded

    names = ["occurrences", *(f"records_{n}" for n in range(1, max_terms + 1))]
    schema = pa.schema([("suffix", pa.large_string()), *((n, pa.int64()) for n in names)])

    def of_batch(texts: pa.Array) -> pa.Table:
        terms, codes, rows = coded(texts)
        width, size = len(terms), len(codes)
        group, records, ends = codes, [], np.ones(size, np.int64)
        for n in range(1, max_terms + 1):
            if n > 1:
                inside = np.zeros(size, bool)
                inside[: size - n + 1] = rows[n - 1 :] == rows[: size - n + 1]
                following = np.full(size, width, np.int64)
                following[: size - n + 1] = np.where(inside[: size - n + 1], codes[n - 1 :], width)
                ends += inside
                group = np.unique(group * (width + 1) + following, return_inverse=True)[1].astype(np.int64)
            else:
                inside = np.ones(size, bool)
            at = np.flatnonzero(inside)
            span = int(group.max(initial=0)) + 1
            seen = np.unique(rows[at] * span + group[at], return_index=True)[1]
            new = np.zeros(size, np.int64)
            new[at[seen]] = 1
            records.append(new)
        kinds = int(group.max(initial=-1)) + 1
        first = np.zeros(kinds, np.int64)
        first[group[::-1]] = np.arange(size)[::-1]
        if max_terms == 1:
            suffix = terms
        else:
            parts = [pc.take(terms, pa.array(codes[np.minimum(first + i, size - 1)], mask=ends[first] <= i)) for i in range(max_terms)]
            suffix = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
        counts = [np.bincount(group, minlength=kinds), *(np.bincount(group, new, kinds) for new in records)]
        return pa.Table.from_arrays([suffix, *(pa.array(c.astype(np.int64)) for c in counts)], schema=schema)

    def merged(tables: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(tables).group_by("suffix").aggregate([(n, "sum") for n in names])
        return summed.select(["suffix", *(f"{n}_sum" for n in names)]).rename_columns(["suffix", *names])

    def run(batches: Iterator) -> Iterator:
        held, rows, texts_seen = [], 0, 0
        for batch in batches:
            texts = batch.column("text")
            texts_seen += len(texts) - texts.null_count
            table = of_batch(texts)
            held.append(table)
            rows += table.num_rows
            if rows > HELD_ROWS:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, rows = [], 0
        # The empty suffix stands for the records themselves.
        held.append(pa.Table.from_arrays([pa.array([""], pa.large_string()), *(pa.array([texts_seen]) for _ in names)], schema=schema))
        yield from merged(held).to_batches(max_chunksize=20_000)

    return run


def _stack_pass(max_terms: int):
    import pyarrow as pa

    schema = pa.schema([("ngram", pa.string()), ("num_terms", pa.int32()), ("df", pa.int64()), ("cf", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        path: list[str] = []
        counts: list[list[int]] = []
        done: list[tuple[str, int, int, int]] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                records, occurrences = counts.pop()
                done.append((" ".join(path), len(path) if path != [""] else 0, records, occurrences))
                path.pop()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("suffix", "occurrences", *(f"records_{n}" for n in range(1, max_terms + 1)))]
            for suffix, occurrences, *records in zip(*columns, strict=True):
                terms = suffix.split(" ")
                shared = 0
                while shared < min(len(path), len(terms)) and path[shared] == terms[shared]:
                    shared += 1
                close(shared)
                for term in terms[shared:]:
                    path.append(term)
                    counts.append([0, 0])
                for held, record in zip(counts, records, strict=False):
                    held[0] += record
                    held[1] += occurrences
            if len(done) > 20_000:
                yield flush()
        close(0)
        if done:
            yield flush()

    return run


def ngram_counts(texts: DataFrame, max_terms: int = 1) -> DataFrame:
    """(ngram, num_terms, df, cf) of every run of 1 to max_terms tokens, terms joined by a blank.

    texts: one row a record, column text; others are ignored. Equal texts count as often as they come. A null text is
    no record, an empty one is a record without terms. The row with ngram '' and num_terms 0 holds the number of
    records; over empty input it is 0 or missing.
    """
    counted = [f"records_{n}" for n in range(1, max_terms + 1)]
    partial = texts.select("text").mapInArrow(_partial_counts(max_terms), "suffix string, occurrences long, " + ", ".join(f"{c} long" for c in counted))
    routed = partial.withColumn("__first", F.substring_index("suffix", " ", 1))
    keys = ["__first"]
    if max_terms > 1:
        spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        second = F.when(F.instr("suffix", " ") > 0, F.split_part("suffix", F.lit(" "), F.lit(2)))
        routed = routed.withColumn("__spread", F.coalesce(F.pmod(F.xxhash64(second), F.lit(spread)), F.lit(0)))
        keys.append("__spread")
    ordered = routed.repartition(*keys).sortWithinPartitions(F.desc("suffix")).select("suffix", "occurrences", *counted)
    grams = ordered.mapInArrow(_stack_pass(max_terms), "ngram string, num_terms int, df long, cf long")
    return grams if max_terms == 1 else grams.groupBy("ngram", "num_terms").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def review_ngrams(reviews: DataFrame, max_terms: int = 1) -> DataFrame:
    """ngram_counts() of the texts of reviews, each doc_id once."""
    return ngram_counts(distinct_reviews(reviews, ["text"]), max_terms)


def num_records(counts: DataFrame):
    """The number of records in ngram_counts() as a scalar column."""
    return counts.where("num_terms = 0").agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()


def marked(counts: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """counts with mark: 'rare' in fewer than rare_below records, 'common' in more than that share of them, else null.

    Where both hold, 'rare' wins. Give a counts table that is cut from its plan, as it is read twice.
    """
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.lit(common_above) * num_records(counts), "common")
    return counts.where("num_terms > 0").withColumn("mark", mark)

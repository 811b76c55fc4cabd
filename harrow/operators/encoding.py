"""Views of the index as the classic codecs see it: gaps, byte sizes, front coding, record lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.codecs import byte_length, group_varint_decode_rows, group_varint_encode_rows, group_varint_total
from harrow.functions.text import common_prefix_length
from harrow.operators.index import number_terms, posting_batches
from harrow.operators.ordering import previous_in_group


def posting_gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap): doc_id minus the one before in the term's list, 0 before the first."""
    before = previous_in_group(postings.select("term", "doc_id", "tf"), "term", "doc_id")
    return before.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("previous", F.lit(0))).alias("gap"))


def group_varint_sizes(gaps: DataFrame) -> DataFrame:
    """(term, num_bytes) of each posting list as gap, tf, gap, tf, ... in group varint."""
    size = F.sum(byte_length(F.col("gap")) + byte_length(F.col("tf")))
    return gaps.groupBy("term").agg(group_varint_total(2 * F.count("*"), size).alias("num_bytes"))


def front_coding(dictionary: DataFrame, block: int = 4) -> DataFrame:
    """(term_index, term, block_pos, prefix_length, suffix_length): the prefix is shared with the term before in its block.

    Terms are numbered here where the dictionary has no term_index.
    """
    placed = dictionary.select("term", "term_index") if "term_index" in dictionary.columns else number_terms(dictionary.select("term"))
    number = F.col("term_index")
    blocked = placed.withColumn("__block", F.floor(number / block))
    before = F.lag("term").over(Window.partitionBy("__block").orderBy("term_index"))
    kept = blocked.withColumn("prefix_length", F.coalesce(common_prefix_length(F.col("term"), before), F.lit(0)))
    return kept.select("term_index", "term", (number % block).cast("int").alias("block_pos"), "prefix_length", (F.length("term") - F.col("prefix_length")).alias("suffix_length"))


def term_length_records(dictionary: DataFrame) -> DataFrame:
    """(term, num_chars) of the terms that are longer than every term before them in byte order.

    Such a term is the first of its length, and all terms at least as long come later: one row for each length decides.
    """
    first = dictionary.groupBy(F.length("term").alias("num_chars")).agg(F.min("term").alias("term"))
    longer = Window.orderBy(F.desc("num_chars")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each length
    later = F.min("term").over(longer)
    return first.withColumn("__next", later).where(F.col("__next").isNull() | (F.col("term") < F.col("__next"))).select("term", "num_chars")


#: Ids of one byte string of encoded_postings(): lists of any length come in rows of bounded size.
BYTE_BLOCK = 1 << 16
#: Ids that are shuffled together, a multiple of BYTE_BLOCK: a task holds the postings of one term in such a span.
SPAN = 1 << 20
#: Postings of one shuffled run at most, and those that a task holds before it makes runs or bytes of them.
RUN, HELD = 256, 2_000_000
_RUNS = "term string, span long, ids binary, tf binary"


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary array of values that lie one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _content(column: pa.Array) -> tuple[memoryview | bytes, np.ndarray]:
    """The bytes of all values of a binary array and the size of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return (memoryview(data)[int(offsets[0]) : int(offsets[-1])] if data is not None else b""), np.diff(offsets).astype(np.int64)


def _runs(batches: Iterator) -> Iterator:
    """Arrow batches of postings as runs of one term and span in order of doc_id: gaps from the span's begin, and tf."""

    def of(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([b.select(["term", "doc_id", "tf"]) for b in held])
        encoded = table["term"].combine_chunks().dictionary_encode()
        code, ids, tf = encoded.indices.to_numpy(zero_copy_only=False), table["doc_id"].to_numpy().astype(np.int64), table["tf"].to_numpy()
        if tf.max() >= 1 << 32 or tf.min() < 1:
            raise ValueError("group varint holds integers from 1 to 2**32 - 1")
        order = np.lexsort((ids, code))
        code, ids, tf = code[order], ids[order], tf[order]
        span = ids // SPAN
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (span[1:] != span[:-1])))
        place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        first = np.flatnonzero(place % RUN == 0)
        gaps = np.diff(ids, prepend=0)
        gaps[first] = ids[first] - span[first] * SPAN
        sizes = 4 * np.diff(np.append(first, len(code)))
        terms = encoded.dictionary.take(pa.array(code[first]))
        return pa.RecordBatch.from_arrays([terms, pa.array(span[first]), _binary(gaps.astype("<u4").tobytes(), sizes), _binary(tf.astype("<u4").tobytes(), sizes)], ["term", "span", "ids", "tf"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= HELD:
            yield of(held)
            held, rows = [], 0
    if held:
        yield of(held)


def _encode(batches: Iterator) -> Iterator:
    """Byte rows of runs that come sorted by term and span. Only whole spans of a term are encoded; the last one waits."""

    def of(table: pa.Table) -> Iterator:
        table = table.combine_chunks()
        terms, span = table["term"].combine_chunks(), table["span"].to_numpy()
        raw, sizes = _content(table["ids"].combine_chunks())
        runs, size = np.arange(len(sizes)), sizes // 4
        gaps, tf = np.frombuffer(raw, "<u4").astype(np.int64), np.frombuffer(_content(table["tf"].combine_chunks())[0], "<u4")
        first = np.cumsum(size) - size
        total = np.cumsum(gaps)
        ids = total + np.repeat(span * SPAN - (total[first] - gaps[first]), size)
        code = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        run = np.repeat(runs, size)
        order = np.lexsort((ids, code[run]))
        ids, tf, run = ids[order], tf[order], run[order]
        block, code = ids // BYTE_BLOCK, code[run]
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
        gaps = np.diff(ids, prepend=0)
        gaps[begins] = 1
        counts = np.diff(np.append(begins, len(ids)))
        numbers = np.stack([gaps, tf], axis=1).ravel()
        for rows in _stretches(counts, 500_000):
            at, end = begins[rows.start], begins[rows.start] + counts[rows].sum()
            data, sizes = group_varint_encode_rows(numbers[2 * at : 2 * end], 2 * counts[rows])
            firsts = begins[rows]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(run[firsts])), pa.array(block[firsts]), pa.array(ids[firsts]), _binary(data.tobytes(), sizes)], ["term", "block", "first_id", "data"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(_content(batch.column("ids"))[0]) // 4
        if size < HELD:
            continue
        table = pa.Table.from_batches(held)
        last = (table["term"][-1], table["span"][-1])
        span, same = table["span"].to_numpy() == last[1].as_py(), pc.equal(table["term"], last[0]).to_numpy()
        whole = int(np.flatnonzero(~(span & same))[-1]) + 1 if not (span & same).all() else 0
        if whole:
            yield from of(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        size = sum(len(_content(b.column("ids"))[0]) // 4 for b in held)
    if held:
        yield from of(pa.Table.from_batches(held))


def _stretches(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that hold up to about `most` postings each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // most)) + 1
    bounds = [0, *cuts.tolist(), len(counts)]
    return (slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


def _decode(batches: Iterator) -> Iterator:
    for batch in batches:
        raw, sizes = _content(batch.column("data"))
        upto = np.append(0, np.cumsum(sizes))
        for rows in _stretches(sizes, 1_000_000):
            numbers, counts = group_varint_decode_rows(bytes(raw[upto[rows.start] : upto[rows.stop]]), sizes[rows])
            counts //= 2
            total, begins = np.cumsum(numbers[::2]), np.cumsum(counts) - counts
            first = batch.column("first_id").to_numpy()[rows]
            ids, tf = total + np.repeat(first - total[begins], counts), numbers[1::2]
            of_row = np.repeat(np.arange(rows.start, rows.stop), counts)
            for at in range(0, len(ids), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(of_row[part])), pa.array(ids[part]), pa.array(tf[part])], ["term", "doc_id", "tf"])


def _encoded(runs: DataFrame) -> DataFrame:
    together = runs.repartition("term", "span").sortWithinPartitions("term", "span")
    return together.mapInArrow(_encode, "term string, block long, first_id long, data binary")


def encoded_postings(postings: DataFrame) -> DataFrame:
    """(term, block, first_id, data): posting lists in group varint as gap, tf, gap, tf, ..., in blocks of doc_id.

    first_id is the doc_id of the block's first posting, whose gap is written as 1; so a block decodes on its own, and
    gaps follow from the ids of the block. Postings travel as runs of one term, as a few bytes each, and a task holds
    those of one term in SPAN ids, or about HELD of several. postings: (term, doc_id, tf), doc_id once a term.
    """
    return _encoded(postings.select("term", "doc_id", "tf").mapInArrow(_runs, _RUNS))


def encoded_reviews(reviews: DataFrame) -> DataFrame:
    """encoded_postings() of the texts of reviews (doc_id, each once, and text), whose postings make no rows."""
    return _encoded(reviews.select("doc_id", "text").mapInArrow(lambda batches: _runs(posting_batches(batches)), _RUNS))


def decoded_postings(encoded: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of encoded_postings()."""
    return encoded.mapInArrow(_decode, "term string, doc_id long, tf long")


def front_decoded(coded: DataFrame, block: int = 4) -> DataFrame:
    """(term_index, term) from (term_index, block_pos, prefix_length, suffix): a fold over the few terms of each block."""
    entry = F.struct("block_pos", "prefix_length", "suffix")
    grouped = coded.groupBy(F.floor(F.col("term_index") / block).alias("__block")).agg(F.sort_array(F.collect_list(entry)).alias("__e"))

    def add(terms, e):
        return F.concat(terms, F.array(F.concat(F.substr(F.coalesce(F.try_element_at(terms, F.lit(-1)), F.lit("")), F.lit(1), e["prefix_length"]), e["suffix"])))

    folded = grouped.select("__block", F.posexplode(F.aggregate("__e", F.array().cast("array<string>"), add)).alias("__pos", "term"))
    return folded.select((F.col("__block") * block + F.col("__pos")).alias("term_index"), "term")

"""Postings on their way into order: packed into short runs of one term, shuffled as bytes, and unpacked where they lie.

A run holds up to RUN postings of a term as three arrays of the narrowest width that fits: gaps of doc_id, tf, length.
So a shuffle moves a few bytes for each posting instead of a row, and sorts runs instead of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from harrow.plans.durable import cut

#: Postings of one run at most: range partitions are balanced by runs, so they differ in postings by this factor at most.
RUN = 128
#: Postings that a task holds before it packs them, and of one term before it hands them on in order.
HELD = 2_000_000
NAMES = ["term", "doc_id", "tf", "num_tokens"]


def _narrow(values) -> bytes:
    import numpy as np

    kind = np.min_scalar_type(int(values.max()))
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _pack(batches: Iterator, most: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def runs_of(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        encoded = table["term"].combine_chunks().dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False)
        ids, tf, length = (table[n].to_numpy() for n in NAMES[1:])
        bits = int(ids.max()).bit_length()
        whole = bits + int(code.max()).bit_length() < 63  # one key sorts several times faster than two
        order = np.argsort((code.astype(np.int64) << bits) | ids) if whole else np.lexsort((ids, code))
        code, ids, tf, length = code[order], ids[order], tf[order], length[order]
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        first = np.flatnonzero(place % RUN == 0)
        gaps = np.diff(ids, prepend=0)
        gaps[first] = 0
        ends = np.append(first[1:], len(code))
        data = [_narrow(gaps[a:b]) + _narrow(tf[a:b]) + _narrow(length[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        columns = [encoded.dictionary.take(pa.array(code[first])), pa.array(ids[first]), pa.array((ends - first).astype(np.int32)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["term", "first_id", "size", "data"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            yield runs_of(held)
            held, rows = [], 0
    if held:
        yield runs_of(held)


def _unpack(batches: Iterator, most: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def arrays(size: int, data: bytes) -> list:
        out, at = [], 0
        for _ in range(3):
            width = data[at]
            out.append(np.frombuffer(data, f"<u{width}", size, at + 1).astype(np.int64))
            at += 1 + width * size
        return out

    def ordered(term: str, runs: list) -> Iterator:
        ids, tf, length = (np.concatenate(c) for c in zip(*runs, strict=True))
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), 100_000):
            part = order[at : at + 100_000]
            yield pa.array([term] * len(part), pa.string()), ids[part], tf[part], length[part]

    def batch_of(parts: list) -> pa.RecordBatch:
        terms = pa.concat_arrays([p[0] for p in parts])
        return pa.RecordBatch.from_arrays([terms, *(pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3))], NAMES)

    term, runs, size, ready, waiting = None, [], 0, [], 0
    for batch in batches:
        for name, first, count, data in zip(*(batch.column(c).to_pylist() for c in ("term", "first_id", "size", "data")), strict=True):
            if runs and (name != term or size >= most):
                for part in ordered(term, runs):
                    ready.append(part)
                    waiting += len(part[1])
                    if waiting >= 100_000:
                        yield batch_of(ready)
                        ready, waiting = [], 0
                runs, size = [], 0
            gaps, tf, length = arrays(count, data)
            term = name
            runs.append((first + np.cumsum(gaps), tf, length))
            size += count
    if runs:
        ready += ordered(term, runs)
    if ready:
        yield batch_of(ready)


def packed(posted: DataFrame, held: int = HELD) -> DataFrame:
    """(term, first_id, size, data): runs of postings (term, doc_id, tf, num_tokens), cut from their plan.

    posted: without nulls, doc_id and tf from 1, num_tokens not negative.
    """
    return cut(posted.select(*NAMES).mapInArrow(lambda batches: _pack(batches, held), "term string, first_id long, size int, data binary"))


def in_order(runs: DataFrame, held: int = HELD) -> DataFrame:
    """(term, doc_id, tf, num_tokens) of packed() in range partitions of the term, each in order of the term.

    Within a term rows come in order of doc_id, in stretches of `held` postings; a term that holds many postings takes
    several partitions.
    """
    ranged = runs.repartitionByRange("term", "first_id").sortWithinPartitions("term", "first_id")
    return ranged.mapInArrow(lambda batches: _unpack(batches, held), "term string, doc_id long, tf long, num_tokens long")

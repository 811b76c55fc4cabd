"""Passages of evaluation items inside documents, whole or in part.

Documents and items are cut into windows of words at every position; a window's SimHash has 64 bits. Fingerprints are
compared within a Hamming radius of 3 by four blocks of 16 bits, of which one must be equal, so no pair within the radius
is lost. The exact similarity of weighted five-word shingles then drops pairs that share only common wording, and an
alignment of the words gives passage and edits.

Windows are as long as the run of words that every wanted passage must keep intact: of m words with at most e = m / 10
changed or missing, some run between two edits has at least (m - e) / (e + 1) words; the least over all m counts. Items of
up to 8 words, whose passages have no edits and may lack a shingle, have narrow windows of their own and no shingle test. Windows as long as an item would
miss partial copies, whose fingerprints are far from the item's.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.ordering import running_sum
from harrow.plans.durable import cut

BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 3
SHINGLE = 5
#: Items go to the executors in groups of at most this many words; each group reads the documents once.
GROUP_WORDS = 400_000
#: Words whose windows are fingerprinted at once.
CHUNK = 60_000
#: Part of an item that a passage must hold, and part of the passage that may be changed or missing.
LEAST_SHARE, MOST_EDITS = 0.5, 0.1
#: Least weighted part of an item's shingles to go on: a half of a long item of which every tenth word is changed keeps
#: 0.2 and more. Short items need less, see least_shingles().
LEAST_SHINGLES = 0.12


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 ones and minus ones for each hash."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def fingerprints(words: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of `width` words (codes into table, rows of signs()); none for shorter texts."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    rows = table[words]
    total = rows[:count].astype(np.int16 if width > 127 else np.int8)
    for i in range(1, width):
        total += rows[i : i + count]
    return np.packbits(total > 0, axis=1).view(">u8").astype(np.uint64).reshape(-1)


def passages(length: int) -> list[tuple[int, int]]:
    """(words, most edits) of every passage of an item that counts."""
    return [(m, int(m * MOST_EDITS + 1e-9)) for m in range(max(1, int(np.ceil(length * LEAST_SHARE))), length + 1)]


def kept_run(length: int) -> int:
    """Words that every passage of an item of so many words keeps in one run."""
    return min(-(-(m - e) // (e + 1)) for m, e in passages(length))


def window_width(lengths: list[int]) -> int:
    """Words that every passage of any item keeps in one run, at most 16."""
    return min(16, min(map(kept_run, lengths), default=8))


def least_shingles(length: int) -> float:
    """Part of an item's shingles to go on: what the passage with the fewest keeps, at most LEAST_SHINGLES."""
    kept = min(max(0, m - SHINGLE + 1 - SHINGLE * e) for m, e in passages(length))
    return min(LEAST_SHINGLES, kept / max(1, length - SHINGLE + 1))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words."""
    count = len(hashes) - SHINGLE + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            out = (out ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class ItemIndex:
    """Items of one group: ids, word hashes, and the blocks of their windows' fingerprints."""

    ids: list[int]
    words: list[np.ndarray]
    width: int

    def build(self) -> ItemTables:
        prints, owner = [], []
        for i, w in enumerate(self.words):
            codes = np.unique(w, return_inverse=True)
            own = np.unique(fingerprints(codes[1], signs(codes[0]), self.width))
            prints.append(own)
            owner.append(np.full(len(own), i))
        values, owners = np.concatenate([np.zeros(0, np.uint64), *prints]), np.concatenate([np.zeros(0, int), *owner])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        distinct, first = np.unique(values, return_index=True)
        blocks = []
        for b in range(BLOCKS):
            part = _block(distinct, b)
            by_part = np.argsort(part, kind="stable")
            blocks.append((by_part, np.searchsorted(part[by_part], np.arange((1 << BLOCK_BITS) + 1))))
        cut = [np.unique(shingles(w)) for w in self.words]
        held, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *cut]), return_counts=True)
        weights = [1.0 / counts[np.searchsorted(held, c)] for c in cut]
        return ItemTables(self, distinct, np.append(first, len(owners)), owners, blocks, cut, weights)


def _block(values: np.ndarray, b: int) -> np.ndarray:
    return (values >> np.uint64(BLOCK_BITS * b)).astype(np.uint16).astype(np.int64)


@dataclass(frozen=True)
class ItemTables:
    items: ItemIndex
    prints: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]
    shingles: list[np.ndarray]
    weights: list[np.ndarray]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, place in self.prints) within RADIUS."""
        lefts, rights = [], []
        for b, (order, edges) in enumerate(self.blocks):
            part = _block(prints, b)
            count = edges[part + 1] - edges[part]
            left = np.repeat(np.arange(len(prints)), count)
            ends = np.cumsum(count)
            right = order[np.arange(len(left)) - np.repeat(ends - count, count) + np.repeat(edges[part], count)]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
            lefts.append(left[close])
            rights.append(right[close])
        return np.concatenate(lefts), np.concatenate(rights)

    def similarity(self, item: int, document: np.ndarray) -> float:
        """Weighted part of an item's shingles that a document holds (sorted distinct shingles); 1 / items that share one."""
        own, weight = self.shingles[item], self.weights[item]
        at = np.minimum(np.searchsorted(document, own), max(0, len(document) - 1))
        return float(weight[document[at] == own].sum() / weight.sum()) if len(document) and len(own) else 0.0


def align(item: np.ndarray, document: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of words: (first and last+1 word of the item, of the document, equal words)."""
    rows, columns = len(item), len(document)
    score = np.zeros((rows + 1, columns + 1), np.int32)
    steps = np.arange(columns + 1)
    for i in range(rows):
        row = np.maximum(0, score[i] - 1)
        row[1:] = np.maximum(row[1:], score[i, :-1] + np.where(document == item[i], 1, -1))
        score[i + 1] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    item_end, document_end, equal = int(i), int(j), 0
    while i and j and score[i, j]:
        same = item[i - 1] == document[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (1 if same else -1):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return int(i), item_end, int(j), document_end, equal


def close_span(item: np.ndarray, document: np.ndarray) -> tuple[float, int, int] | None:
    """The longest run of the item's words, at least the least share, that the document holds with few enough edits.

    As holds(), over every run of the item and not only the best alignment; words added in between are edits too. A run
    begins and ends with words that are held, so one word may lack to the least share where edits are allowed. Runs of
    which too many words are nowhere in the document are left out first, as no order of words could make them close.
    """
    size, columns = len(item), len(document)
    least = max(1, int(np.ceil(size * LEAST_SHARE)))
    least -= least * MOST_EDITS >= 1
    absent = np.append(0, np.cumsum(~np.isin(item, document)))
    over = absent - MOST_EDITS * np.arange(size + 1)
    below = np.minimum.accumulate(over[::-1])[::-1]
    best, shift = None, np.int64(columns + 1)
    steps = np.arange(columns + 1) * shift
    for start in np.flatnonzero(below[least:] <= over[: size + 1 - least] + 1e-9).tolist():
        if best and size - start <= best[0]:
            break
        state = np.arange(columns + 1, dtype=np.int64)  # edits * shift + first word in the document
        for end in range(start, size):
            same = document == item[end]
            ends = np.flatnonzero(same)
            span = end + 1 - start
            if len(ends) and span >= least and (best is None or span > best[0]):
                at = ends[state[ends].argmin()]
                edits, low = divmod(int(state[at]), int(shift))
                if edits <= MOST_EDITS * span + 1e-9:
                    best = (span, low, int(at) + 1)
            changed = shift * (size + 1) if end == start else shift
            row = state + changed
            row[1:] = np.minimum(row[1:], state[:-1] + np.where(same, 0, changed))
            state = np.minimum.accumulate(row - steps) + steps
            if state.min() // shift > MOST_EDITS * (size - start) + 1e-9:
                break
    return best and (best[0] / size, best[1], best[2])


def holds(item: np.ndarray, document: np.ndarray) -> tuple[float, int, int] | None:
    """(part of the item, first and last+1 word in the document) of a passage long and close enough.

    Items without a run of SHINGLE words in each passage are searched exactly. In others, the best alignment may run over edits around a passage that is close enough without them, or lie elsewhere; where it
    fails, close_span() looks for such a passage.
    """
    if kept_run(len(item)) < SHINGLE:
        return close_span(item, document)
    start, end, low, high, equal = align(item, document)
    span = end - start
    if span and span + 1 >= len(item) * LEAST_SHARE and equal + 1 >= span * (1 - MOST_EDITS):
        return span / len(item), low, high
    return close_span(item, document)


def best_passage(item: np.ndarray, document: np.ndarray, hits: np.ndarray) -> tuple[float, int, int] | None:
    """The largest passage near the given word places, of equal ones the first.

    A passage reaches at most two item lengths from a hit, so stretches of eight lengths that overlap by four hold each
    one whole; a long document is never aligned as a whole.
    """
    size, best = len(item), None
    for stretch in sorted({int(h) // (4 * size) for h in hits}):
        low = max(0, (stretch * 4 - 2) * size)
        if found := holds(item, document[low : (stretch * 4 + 6) * size]):
            if best is None or found[0] > best[0]:
                best = (found[0], found[1] + low, found[2] + low)
            if best[0] == 1:
                break
    return best


def item_groups(items: DataFrame, group_words: int) -> DataFrame:
    """(item_id, hashes, kind, number): the items with their word hashes as bytes, in groups (kind, number) of at most
    group_words words and one item. kind: the run of words that passages keep, up to SHINGLE; short items would narrow
    the windows of all. Items without words are left out, of repeated rows one stays.
    """
    import pyarrow as pa

    from harrow.functions.batches import tokens

    def run(batches):
        for batch in batches:
            words, rows = tokens(batch.column("text"))
            hashes = word_hashes(words.to_pylist())
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            held = [i for i in range(batch.num_rows) if bounds[i + 1] > bounds[i]]
            cut = [hashes[bounds[i] : bounds[i + 1]] for i in held]
            kinds = [min(SHINGLE, kept_run(len(c))) for c in cut]
            columns = [batch.column("item_id").take(pa.array(held, pa.int64())), pa.array([c.tobytes() for c in cut], pa.binary()), pa.array([len(c) for c in cut], pa.int64()), pa.array(kinds, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "hashes", "size", "kind"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    coded = texts.mapInArrow(run, "item_id long, hashes binary, size long, kind int")
    summed = running_sum(coded, ["kind"], [F.col("item_id"), F.col("hashes")], "size", "upto")
    return cut(summed.select("item_id", "hashes", "kind", F.floor((F.col("upto") - F.col("size")) / group_words).alias("number")))


def leaked(documents: DataFrame, items: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, item_id, share, first_word, last_word) of each item and document that holds a passage of it.

    documents: doc_id, text; items: item_id, text; other columns are ignored. A passage is at least half of the item's
    words in their order, of which up to one in ten may be changed or missing. Words are lower-cased runs of ASCII
    letters and digits. Null and empty texts hold and are nothing. share: part of the item's words; first_word and
    last_word count the document's words from 0. Items go out in groups of bounded size; documents are never shuffled.
    """
    import pyarrow as pa

    from harrow.functions.batches import coded

    context, groups = documents.sparkSession.sparkContext, []
    grouped = item_groups(items, group_words)
    for kind, number in sorted((r["kind"], r["number"]) for r in grouped.select("kind", "number").distinct().collect()):
        rows = grouped.where((F.col("kind") == kind) & (F.col("number") == number)).orderBy("item_id").select("item_id", "hashes").collect()
        words = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        groups.append(context.broadcast(([r["item_id"] for r in rows], words, window_width([len(w) for w in words]))))

    def search(sent):
        def run(batches):
            index = ItemIndex(*sent.value).build()
            width = index.items.width
            least = [least_shingles(len(w)) for w in index.items.words]
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    out = []
                    terms, codes, owner = coded(part.column("text"))
                    known = word_hashes(terms.to_pylist())
                    table, found = signs(known), []
                    for begin in range(0, len(codes), CHUNK):
                        stretch = codes[begin : begin + CHUNK + width - 1]
                        prints = fingerprints(stretch, table, width)
                        places = begin + np.flatnonzero(owner[begin : begin + len(prints)] == owner[begin + width - 1 : begin + width - 1 + len(prints)])
                        left, right = index.near(prints[places - begin])
                        # Every item that has the window: wording of many items gives a hit for each of them.
                        places, counts = places[left], index.first[right + 1] - index.first[right]
                        ends = np.cumsum(counts)
                        item = index.owners[np.arange(counts.sum()) - np.repeat(ends - counts, counts) + np.repeat(index.first[right], counts)]
                        places = np.repeat(places, counts)
                        pair = owner[places] * len(index.items.ids) + item
                        found.append(pair * len(codes) + places)
                    hits = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))  # by document, item and place
                    pairs = hits // max(1, len(codes))
                    begins = np.flatnonzero(np.diff(pairs, prepend=-1))
                    ends = np.append(begins[1:], len(hits))[: len(begins)]
                    edges = np.searchsorted(owner, np.arange(part.num_rows))
                    edges = np.append(edges, len(codes))
                    cut: dict[int, np.ndarray] = {}
                    for first, last in zip(begins.tolist(), ends.tolist(), strict=True):
                        document, item = divmod(int(pairs[first]), len(index.items.ids))
                        begin, near = edges[document], hits[first:last] % len(codes)
                        own = known[codes[begin : edges[document + 1]]]
                        if document not in cut:
                            cut = {document: np.unique(shingles(own))}
                        if index.similarity(item, cut[document]) >= least[item]:
                            if passage := best_passage(index.items.words[item], own, near - begin):
                                out.append((document, index.items.ids[item], *passage))
                    columns = list(zip(*out, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())],
                        ["doc_id", "item_id", "share", "first_word", "last_word"],
                    )

        return run

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, share double, first_word int, last_word int"
    if not groups:
        return documents.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, (documents.select("doc_id", "text").mapInArrow(search(sent), schema) for sent in groups))

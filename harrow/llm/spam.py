"""Pages of strung-together keywords, links or tags: bagged decision trees on content and link features.

No word list is built in. A first pass counts the words of each language as labelled: the commonest ones that make up half
of the running text of pages that look fair are its connecting words, words of one page in two hundred are known words. Where fewer than KNOWN_SHARE of the words of a text are known, its language has no model here, and what rests on
connecting words abstains.

Weak labels come from the links, tags, separators, repeated triples, connecting words and the commonest word of whole pages
and abstain where these are unclear; the trees see other features, so they cannot learn the rule again. The rate of spam on a page's host then moves the odds of
pages that the trees leave open. Features are parts of the page, so they do not depend on its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.mixing import source_key
from harrow.plans.durable import cut

#: What the trees see.
FEATURES = ("loose", "piece_distinct", "sentence_ends", "short_units", "unit_words")
#: What the weak labels see; known is the part of a page's different words that are known.
SURFACE = ("repeated_triples", "links", "tags", "separators", "commonest")
COLUMNS = (*FEATURES, *SURFACE, "connecting", "known")
#: Least part of known words for rules that rest on connecting words.
KNOWN_SHARE = 0.45
#: A language has a model from so many pages and from this part of all pages on.
LEAST_PAGES, LEAST_LANGUAGE = 20, 0.001
#: Part of a language's running text that is connecting words, and of its pages that hold a known word (three at least).
CONNECTING, KNOWN = 0.5, 0.005
_LINK = r"(?:https?://|www\.)\S+"
#: Typographic quotes, dashes and dots end a word as their ASCII forms do.
_SIGNS = "[\u2018\u2019\u201a-\u201f\u2013\u2014\u2026\u00a0\u3000-\u3002]"
#: Signs between the entries of lists on a line; they end a unit.
_BETWEEN = "[\u2039\u203a\u00ab\u00bb\u00b7\u2022\u2192]"
#: Signs of scripts that put no blanks between words.
_UNSPACED = "[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]"
#: Words of a piece of text that is judged at once; longer units without an end are judged piece by piece.
PIECE = 24
#: A link counts like so many letters of text.
LINK_LETTERS = 24
#: Pages that are looked at in one go.
PAGES = 1000
_WORD, _MARK, _END = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = _WORD
_KIND[1] = _MARK
_KIND[[2, 10, *b".!?"]] = _END
_IS_SEPARATOR = np.isin(np.arange(256), np.frombuffer(b"\x02|/,;", np.uint8))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each key, size of each key's group)."""
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    return group, size[group]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order; sorting beats hashing for so many."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


@dataclass(frozen=True)
class Lexicon:
    """Connecting words and known words, without regard to their language."""

    connecting: list[str]
    known: list[str]


@dataclass
class Words:
    """The words of a column of pages: code and row of each word or link, and their strings."""

    strings: pa.Array
    code: np.ndarray
    row: np.ndarray
    is_link: np.ndarray
    length: np.ndarray
    start: np.ndarray
    data: np.ndarray
    row_of_byte: np.ndarray
    link_bytes: np.ndarray
    rows: int


def split(texts: pa.Array) -> Words:
    """Words of pages, whole columns at once; signs of scripts without blanks are words of their own."""
    rows = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.replace_substring_regex(texts, pattern=_LINK, replacement=" \x01 ")
    kept = pc.binary_length(marked).to_numpy(zero_copy_only=False)
    whole = np.maximum(1, pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if pc.any(pc.match_substring_regex(marked, pattern=_UNSPACED)).as_py():
        marked = pc.replace_substring_regex(marked, pattern=f"({_UNSPACED})", replacement=r" \1 ")
    marked = pc.replace_substring_regex(marked, pattern=_BETWEEN, replacement="\x02")
    plain = pc.replace_substring_regex(pc.utf8_lower(marked), pattern=_SIGNS, replacement=". ").cast(pa.large_string())
    bounds = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + rows + 1] if rows else np.zeros(1, np.int64)
    raw = plain.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = _KIND[data]
    row_of_byte = np.repeat(np.arange(rows), np.diff(bounds))
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[bounds[:-1]] = True
    word = kind == _WORD
    start = np.flatnonzero((word & (np.concatenate(([True], ~word[:-1])) | starts_row[:-1])) | (kind == _MARK)) if len(data) else np.zeros(0, np.int64)
    last = (word & (np.concatenate((~word[1:], [True])) | starts_row[1:])) | (kind == _MARK)
    length = np.flatnonzero(last) + 1 - start
    offsets = np.append(0, np.cumsum(length)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[word | (kind == _MARK)].tobytes()))
    encoded = words.dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(encoded.dictionary, code, row_of_byte[start], kind[start] == _MARK, length, start, data, row_of_byte, np.maximum(0, 1 - kept / whole), rows)


def surface(w: Words, repeated: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """SURFACE of each page: parts of its words (of its bytes for links). repeated: words that begin a repeated triple,
    where they are known; else repeated_triples is 0."""
    count = np.maximum(1, np.bincount(w.row[~w.is_link], minlength=w.rows))
    per_row = lambda mask: np.bincount(w.row_of_byte[mask], minlength=w.rows).astype(float)
    width = len(w.strings) + 1
    keys, often = np.unique(w.row[~w.is_link] * width + w.code[~w.is_link], return_counts=True)
    commonest = np.zeros(w.rows)
    np.maximum.at(commonest, keys // width, often)
    return {
        "repeated_triples": np.zeros(w.rows) if repeated is None else np.bincount(w.row, repeated, w.rows) / count, "links": w.link_bytes,
        "tags": per_row(w.data == 35) / count, "separators": per_row(_IS_SEPARATOR[w.data]) / count,
        "commonest": np.where(count > 7, commonest / count, 0.0),
    }


def _triples(w: Words):
    width, same_row = len(w.strings) + 1, np.append(w.row[1:] == w.row[:-1], False)
    alone = -1 - np.arange(len(w.code))
    pair = _runs(np.where(same_row, (w.row * width + w.code) * width + np.append(w.code[1:], 0), alone))
    third = same_row & np.append(same_row[1:], False)
    return pair, third, _runs(np.where(third, pair[0] * width + np.append(w.code[2:], [0, 0])[: len(w.code)], alone))[1]


def looks_fair(found: dict[str, np.ndarray]) -> np.ndarray:
    """Whether no link, tag, separator or single word stands out: pages to learn words from."""
    _, li, ta, se, co = (found[s] for s in SURFACE)
    return (li < 0.15) & (ta < 0.06) & (se < 0.2) & (co < 0.15)


def weak_label(found: dict[str, np.ndarray]) -> np.ndarray:
    """1 where a page's signs are those of strung-together words, 0 where none of them shows, -1 between.

    Repeated triples count where connecting words are missing, which only a language with a model tells.
    """
    t, li, ta, se, co = (found[s] for s in SURFACE)
    modelled, connecting = found["known"] >= KNOWN_SHARE, found["connecting"]
    spam = (li > 0.45) | (ta > 0.4) | (se > 0.45) | (co > 0.2) | (modelled & (t > 0.15) & (connecting < 0.15))
    fair = looks_fair(found) & np.where(modelled, connecting > 0.25, t < 0.12)
    return np.where(spam, 1, np.where(fair, 0, -1))


def features(texts: pa.Array, lexicon: Lexicon | None = None) -> dict[str, np.ndarray]:
    """COLUMNS of pages, whole columns at once; 0 throughout for null and for pages without words.

    Text is cut into units at line ends and sentence ends, longer units into pieces of PIECE words. A piece is loose if
    an eighth of it are links, a third of it are tags, separators come two for five words, one content word comes three
    times and is an eighth of it, a third of its word pairs are content words that the page pairs four times or more, three
    short units in a row begin with the same two words, or fewer than 15 % of its words are connecting words. In pages of too few known words, the last rule abstains, pairs must
    come again in the same piece, and one word must come four times and be a quarter of it.
    """
    lexicon = lexicon or Lexicon([], [])
    w = split(texts)
    rows, code, row, is_link, start, kind = w.rows, w.code, w.row, w.is_link, w.start, _KIND[w.data]
    out = {f: np.zeros(rows) for f in COLUMNS}
    if not len(code):
        return out
    width = len(w.strings) + 1
    holds = lambda words: pc.is_in(w.strings, value_set=pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)[code]
    is_function, is_known = holds(lexicon.connecting), holds(lexicon.known)
    content = ~is_function & ~is_link
    by_row = lambda index, values: np.bincount(index, values, rows)
    count = np.maximum(1, by_row(row, ~is_link))
    # Each word once, so that a name strung along does not make a page one of an unknown language.
    kinds = _distinct((row * width + code)[~is_link])
    code_known = np.zeros(width, bool)
    code_known[code[is_known]] = True
    known = by_row(kinds // width, code_known[kinds % width]) / np.maximum(1, by_row(kinds // width, None))
    # Units: a new one with each row, line end and sentence end; consecutive numbers.
    breaks = np.cumsum(kind == _END)[start]
    fresh = np.concatenate(([True], (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(fresh)
    unit_size = np.diff(np.append(first, len(start)))
    place = np.arange(len(start)) - np.repeat(first, unit_size)
    new_piece = fresh | (place % PIECE == 0)
    piece = np.cumsum(new_piece) - 1
    edges = np.flatnonzero(new_piece)
    size = np.diff(np.append(edges, len(start)))
    total = lambda values: np.add.reduceat(values.astype(np.int64), edges)
    # Signs of a piece: those between its first word and the next piece's; a tag's sign stands before its word.
    marks = lambda mask, shift: np.bincount(np.clip(np.searchsorted(start[edges], np.flatnonzero(mask) + shift, side="right") - 1, 0, None), minlength=len(edges))
    pieces_tags, pieces_separators = marks(w.data == 35, 1), marks(_IS_SEPARATOR[w.data], 0)
    same_row = np.append(row[1:] == row[:-1], False)
    (_, pair_count), third, triple_count = _triples(w)
    in_piece = np.append(piece[1:] == piece[:-1], False)
    _, pair_again = _runs(np.where(in_piece, (piece * width + code) * width + np.append(code[1:], 0), -1 - np.arange(len(code))))
    stuffed = in_piece & np.where(known[row] >= KNOWN_SHARE, pair_count > 3, pair_again > 1) & content & np.append(content[1:], False)
    _, again = _runs(piece * width + code)
    top = np.maximum.reduceat(np.where(content, again, 0), edges)
    links = total(is_link)
    piece_row = row[edges]
    modelled = known[piece_row] >= KNOWN_SHARE
    loose = (links > 0) & (links * 8 >= size) | (pieces_tags * 3 >= size) | ((size > 3) & (pieces_separators * 5 >= size * 2)) | ((size > 1) & (total(stuffed) * 3 >= size - 1))
    loose |= (top >= np.where(modelled, 3, 4)) & (top * np.where(modelled, 8, 4) >= size)
    loose |= modelled & (total(is_function) < 0.15 * (size - links))
    # Short units one after the other with the same two words at their start.
    opening = np.where((unit_size > 1) & (unit_size < 9), (row[first] * width + code[first]) * width + code[np.minimum(first + 1, len(code) - 1)], -1 - np.arange(len(first)))
    series = np.cumsum(np.append(True, opening[1:] != opening[:-1])) - 1
    loose |= (np.bincount(series)[series] > 2)[np.cumsum(fresh)[edges] - 1]
    weight = total(np.where(is_link, LINK_LETTERS, w.length))
    seen = np.maximum(1, by_row(piece_row, weight))
    piece_kinds = _distinct(piece * width + code) // width
    per_row = lambda mask: np.bincount(w.row_of_byte[mask], minlength=rows).astype(float)
    units = np.maximum(1, np.bincount(row[first], minlength=rows))
    out |= surface(w, third & (triple_count > 1)) | {
        "loose": by_row(piece_row, weight * loose) / seen, "connecting": by_row(row, is_function) / count, "piece_distinct": by_row(piece_row[piece_kinds], None) / np.maximum(1, by_row(row, None)),
        "sentence_ends": per_row((kind == _END) & (w.data > 10)) / count,
        "short_units": by_row(row[first], unit_size < 4) / units, "unit_words": np.minimum(30, count / units), "known": known,
    }
    empty = np.bincount(row, minlength=rows) == 0
    for values in out.values():
        values[empty] = 0.0
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """(language, word, df, cf): pages with the word, and its occurrences in pages that look fair; the word '' counts all
    pages and all words of fair ones.

    language: the first two letters of lang, lower-cased; '' for null or where there is no such column.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                w = split(part.column("text"))
                fair = looks_fair(surface(w))
                language = part.column("language").dictionary_encode()
                names, of_row = language.dictionary, language.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                width, row, code = len(w.strings) + 1, w.row[~w.is_link], w.code[~w.is_link]
                pairs, often = np.unique(row * width + code, return_counts=True)
                keys, place, df = np.unique(of_row[pairs // width] * width + pairs % width, return_inverse=True, return_counts=True)
                cf = np.bincount(place, often * fair[pairs // width], len(keys))
                pages, all_words = np.bincount(of_row, minlength=len(names)), np.bincount(of_row[row], fair[row], len(names))
                words = pa.concat_arrays([w.strings.take(pa.array(keys % width)).cast(pa.string()), pa.array([""] * len(names), pa.string())])
                languages = pa.concat_arrays([names.take(pa.array(keys // width)).cast(pa.string()), names.cast(pa.string())])
                counts = [pa.array(np.append(a, b).astype(np.int64)) for a, b in ((df, pages), (cf, all_words))]
                yield pa.RecordBatch.from_arrays([languages, words, *counts], ["language", "word", "df", "cf"])

    lang = F.lower(F.substring(F.trim("lang"), 1, 2)) if "lang" in documents.columns else F.lit(None).cast("string")
    counted = documents.select(F.coalesce(lang, F.lit("")).alias("language"), "text").mapInArrow(run, "language string, word string, df long, cf long")
    return counted.groupBy("language", "word").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def learned_lexicon(documents: DataFrame) -> Lexicon:
    """The words of the collection that pages are judged by.

    Its size does not grow with the collection: of a language, at most 1 / KNOWN times the mean number of distinct words of
    a page; of languages, at most 1 / LEAST_LANGUAGE.
    """
    counts = cut(word_counts(documents))
    pages = counts.where("word = ''").select("language", F.col("df").alias("n"), F.col("cf").alias("words"))
    total = pages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    modelled = pages.where(F.col("n") >= max(LEAST_PAGES, LEAST_LANGUAGE * total))
    # Spam may hold words of its own, which are known but connect nothing.
    kept = counts.where("word <> '' and df >= 3").join(F.broadcast(modelled), "language").where(F.col("df") >= KNOWN * F.col("n"))  # 1 / LEAST_LANGUAGE rows
    rows = kept.select("language", "word", "cf", "words").collect()
    connecting, upto = set(), {}
    for r in sorted(rows, key=lambda r: (-r["cf"], r["word"])):
        if upto.get(r["language"], 0) < CONNECTING * r["words"]:
            upto[r["language"]] = upto.get(r["language"], 0) + r["cf"]
            connecting.add(r["word"])
    return Lexicon(sorted(connecting), sorted({r["word"] for r in rows}))


def page_features(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, host, COLUMNS, label); host as mixing.source_key(), '' for null; label as weak_label(), null between."""
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                found = features(part.column("text"), sent.value)
                label = weak_label(found)
                columns = [*(pa.array(found[f]) for f in COLUMNS), pa.array(label.astype(float), mask=label < 0)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *columns], ["doc_id", "host", *COLUMNS, "label"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    host = F.coalesce(source_key(F.col("source")), F.lit("")).alias("host")
    return documents.select("doc_id", host, "text").mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{f} double" for f in (*COLUMNS, "label")))


def classify(documents: DataFrame, train_rows: int = 20_000, trees: int = 40, depth: int = 5, smoothing: float = 0.15, seed: int = 23) -> DataFrame:
    """(doc_id, probability, smoothed, spam) of all documents (doc_id, text, source, lang if it is there); other columns
    are ignored.

    train_rows bounds the weakly labelled rows of each class that fit the trees, chosen by hash; all rows are classified.
    smoothed: log-odds of the trees plus `smoothing` times the host's log-odds of mean probability less those of all
    pages. Null and empty texts are no spam. Where the rules label only one class, the rules' share of loose text
    decides (spam above one half).
    """
    pages = cut(page_features(documents, learned_lexicon(documents)))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = [pages.where(F.col("label") == v).orderBy(order, "doc_id").limit(train_rows) for v in (0.0, 1.0)]
    labelled = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(chosen[0].unionByName(chosen[1])).select("label", "x"))
    classes = labelled.groupBy("label").count().collect()
    if len(classes) < 2:
        scored = pages.withColumn("probability", F.col("loose"))
    else:
        forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed, maxBins=64).fit(labelled)
        scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(pages))
        scored = scored.withColumn("probability", vector_to_array("probability")[1])
    scored = scored.withColumn("probability", F.when(F.col("unit_words") + F.col("links") > 0, F.col("probability")).otherwise(0.0))
    scored = scored.select("doc_id", "host", F.col("probability").cast("double"))
    logit = lambda p: F.log(F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001)) / (1 - F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))))
    hosts = scored.groupBy("host").agg(F.sum("probability").alias("s"), F.count("*").alias("n"))
    overall = hosts.agg(F.sum("s") / F.sum("n")).scalar()
    rates = hosts.select("host", F.col("s").alias("__s"), F.col("n").alias("__n"))
    # A host's rate counts one overall page as seen, so small hosts stay near the rate of all.
    rate = (F.col("__s") + overall) / (F.col("__n") + 1)
    joined = scored.join(rates, "host")
    smoothed = 1 / (1 + F.exp(-(logit(F.col("probability")) + smoothing * (logit(rate) - logit(overall)))))
    return joined.select("doc_id", "probability", smoothed.alias("smoothed"), (smoothed > 0.5).alias("spam"))

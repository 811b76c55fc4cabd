"""Comma-separated records with located errors: a recursive-descent grammar that recovers after broken quotes.

Grammar (RFC 4180, LF or CR LF between the records of a file):

    file    = record *(line-end record)
    record  = field *("," field)
    field   = quoted / plain
    quoted  = DQUOTE *(any but DQUOTE / 2DQUOTE) DQUOTE
    plain   = *(any but DQUOTE, ",", line end)

After a quoting error the parser resumes at the next validated record start. Where the starts of records are known, as in
tables with one record a row, those are the starts, and no field reaches over one. In whole files it is a line start from
which a record of four fields parses with helpfulness or score in place; what lies between belongs to the broken record.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.operators.ordering import running_sum

#: Reasons in the order in which they apply.
REASONS = ("quoting", "columns", "helpfulness", "score")
_PLAIN = re.compile(r'[^",\r\n]*')
_PLAIN_ROW = re.compile(r'[^",]*')
_QUOTED = re.compile(r'"((?:[^"]|"")*)"', re.DOTALL)
_VOTES = re.compile(r"([0-9]+)/([0-9]+)")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_LINE_END = re.compile(r"\r\n|\n|\r")


class QuotingError(ValueError):
    def __init__(self, position: int) -> None:
        super().__init__(position)
        self.position = position


@dataclass(frozen=True)
class Parsed:
    """A record: its place (start, end) and its values, or the reason of failure and the place of the fault.

    helpfulness: the votes as written, without blanks around.
    """

    start: int
    end: int
    product_id: str | None = None
    helpfulness: str | None = None
    helpfulness_num: int | None = None
    helpfulness_den: int | None = None
    score: float | None = None
    text: str | None = None
    reason: str | None = None
    position: int | None = None


class RecordParser:
    """Recursive descent over one text. single=True: line breaks in plain fields belong to the record, which ends at the
    limit only."""

    def __init__(self, source: str, single: bool = False) -> None:
        self.source = source
        self.single = single
        self.plain = _PLAIN_ROW if single else _PLAIN
        self.limit = len(source)

    def field(self, at: int) -> tuple[str, int]:
        source, limit = self.source, self.limit
        if source.startswith('"', at, limit):
            match = _QUOTED.match(source, at, limit)
            if not match:
                raise QuotingError(at)
            end = match.end()
            if end < limit and source[end] != "," and (self.single or source[end] not in "\r\n"):
                raise QuotingError(end)
            return match[1].replace('""', '"'), end
        end = self.plain.match(source, at, limit).end()
        if source.startswith('"', end, limit):
            raise QuotingError(end)
        return source[at:end], end

    def record(self, at: int) -> tuple[list[tuple[str, int]], int]:
        fields = []
        while True:
            value, end = self.field(at)
            fields.append((value, at))
            if not self.source.startswith(",", end, self.limit):
                return fields, end
            at = end + 1

    def typed(self, start: int, fields: list[tuple[str, int]], end: int) -> Parsed:
        if len(fields) != 4:
            return Parsed(start, end, reason="columns", position=fields[min(4, len(fields) - 1)][1])
        (product, _), (votes, votes_at), (number, number_at), (text, _) = fields
        votes, number = votes.strip(), number.strip()
        pair = _VOTES.fullmatch(votes)
        if not pair or not _at_most(pair[1], pair[2]):
            return Parsed(start, end, reason="helpfulness", position=votes_at)
        if not _NUMBER.fullmatch(number) or not 1 <= Decimal(number) <= 5:
            return Parsed(start, end, reason="score", position=number_at)
        return Parsed(start, end, product.strip(), votes, int(pair[1]), int(pair[2]), float(number), text)

    def anchor(self, after: int) -> int:
        """The next line start from which a record of four fields parses with votes or a score in place, whether or not
        its values are valid; the end of the text if there is none."""
        for line in _LINE_END.finditer(self.source, after):
            try:
                fields, _ = self.record(line.end())
            except QuotingError:
                continue
            if len(fields) == 4 and (_VOTES.fullmatch(fields[1][0].strip()) or _NUMBER.fullmatch(fields[2][0].strip())):
                return line.end()
        return len(self.source)

    def file(self) -> Iterator[Parsed]:
        """The records of a whole file."""
        at, size = 0, len(self.source)
        while at < size:
            try:
                fields, end = self.record(at)
                yield self.typed(at, fields, end)
                line = _LINE_END.match(self.source, end)
                at = line.end() if line else size
            except QuotingError as fault:
                resume = self.anchor(at)
                yield Parsed(at, resume, reason="quoting", position=fault.position)
                at = resume

    def known(self, starts: Iterable[tuple[int, int]]) -> Iterator[Parsed]:
        """The records at known places (start, end); after a fault the next start is the one to resume at."""
        for start, self.limit in starts:
            try:
                yield self.typed(start, *self.record(start))
            except QuotingError as fault:
                yield Parsed(start, self.limit, reason="quoting", position=fault.position)


def _at_most(a: str, b: str) -> bool:
    """Whether one run of digits is at most another, however long."""
    a, b = a.lstrip("0"), b.lstrip("0")
    return (len(a), a) <= (len(b), b)


def parse_row(raw: str | None) -> Parsed:
    """One record; null has no field and fails as `columns`."""
    return next(parse_known([raw]))


def parse_known(rows: list[str | None]) -> Iterator[Parsed]:
    """One result for each row, from one pass over their joined text; places count within the row."""
    ends = list(accumulate(len(r or "") + 1 for r in rows))
    starts = [end - len(r or "") - 1 for end, r in zip(ends, rows, strict=True)]
    parser = RecordParser("\n".join(r or "" for r in rows), single=True)
    for raw, start, parsed in zip(rows, starts, parser.known((s, e - 1) for s, e in zip(starts, ends, strict=True)), strict=True):
        if raw is None:
            yield Parsed(0, 0, reason="columns", position=0)
        else:
            yield replace(parsed, start=0, end=parsed.end - start, position=None if parsed.position is None else parsed.position - start)


PARSED = "product_id string, helpfulness string, helpfulness_num decimal(38,0), helpfulness_den decimal(38,0), score double, text string, reason string, position long"


def _columns(rows: list[Parsed], ids):
    import pyarrow as pa

    def big(n: int | None) -> Decimal | None:
        return None if n is None or n >= 10**38 else Decimal(n)

    kinds = {"helpfulness_num": pa.decimal128(38), "helpfulness_den": pa.decimal128(38), "score": pa.float64(), "position": pa.int64()}
    names = ["product_id", "helpfulness", "helpfulness_num", "helpfulness_den", "score", "text", "reason", "position"]
    values = lambda n: [big(getattr(r, n)) if n in ("helpfulness_num", "helpfulness_den") else getattr(r, n) for r in rows]
    return pa.RecordBatch.from_arrays([*ids, *(pa.array(values(n), kinds.get(n, pa.string())) for n in names)], ["rec_id", *names])


def parse_rows(raw_records: DataFrame) -> DataFrame:
    """rec_id and PARSED of a table (rec_id, raw) with one record a row; reason is null where the record is valid.

    The rows of a batch are one text whose record starts are known; a broken quote ends with its row. A null raw fails as
    `columns`; an empty one too, as it has one field. Failed rows have null values and the character position of the
    fault. Votes of more than 38 digits are whole in `helpfulness` and compared in full; as numbers they come as null.
    """

    def run(batches):
        for batch in batches:
            yield _columns(list(parse_known(batch.column("raw").to_pylist())), [batch.column("rec_id")])

    kind = raw_records.schema["rec_id"].dataType.simpleString()
    return raw_records.select("rec_id", "raw").mapInArrow(run, f"rec_id {kind}, {PARSED}")


def valid_and_failed(raw_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The loaded rows (rec_id, product_id, helpfulness, helpfulness_num, helpfulness_den, score, text), and the failed ones
    (rec_id, reason, position)."""
    parsed = parse_rows(raw_records)
    return parsed.where("reason is null").drop("reason", "position"), parsed.where("reason is not null").select("rec_id", "reason", "position")


def parse_files(files: DataFrame) -> DataFrame:
    """rec_id (character position in the file), PARSED and path of whole files (path, content as text).

    For small exports that are in a table. A file is parsed in one task, since a quote may reach over any line break;
    parse_export_files() reads large ones in pieces, parse_exports() takes those whose records are rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(RecordParser(content or "").file())
                parsed = _columns(rows, [pa.array([r.start for r in rows], pa.int64())])
                yield pa.RecordBatch.from_arrays([*parsed.columns, pa.array([path] * len(rows), pa.string())], [*parsed.schema.names, "path"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).mapInArrow(run, f"rec_id long, {PARSED}, path string")


_PART = r'(?:"(?:[^"]|"")*"|[^",]*)'
#: A line that is a whole record with votes and score in place: where a large file may be cut.
WHOLE_LINE = rf'^{_PART},"?\s*[0-9]+/[0-9]+\s*"?,"?\s*[0-9]+(\.[0-9]+)?\s*"?,{_PART}\r?$'


def parse_export_files(spark: SparkSession, path: str, piece: int = 1_000_000) -> DataFrame:
    """(path, start, PARSED) of the records of files of any size below a path; start and position count characters.

    Files are read in splits and parsed in pieces of about `piece` characters, each of which begins at a line that is a
    whole record by itself; the parser recovers within its piece. Only a file without such lines is one piece. A quoted
    text that holds such a line where a piece would begin is cut there.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__line"))
    summed = running_sum(lines.withColumn("__size", F.length("value") + 1), ["path"], [F.col("__split"), F.col("__line")], "__size", "__end")
    placed = summed.select("path", "value", (F.col("__end") - F.col("__size")).alias("__start")).withColumn("__block", F.floor(F.col("__start") / piece))
    anchor = F.min(F.when(F.col("value").rlike(WHOLE_LINE), F.col("__start"))).alias("__anchor")
    blocks = placed.groupBy("path", "__block").agg(anchor)  # a row for each piece
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.max(F.when(F.col("__anchor").isNotNull(), F.col("__block"))).over(before))
    joined = placed.join(blocks, ["path", "__block"])
    number = F.when(F.col("__start") >= F.col("__anchor"), F.col("__block")).otherwise(F.coalesce("__before", F.lit(-1)))
    return _parse_pieces(joined.select("path", number.alias("__piece"), "__start", F.col("value").alias("raw")), "path")


def _parse_pieces(placed: DataFrame, name: str) -> DataFrame:
    """(name, start, PARSED) of lines (name, __piece, __start, raw), each piece of a file parsed with recovery."""
    lines = F.sort_array(F.collect_list(F.struct("__start", "raw")))
    texts = placed.groupBy(name, "__piece").agg(F.min("__start").alias("__base"), F.array_join(F.transform(lines, lambda r: r["raw"]), "\n").alias("content"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, base, content in zip(*(batch.column(c).to_pylist() for c in (name, "__base", "content")), strict=True):
                found = [replace(r, position=None if r.position is None else r.position + base) for r in RecordParser(content + "\n").file()]
                parsed = _columns(found, [pa.array([r.start + base for r in found], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), *parsed.columns], [name, "start", *parsed.schema.names[1:]])

    return texts.select(name, "__base", "content").mapInArrow(run, f"{name} string, start long, {PARSED}")


def parse_exports(raw_records: DataFrame, piece: int = 1_000_000) -> DataFrame:
    """(src_file, start, PARSED) of the records of each src_file as one text, in order of rec_id and with a line break after
    each, parsed with recovery; start and position count characters of that text.

    raw_records: rec_id, src_file, raw (null counts as empty). The text is cut at record starts into pieces of about
    `piece` characters, so a file with most rows is spread over many tasks; a broken quote ends with its piece at the
    latest. Line breaks end plain fields here.
    """
    rows = raw_records.select("src_file", "rec_id", F.coalesce("raw", F.lit("")).alias("raw"))
    summed = running_sum(rows.withColumn("__size", F.length("raw") + 1), ["src_file"], [F.col("rec_id"), F.col("raw")], "__size", "__end")
    placed = summed.withColumn("__start", F.col("__end") - F.col("__size")).withColumn("__piece", F.floor(F.col("__start") / piece))
    return _parse_pieces(placed, "src_file")

"""Line-oriented review text: 'key: value' lines, records that start with a product id.

parse_records() is the canonical reader: missing fields take defaults, and a record is read without regard to others.
parse_lines() repeats a reader that keeps a field's last value when a later review lacks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions.text import helpfulness, score
from harrow.operators.ordering import place_rows

#: The field names of the format.
KEYS = {"product_id": "product/productId", "helpfulness": "review/helpfulness", "score": "review/score", "text": "review/text"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Text files cut at record starts, so that large files split; column value. Bytes are taken as ISO-8859-1."""
    return spark.read.option("lineSep", f"\n{KEYS['product_id']}: ").text(path).withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))


def _typed(fields: dict[str, Column]) -> list[Column]:
    votes = helpfulness(fields["helpfulness"])
    return [
        F.upper(F.coalesce(fields["product_id"], F.lit(""))).alias("product_id"), votes["num"].alias("helpfulness_num"),
        votes["den"].alias("helpfulness_den"), score(fields["score"]).alias("score"), F.coalesce(fields["text"], F.lit("")).alias("text"),
    ]


def parse_records(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed reviews of records (column value); `keep` names further columns to pass on.

    A record may lack its leading product key, as read_records() cuts there. A null or blank record gives no row; a
    missing field gives '' (product, text), 0/1 or 1.
    """
    key = KEYS["product_id"]
    value = F.col("value")
    whole = F.when(F.trim(value).startswith(f"{key}:"), value).otherwise(F.concat(F.lit(f"{key}: "), value))
    # Only \n ends a line: bytes of UTF-8 read as ISO-8859-1 give signs that Java takes for line ends too.
    field = {n: F.regexp_extract(F.col("__whole"), rf"(?dm)^{k}: ([^\r\n]*)", 1) for n, k in KEYS.items()}
    return records.where(F.trim(value) != "").select(*(keep or []), whole.alias("__whole")).select(*(keep or []), *_typed(field))


def parse_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Typed reviews of lines (column value) in the order of the given columns; a missing field repeats its last value.

    The last value before a partition's first line comes from the partitions before it, of which one small row each
    goes to the driver. Output: line_num (0-based, of the text line) and the typed fields. Lines that are null or
    have no known key count for nothing; fields never seen take the defaults of parse_records().
    """
    value = F.col("value")
    seen = {n: F.when(value.startswith(f"{k}: "), F.substr(value, F.lit(len(k) + 3))) for n, k in KEYS.items()}
    placed, offsets = place_rows(lines.select("value", *order), [F.col(c) for c in order])
    placed = placed.select("__part", "__pos", *(c.alias(n) for n, c in seen.items()))
    last = placed.groupBy("__part").agg(*(F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("__pos"))).alias(n) for n in seen))
    carried, rows = dict.fromkeys(seen), []
    by_part = {r["__part"]: r for r in last.collect()}
    for part, offset in sorted(offsets.items()):
        rows.append((part, offset, *(carried[n] for n in seen)))
        carried = {n: by_part[part][n] if by_part[part][n] is not None else carried[n] for n in seen}
    schema = "__part int, __offset long, " + ", ".join(f"__{n} string" for n in seen)
    before = lines.sparkSession.createDataFrame(rows, schema)
    within = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.select("__part", "__pos", F.col("text").isNotNull().alias("__emit"), *(F.last(n, ignorenulls=True).over(within).alias(n) for n in seen))
    joined = filled.where("__emit").join(F.broadcast(before), "__part")
    fields = {n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in seen}
    return joined.select((F.col("__offset") + F.col("__pos")).alias("line_num"), *_typed(fields))


def to_records(reviews: DataFrame) -> DataFrame:
    """Reviews as record text (doc_id, value); line breaks in texts become blanks."""
    line = lambda n, c: F.concat(F.lit(f"{KEYS[n]}: "), c)
    votes = F.concat_ws("/", F.col("helpfulness_num").cast("string"), F.col("helpfulness_den").cast("string"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n\u0085\u2028\u2029]+", " ")
    parts = [line("product_id", F.coalesce("product_id", F.lit(""))), line("helpfulness", votes), line("score", F.coalesce(F.col("score").cast("string"), F.lit(""))), line("text", text)]
    return reviews.select("doc_id", F.concat_ws("\n", *parts).alias("value"))

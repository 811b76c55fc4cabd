"""Index folders from review files or review tables, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators.index import ReviewIndex, remove_index
from harrow.operators.ordering import number_rows
from harrow.plans.durable import cut, drop, shared_folder
from harrow.sources.review_text import parse_records, read_records
from harrow.sources.tables import canonical_reviews, read

__all__ = ["IndexWriter", "build_from_file", "build_from_table", "remove_index", "review_index"]

#: Indexes of this process: (application, folder, what its review files are) -> the opened index.
_opened: dict[tuple, ReviewIndex] = {}


def number_records(records: DataFrame) -> DataFrame:
    """Records as read (column value) with doc_id from 1 in order of file, split and line."""
    placed = records.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split")).withColumn("__line", F.monotonically_increasing_id())
    return number_rows(placed.where(F.trim("value") != ""), [F.col("__file"), F.col("__split"), F.col("__line")], "doc_id").select("doc_id", "value")


def _save(built: ReviewIndex, folder: str) -> None:
    """Save an index and delete the unsorted postings that it was built on."""
    built.save(folder)
    drop(built.postings)


def build_from_file(spark: SparkSession, path: str, folder: str) -> ReviewIndex:
    """Parse line-oriented review text, number the reviews, write the index and open it. Errors are raised."""
    parsed = parse_records(number_records(read_records(spark, path)), ["doc_id"])
    reviews = parsed.withColumn("product_id", F.when(F.col("product_id") != "", F.col("product_id")))
    reviews = cut(reviews)
    _save(ReviewIndex.build(reviews), folder)
    drop(reviews)
    return ReviewIndex.load(spark, folder)


def build_from_table(reviews: DataFrame, folder: str) -> ReviewIndex:
    """The same from a table of reviews, whose doc_id stay."""
    _save(ReviewIndex.build(canonical_reviews(reviews), canonical_reviews(reviews, False)), folder)
    return ReviewIndex.load(reviews.sparkSession, folder)


def _files(spark: SparkSession, path: str) -> tuple:
    """Number, size, last change and a hash of the files of a table; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return tuple(row)


def review_index(spark: SparkSession, folder: str) -> ReviewIndex:
    """The index of the reviews of a data folder: built in the shared folder at the first call of an application, opened
    after that, built again where the review files have changed."""
    key = (spark.sparkContext.applicationId, folder, *_files(spark, f"{folder}/reviews.parquet"))
    if key not in _opened:
        name = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        _opened[key] = build_from_table(read(spark, folder, "reviews"), name)
    return _opened[key]


class IndexWriter:
    """The file interface: a review file becomes an index folder. slow_write() is the older name of write()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def write(self, input_file: str, folder: str) -> None:
        build_from_file(self.spark, input_file, folder)

    slow_write = write

    def remove_index(self, folder: str) -> None:
        remove_index(self.spark, folder)

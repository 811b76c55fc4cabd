"""Build logs of an index: progress by stage, sizes of the temporary indices, and a summary for each dataset.

Lines come as a table (dataset, line_num, value). Lines of other kinds count for nothing; a dataset without a progress
line gives no rows. Times are hours, minutes and seconds of one day; elapsed counts from the first progress line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.ordering import running_sum

#: The line formats of the log. Groups: hours, minutes and seconds, then the numbers or the path.
TIME = r"^\[([0-9]+):([0-9]+)\.([0-9]+)\] "
INVERTED = TIME + r"Processed .*a total of ([0-9,]+)"
MERGED = TIME + r"So far merged a total of ([0-9,]+) tokens out of ([0-9,]+)"
MADE_INDEX = TIME + r"Finished creating temporary index at (.*)$"
NUM_REVIEWS = r"^getNumberOfReviews: ([0-9]+)"


def _group(pattern: str, number: int) -> Column:
    found = F.regexp_extract("value", pattern, number)
    return F.when(found != "", found)


def _count(pattern: str, number: int) -> Column:
    return F.regexp_replace(_group(pattern, number), ",", "").try_cast("long")


def _seconds(pattern: str) -> Column:
    hours, minutes, seconds = (_group(pattern, i).cast("int") for i in (1, 2, 3))
    return hours * 3600 + minutes * 60 + seconds


def _started(lines: DataFrame) -> DataFrame:
    """(dataset, start, total_reviews)."""
    seconds = F.coalesce(_seconds(INVERTED), _seconds(MERGED))
    found = lines.select("dataset", F.when(seconds.isNotNull(), F.struct("line_num", seconds.alias("s"))).alias("t"), _count(NUM_REVIEWS, 1).alias("n"))
    return found.groupBy("dataset").agg(F.min("t").alias("t"), F.max("n").alias("total_reviews")).where("t is not null").select("dataset", F.col("t.s").alias("start"), "total_reviews")


def progress(lines: DataFrame) -> DataFrame:
    """(dataset, line_num, stage, elapsed, num_tokens, total_reviews): stage invert or merge, elapsed in seconds."""
    stage = F.when(_group(INVERTED, 1).isNotNull(), "invert").when(_group(MERGED, 1).isNotNull(), "merge")
    seconds, tokens = F.coalesce(_seconds(INVERTED), _seconds(MERGED)), F.coalesce(_count(INVERTED, 4), _count(MERGED, 4))
    rows = lines.select("dataset", "line_num", stage.alias("stage"), seconds.alias("s"), tokens.alias("num_tokens")).where("stage is not null")
    return rows.join(_started(lines), "dataset").select("dataset", "line_num", "stage", (F.col("s") - F.col("start")).alias("elapsed"), "num_tokens", "total_reviews")


def index_sizes(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dataset, line_num, elapsed, index_size, total_index_size): sizes has (path, size), 0 where a path is missing."""
    made = lines.select("dataset", "line_num", _seconds(MADE_INDEX).alias("s"), _group(MADE_INDEX, 4).alias("path")).where("path is not null")
    sized = made.join(sizes.groupBy("path").agg(F.sum("size").alias("size")), "path", "left").join(_started(lines), "dataset")
    rows = sized.select("dataset", "line_num", (F.col("s") - F.col("start")).alias("elapsed"), F.coalesce("size", F.lit(0)).alias("index_size"))
    return running_sum(rows, ["dataset"], [F.col("line_num")], "index_size", "total_index_size")


def summary(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dataset, elapsed, total_reviews, total_index_size): the largest of each."""
    ended = progress(lines).groupBy("dataset").agg(F.max("elapsed").alias("elapsed"), F.max("total_reviews").alias("total_reviews"))
    return ended.join(index_sizes(lines, sizes).groupBy("dataset").agg(F.max("total_index_size").alias("total_index_size")), "dataset", "left")

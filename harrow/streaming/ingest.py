"""Reviews that arrive over time become index blocks, one for each micro-batch; merging the blocks gives the postings.

A micro-batch that runs again after a failure replaces its own block, so no review counts twice on that account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from harrow.functions.text import raw_tokens
from harrow.sources.tables import one_delivery


def write_block(batch: DataFrame, block_id: int, folder: str) -> None:
    """(term, doc_id, tf, received_at) of one batch of reviews; a review without tokens has one row with a null term, so
    that it replaces what an earlier delivery held."""
    last = one_delivery(batch.withColumn("__at", F.col("received_at")), "doc_id", "received_at", ["__at", "text"])
    terms = last.select("doc_id", F.col("__at").alias("received_at"), F.explode_outer(raw_tokens(F.col("text"))).alias("__raw"))
    counted = terms.groupBy("doc_id", "received_at", F.lower("__raw").alias("term")).agg(F.count("*").alias("tf"))
    counted.repartitionByRange("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/block_id={block_id}")


def ingest(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str) -> StreamingQuery:
    """Read the parquet files that appear in `source` and write blocks until all present files are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, block_id: write_block(batch, block_id, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(term, doc_id, tf) over all blocks; of a review delivered in several blocks, the delivery received last counts, of
    equal ones that of the later block."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("doc_id").agg(F.max(F.struct("received_at", "block_id")).alias("__last"))
    kept = rows.join(last, "doc_id").where((F.col("block_id") == F.col("__last.block_id")) & F.col("term").isNotNull())
    return kept.select("term", "doc_id", "tf")

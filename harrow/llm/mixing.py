"""A mix of sources with target shares of the total size, small sources repeated up to a cap.

Sizes are tokens of a public tokenizer. Each document of a source is expected the same number of times; the expected
copies are summed along the source, one random offset is added, and a document is emitted once for each whole number
that its stretch of the sum crosses. Documents run in order of size, so each size gets its part and the sampled tokens
stay close to the expected ones.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.ordering import running_sum
from harrow.plans.durable import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the tokenizer's vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source):
    """Sources compare trimmed and lower-cased."""
    return F.lower(F.trim(source))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, num_tokens): source as source_key(); 0 for null and empty texts."""

    def run(batches):
        import pyarrow as pa
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], ["doc_id", "source", "num_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, num_tokens long")


def plan_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, wanted_tokens, available_tokens, num_documents, copies, reachable), a row for each
    target; num_documents: those with tokens.

    sized: source, num_tokens. The mix is as large as all of sized. copies: expected times of each document, at most
    max_repeats. reachable: whether max_repeats times the source suffice; never for a source without tokens unless its
    share is 0. Of repeated targets of a source the largest share counts, with its repeats; null shares count as 0.
    """
    total = sized.agg(F.coalesce(F.sum("num_tokens"), F.lit(0))).scalar()
    goals = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("g"))
    owned = sized.groupBy("source").agg(F.sum("num_tokens").alias("available"), F.count_if(F.col("num_tokens") > 0).alias("documents"))
    joined = goals.join(owned, "source", "left")
    wanted, available = F.col("g.s") * total, F.coalesce("available", F.lit(0))
    copies = F.when(available > 0, F.least(F.col("g.r").cast("double"), wanted / available)).otherwise(0.0)
    return joined.select("source", F.col("g.s").alias("target_share"), F.col("g.r").alias("max_repeats"), wanted.alias("wanted_tokens"), available.alias("available_tokens"), F.coalesce("documents", F.lit(0)).alias("num_documents"), copies.alias("copies"), (available * F.col("g.r") >= wanted).alias("reachable"))


def sample_mix(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, num_tokens, times) of the documents in the mix; the same for the same seed and rows.

    A source's prefix sums come from range partitions, so a source that holds most rows is spread. Documents without
    tokens are left out; repeated doc_id are documents of their own.
    """
    rows = sized.where("num_tokens > 0").join(plan.where("copies > 0").select("source", "copies"), "source")
    rows = rows.withColumn("__one", F.lit(1)).withColumn("__mix", F.xxhash64("doc_id", F.lit(seed)))
    placed = running_sum(rows, ["source"], [F.col("num_tokens"), F.col("__mix"), F.col("doc_id")], "__one", "__place")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(offset + F.col("__place") * F.col("copies")) - F.floor(offset + (F.col("__place") - 1) * F.col("copies"))
    # The prefix sum is place * copies; a rounding error may cross a border one document early, never emit more in all.
    return placed.withColumn("times", times.cast("int")).where("times > 0").select("doc_id", "source", "num_tokens", "times")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(sample_mix(), report). report: plan_mix() with mixed_tokens, num_copies, two shares reached, of the size aimed at and of
    the mix as it came out, and exhausted: the sample holds every document of the source max_repeats times and still falls
    short of the tokens wanted."""
    sized = cut(token_counts(documents, tokenizer))
    plan = cut(plan_mix(sized, targets))
    sampled = sample_mix(sized, plan, seed)
    mixed = sampled.groupBy("source").agg(F.sum(F.col("num_tokens") * F.col("times")).alias("mixed_tokens"), F.sum("times").alias("num_copies"))
    mixed = cut(mixed)
    total = mixed.agg(F.sum("mixed_tokens")).scalar()
    aim = sized.agg(F.sum("num_tokens")).scalar()
    tokens = F.coalesce("mixed_tokens", F.lit(0))
    taken = F.coalesce("num_copies", F.lit(0))
    exhausted = (taken == F.col("num_documents") * F.col("max_repeats")) & (tokens < F.col("wanted_tokens"))
    report = plan.join(mixed, "source", "left").select(*plan.columns, tokens.alias("mixed_tokens"), taken.alias("num_copies"), exhausted.alias("exhausted"), F.coalesce(F.try_divide(tokens, aim), F.lit(0.0)).alias("share_of_aim"), F.coalesce(F.try_divide(tokens, total), F.lit(0.0)).alias("share_of_mix"))
    return sampled, report


def copies_of(sampled: DataFrame) -> DataFrame:
    """One row for each copy: (doc_id, source, num_tokens, copy), copy from 1."""
    return sampled.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")

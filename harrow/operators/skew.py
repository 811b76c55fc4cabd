"""Per-key work without a slow task: fragment and replicate by estimated load.

Rows are counted by key. Keys above a task's fair load are split into shards in proportion to their rows; all other
keys are folded into a fixed number of buckets. Shards and buckets are packed into tasks, largest first, each into the
least loaded task. Rows of a split key go to a shard by the hash of their id; the matching side is copied only to the
shards of the keys that it holds.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.plans.durable import cut

#: Buckets of light keys for each task: enough for even packing, few enough for the driver.
BUCKETS_PER_TASK = 8
#: Most tasks of a placement, whatever the input: it bounds what the driver packs and what is broadcast (80,000 buckets of
#: 12 bytes and as many shards). Beyond it, tasks get more rows; they sort on disk and hold one key's result at a time.
MAX_TASKS = 10_000


@dataclass(frozen=True)
class Placement:
    """num_tasks; heavy: key -> its shards' tasks; buckets: task of each bucket of light keys; total: rows counted."""

    num_tasks: int
    heavy: dict[str, list[int]]
    buckets: list[int]
    total: int


def plan_placement(keyed: DataFrame, key: str, rows_per_task: int, max_tasks: int = MAX_TASKS) -> Placement:
    """Loads of all rows, packed into as many tasks as rows_per_task asks for, at most max_tasks.

    The driver gets at most one row for each task (heavy keys) and each bucket: a heavy key holds more than a task's rows,
    so there are fewer of them than tasks. Rows are counted in one pass.
    """
    loads = cut(keyed.groupBy(F.col(key).cast("string").alias("__text")).agg(F.count("*").alias("__n")))
    total = loads.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    num_tasks = min(max_tasks, max(1, math.ceil(total / rows_per_task)))
    rows_per_task = max(rows_per_task, math.ceil(total / num_tasks))
    num_buckets = BUCKETS_PER_TASK * num_tasks
    is_heavy = F.col("__n") > rows_per_task
    slot = F.when(~is_heavy, F.pmod(F.xxhash64("__text"), F.lit(num_buckets)))
    packed = loads.groupBy(F.when(is_heavy, F.col("__text")).alias("__key"), slot.alias("__bucket")).agg(F.sum("__n").alias("__n")).collect()
    pieces = [(r["__n"], "", r["__bucket"]) for r in packed if r["__key"] is None]
    for r in packed:
        if r["__key"] is not None:
            shards = math.ceil(r["__n"] / rows_per_task)
            pieces += [(r["__n"] / shards, r["__key"], i) for i in range(shards)]
    tasks = [(0.0, t) for t in range(num_tasks)]
    heavy: dict[str, list[int]] = {}
    buckets = [b % num_tasks for b in range(num_buckets)]
    for load, name, place in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        held, task = heapq.heappop(tasks)
        heapq.heappush(tasks, (held + load, task))
        if name:
            heavy.setdefault(name, []).append(task)
        else:
            buckets[place] = task
    return Placement(num_tasks, heavy, buckets, total)


def _with_tasks(df: DataFrame, key: str, plan: Placement) -> DataFrame:
    """df with __own (tasks of a split key, else null) and __light (task of the key's bucket).

    Both tables are broadcast: they have at most MAX_TASKS shards in all and BUCKETS_PER_TASK rows for each task.
    """
    spark = df.sparkSession
    heavy = spark.createDataFrame(sorted(plan.heavy.items()), "__heavy string, __own array<int>")
    buckets = spark.createDataFrame(list(enumerate(plan.buckets)), "__bucket long, __light int")
    text = F.col(key).cast("string")
    bucketed = df.where(F.col(key).isNotNull()).withColumn("__bucket", F.pmod(F.xxhash64(text), F.lit(len(plan.buckets))))
    found = bucketed.join(F.broadcast(heavy), text == F.col("__heavy"), "left").join(F.broadcast(buckets), "__bucket")
    return found.drop("__heavy", "__bucket")


def place(df: DataFrame, key: str, spread: Column, plan: Placement) -> DataFrame:
    """df partitioned as planned; `spread` (the row's id, say) picks the shard of a split key. Rows with a null key are left out."""
    shard = F.get("__own", F.pmod(F.xxhash64(spread), F.size("__own").cast("bigint")).cast("int"))
    tasked = _with_tasks(df, key, plan).withColumn("__task", F.when(F.col("__own").isNotNull(), shard).otherwise(F.col("__light")))
    return tasked.drop("__own", "__light").repartitionById(plan.num_tasks, F.col("__task"))


def replicate(side: DataFrame, key: str, plan: Placement) -> DataFrame:
    """The matching side: rows of a split key once for each task with a shard of it, other rows once."""
    tasks = F.when(F.col("__own").isNotNull(), F.array_distinct("__own")).otherwise(F.array("__light"))
    return _with_tasks(side, key, plan).withColumn("__task", F.explode(tasks)).drop("__own", "__light").repartitionById(plan.num_tasks, F.col("__task"))


def balanced_join(rows: DataFrame, side: DataFrame, key: str, spread: str, rows_per_task: int = 1_000_000, how: str = "inner") -> DataFrame:
    """rows joined with side on key; how: inner or left. Columns: those of rows, then those of side but the key.

    No shard has more than about rows_per_task rows, however many one key holds; the join hashes (task, key), so the
    shards of a key lie in different tasks. Rows of `side` with equal keys all match. A column of side whose name rows
    has too comes as side_<name>. A null key matches nothing: with how='left' such rows come with nulls.
    """
    own = set(rows.columns)
    renamed = {c: f"side_{c}" for c in side.columns if c != key and c in own}
    side = side.withColumnsRenamed(renamed)
    plan = plan_placement(rows.where(F.col(key).isNotNull()), key, rows_per_task)
    left, right = place(rows, key, F.col(spread), plan), replicate(side, key, plan)
    joined = left.join(right.hint("shuffle_merge"), ["__task", key], how).drop("__task")
    joined = joined.select(*rows.columns, *(c for c in side.columns if c != key))
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key]
        joined = joined.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *empty))
    return joined


SUMMARY = "product_id string, num_reviews long, sum_score_weight double, sum_weight double, best array<struct<doc_id: bigint, votes: int, score: int>>"


def _summaries(top: int):
    """Partial results of rows sorted by product and doc_id: one row for each product of a task.

    A task holds one Arrow batch, the row before it and the result of the product that is not over yet.
    """
    import numpy as np
    import pyarrow as pa

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("votes", pa.int32()), ("score", pa.int32())]))
    schema = pa.schema([("product_id", pa.string()), ("num_reviews", pa.int64()), ("sum_score_weight", pa.float64()), ("sum_weight", pa.float64()), ("best", kind)])

    def results(rows: pa.Table) -> list[list]:
        encoded = rows["product_id"].combine_chunks().dictionary_encode()
        codes, size = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)
        doc, num, den, score = (rows[n].to_numpy() for n in ("doc_id", "helpfulness_num", "helpfulness_den", "score"))
        weight = np.where(den == 0, 0.5, num / np.where(den == 0, 1, den))
        count, sw, w = (np.bincount(codes, v, size) for v in (None, score * weight, weight))
        ranked = np.lexsort((doc, -score, -num, codes))
        starts = np.searchsorted(codes[ranked], np.arange(size))
        best = [[(-int(num[i]), -int(score[i]), int(doc[i])) for i in ranked[s : s + min(top, int(n))]] for s, n in zip(starts, count, strict=True)]
        return [list(r) for r in zip(encoded.dictionary.to_pylist(), count.tolist(), sw.tolist(), w.tolist(), best, strict=True)]

    def flush(done: list[list]) -> pa.RecordBatch:
        product, count, sw, w, best = zip(*done, strict=True)
        listed = [[{"doc_id": d, "votes": -v, "score": -s} for v, s, d in b] for b in best]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((product, count, sw, w, listed), schema, strict=True)], schema=schema)

    def run(batches):
        waiting, held = None, None
        for batch in _with_end(batches):
            parts = [b for b in (waiting, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts)
            if batch is not None:
                # The delivery that came last is the one that counts: a row is final once another doc_id follows it.
                product, doc = rows["product_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), rows["doc_id"].to_numpy()
                last = (doc[1:] != doc[:-1]) | (product[1:] != product[:-1])
                waiting = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0]
                rows = rows.slice(0, rows.num_rows - 1).filter(pa.array(last))
            found = results(rows) if rows.num_rows else []
            if found and held and held[0] == found[0][0]:
                own = found[0]
                found[0] = [own[0], *(a + b for a, b in zip(held[1:4], own[1:4], strict=True)), sorted(held[4] + own[4])[:top]]
            elif found and held:
                found.insert(0, held)
            if found:
                held = found.pop()
            if found:
                yield flush(found)
        if held:
            yield flush([held])

    return run


def _with_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def product_results(reviews: DataFrame, top: int = 3, rows_per_task: int = 200_000) -> tuple[DataFrame, Placement]:
    """(product_id, num_reviews, rank, best) for every product, and the placement used.

    reviews: doc_id, product_id (compared as functions.text.product_key says), helpfulness_num, helpfulness_den, score,
    received_at; a doc_id of a product counts once, as delivered last. rank: helpfulness-weighted mean score, 0 if all
    weights are 0. best: up to `top` reviews by helpful votes, then score, then smallest doc_id. Null score counts as 1,
    null votes as 0 of 1. Rows without product or doc_id are left out; no rows give an empty result. Shards yield one
    small partial row for each key and task, which a last grouping adds up: of one product at most MAX_TASKS rows.
    """
    from harrow.functions.text import ordered_votes, product_key

    votes = ordered_votes(F.col("helpfulness_num"), F.col("helpfulness_den"))
    rows = reviews.select(
        product_key(F.col("product_id")).alias("product_id"), "doc_id", votes["num"].alias("helpfulness_num"), votes["den"].alias("helpfulness_den"),
        F.when(F.col("score").between(1, 5), F.col("score")).otherwise(1).cast("int").alias("score"), F.coalesce(F.unix_micros("received_at"), F.lit(0)).alias("received"),
    ).where("product_id is not null and doc_id is not null")
    plan = plan_placement(rows.select("product_id"), "product_id", rows_per_task)
    placed = place(rows, "product_id", F.col("doc_id"), plan).drop("__task")
    partial = placed.sortWithinPartitions("product_id", "doc_id", "received", "helpfulness_num", "helpfulness_den", "score").mapInArrow(_summaries(top), SUMMARY)
    merged = partial.groupBy("product_id").agg(
        F.sum("num_reviews").alias("num_reviews"), F.sum("sum_score_weight").alias("__sw"), F.sum("sum_weight").alias("__w"), F.flatten(F.collect_list("best")).alias("__best")
    )
    by_votes = F.array_sort("__best", lambda a, b: F.when(a["votes"] != b["votes"], b["votes"] - a["votes"]).when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(F.signum(a["doc_id"] - b["doc_id"]).cast("int")))
    rank = F.coalesce(F.try_divide("__sw", "__w"), F.lit(0.0))
    return merged.select("product_id", "num_reviews", rank.alias("rank"), F.slice(by_votes, 1, top).alias("best")), plan


def products_above(reviews: DataFrame, share: float, top: int = 3, rows_per_task: int = 200_000) -> DataFrame:
    """Products with more than `share` of all distinct doc_id (those without product included), from product_results()."""
    results, _ = product_results(reviews, top, rows_per_task)
    everything = reviews.agg(F.count_distinct("doc_id").alias("n"))
    return results.where(F.col("num_reviews") > F.lit(share) * everything.scalar())

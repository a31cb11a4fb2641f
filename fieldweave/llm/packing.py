"""Packing by optimal length buckets.

One pass counts lengths in cells (exact up to 256, then 128 to each doubling, so
the histogram holds a few thousand rows for any corpus). Bounds fall on the longest
length of a cell, so the padded total is at most 129/128 of the least possible, and
the least if no length is above 256. Dynamic programming
over the histogram chooses the bucket boundaries that minimise padding; inside
each bucket, documents of a shard fill batches of at most ``budget`` tokens
counted with padding. A bucket is dealt to as many shards as keep each near
``shard_rows`` documents, so a popular length never meets in one task; each
shard closes its own last batch, which is the only batch it leaves unfilled.

Null and empty texts have length 0 and take part in the first bucket. A text
longer than the budget is a batch of its own; nothing is cut. Repeated rows are
packed as often as they come. An empty table gives no batches. Tokens are words
unless ``length`` says otherwise. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import GAP

EXACT, STEPS = 256, 128


def word_count(text: Column) -> Column:
    """Words of a text; null text: none."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP), lambda w: w != "")), F.lit(0)).cast("long")


def cell_of(length: Column) -> Column:
    """Index of a length's histogram cell; cells are ordered as lengths are."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    inner = F.floor(length * STEPS / F.pow(F.lit(2.0), power)).cast("long")
    return F.when(length < EXACT, length).otherwise(power.cast("long") * STEPS + inner + (EXACT - 9 * STEPS))


def choose_bounds(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padded total.

    ``longest`` and ``counts`` describe the cells in order. Padding a bucket
    costs rows times its bound; the monotone optimum of that cost lets each
    layer be solved by divide and conquer.
    """
    n = len(longest)
    if not n:
        return []
    total = np.r_[0, np.cumsum(counts)].astype(np.float64)
    high = longest.astype(np.float64)
    best = total[1:] * high
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = np.full(n, np.inf), np.full(n, -1, np.int64)
        stack = [(0, n - 1, -1, n - 2)]
        while stack:
            lo, hi, first, last = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            k = np.arange(first, min(mid - 1, last) + 1)
            cost = np.where(k >= 0, best[k], 0.0) + (total[mid + 1] - total[k + 1]) * high[mid]
            at = int(np.argmin(cost)) if len(k) else -1
            if at >= 0:
                new[mid], cut[mid] = cost[at], k[at]
            split = int(cut[mid]) if at >= 0 else first
            stack += [(lo, mid - 1, first, split), (mid + 1, hi, split, last)]
        cuts.append(cut)
        best = new
    bounds, end = [], n - 1
    for cut in [*reversed(cuts), np.full(n, -1, np.int64)]:
        bounds.append(int(longest[end]))
        end = int(cut[end])
        if end < 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 16, budget: int = 65_536, shard_rows: int = 20_000, length: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, shard, batch, slot, batch_rows, padding) for each row.

    ``bucket_len`` is the length that the rows of a bucket are padded to; a batch
    is named by (bucket, shard, batch) and holds ``slot`` 0 to ``batch_rows`` - 1.
    ``length`` is the number of tokens of a row, over the columns of ``docs``; its words by default.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), (word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("n_tokens"))
    cells = (
        sized.groupBy(cell_of(F.col("n_tokens")).alias("cell"))
        .agg(F.max("n_tokens").alias("longest"), F.count("*").alias("rows"))
        .orderBy("cell")
        .collect()
    )
    longest = np.array([c["longest"] for c in cells], np.int64)
    rows = np.array([c["rows"] for c in cells], np.int64)
    bounds = choose_bounds(longest, rows, buckets)
    if not bounds:
        bounds, shards = [0], [1]
    else:
        of = np.searchsorted(bounds, longest)
        shards = [max(1, -(-int(rows[of == b].sum()) // shard_rows)) for b in range(len(bounds))]
    table = spark.createDataFrame(
        [(b, bound, shards[b], max(1, budget // max(1, bound))) for b, bound in enumerate(bounds)],
        "bucket int, bucket_len long, shards long, capacity long",
    )
    bucket = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[b], b).otherwise(bucket)
    dealt = (
        sized.withColumn("bucket", bucket.cast("int"))
        .join(F.broadcast(table), "bucket")  # at most ``buckets`` rows
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", F.spark_partition_id()), F.col("shards")))
    )
    in_shard = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id")
    placed = (
        dealt.withColumn("_place", F.row_number().over(in_shard).cast("long") - 1)
        .withColumn("_rows", F.count("*").over(Window.partitionBy("bucket", "shard")))
        .withColumn("batch", F.floor(F.col("_place") / F.col("capacity")))
    )
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        "shard",
        "batch",
        (F.col("_place") % F.col("capacity")).alias("slot"),
        F.least(F.col("capacity"), F.col("_rows") - F.col("batch") * F.col("capacity")).alias("batch_rows"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )

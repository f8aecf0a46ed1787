"""Packing into optimal length buckets.

A document's length is its number of whitespace-separated words plus one end mark.  Documents longer than
``max_tokens`` are split into consecutive pieces of that length and a rest, so that nothing is cut off.  The
histogram of piece lengths over all documents (at most ``max_tokens`` bins) goes to the driver, where dynamic
programming finds the ``buckets`` boundaries that minimise the padding of all pieces together (exact, not a
heuristic).  Inside a bucket, batches of ``budget // boundary`` pieces are formed.  Large buckets are dealt over
lanes, so that numbering the pieces never meets a whole bucket in one task; each lane's last batch may be short.

Edge cases: null, empty and wordless texts are one piece that holds the end mark only; repeated documents each get
their own places (``copy`` tells their pieces apart); fewer distinct lengths than buckets give a bucket for each;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

MAX_TOKENS, BUCKETS, BUDGET, LANE_BATCHES = 2048, 16, 32768, 32


def lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of every row; words are runs of other characters than 0x20 and 0x09-0x0D."""
    words = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("n_tokens"))


def pieces(docs: DataFrame, *, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, copy, piece, tokens``: consecutive pieces of at most ``max_tokens``.

    Rows of one id and length are alike here; they are counted and then numbered by ``copy`` (from 1), so that the
    result does not depend on where rows lie.
    """
    n = lengths(docs).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("times"))
    n = stored(n).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    last = F.floor((F.col("n_tokens") - 1) / F.lit(max_tokens)).cast("int")
    cut = n.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("doc_id", "copy", "piece", F.least(F.lit(max_tokens), F.col("n_tokens") - F.col("piece") * F.lit(max_tokens)).cast("int").alias("tokens"))


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket boundaries (upper, inclusive, ascending) with the least total padding.

    ``cost[b][j]`` is the least padding of the j shortest lengths in b buckets; the last bucket reaches back to some
    i and pads every piece of lengths i..j-1 to length j-1.  The best i does not move back as j grows, so that each
    row is filled by divide and conquer.
    """
    sizes = np.array(sorted(histogram), np.int64)
    if not sizes.size:
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(s)] for s in sizes])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([histogram[int(s)] * int(s) for s in sizes])]).astype(np.float64)
    n, most = len(sizes), min(buckets, len(sizes))
    pad = lambda i, j: sizes[j - 1] * (count[j] - count[i]) - (total[j] - total[i])
    cost = np.concatenate([[0.0], [pad(0, j) for j in range(1, n + 1)]])
    back = np.zeros((most + 1, n + 1), np.int64)
    for b in range(2, most + 1):
        new = np.full(n + 1, np.inf)
        todo = [(b, n, b - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            each = cost[i] + pad(i, j)
            at = int(each.argmin())
            new[j], back[b, j] = each[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        cost = new
    out, j = [], n
    for b in range(most, 0, -1):
        out.append(int(sizes[j - 1]))
        j = int(back[b, j])
    return out[::-1]


def pack(docs: DataFrame, *, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, lane_batches: int = LANE_BATCHES) -> DataFrame:
    """``doc_id, copy, piece, tokens, bucket, batch, slot``: each piece's bucket (its padded length), batch and place in it.

    ``batch`` is ``bucket:lane:number``; a batch holds at most ``budget`` padded tokens (one piece at least).
    """
    cut = pieces(docs, max_tokens=max_tokens)
    histogram = {r["tokens"]: r["n"] for r in cut.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # max_tokens bins at most
    bounds = optimal_boundaries(histogram, buckets)
    plan, low = [], 0
    for top in bounds:
        held = sum(n for t, n in histogram.items() if low < t <= top)
        size = max(1, budget // top)
        plan += [(t, top, size, max(1, held // (size * lane_batches))) for t in histogram if low < t <= top]
        low = top
    places = docs.sparkSession.createDataFrame(plan, T.StructType.fromDDL("tokens int, bucket int, size int, lanes int"))
    dealt = cut.join(F.broadcast(places), "tokens").withColumn("lane", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.col("lanes")).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("doc_id", "copy", "piece", "tokens")) - 1
    numbered = dealt.withColumn("at", at)
    number = F.floor(F.col("at") / F.col("size")).cast("int")
    return numbered.select(
        "doc_id",
        "copy",
        "piece",
        "tokens",
        "bucket",
        F.concat_ws(":", "bucket", "lane", number).alias("batch"),
        F.pmod("at", F.col("size")).cast("int").alias("slot"),
    )


def summary(packed: DataFrame) -> DataFrame:
    """One row per bucket: pieces, batches, tokens, padding and the share of padding."""
    got = packed.groupBy("bucket").agg(
        F.count("*").alias("pieces"),
        F.count_distinct("batch").alias("batches"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("bucket") - F.col("tokens")).alias("padding"),
    )
    return got.withColumn("padding_share", F.col("padding") / (F.col("tokens") + F.col("padding")))

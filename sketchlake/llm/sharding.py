"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are the items. Those that make up a notable part of a
shard are placed one by one; one larger than a whole shard, which no shard could take, is first split
into pieces by a hash of the document id. The others are too many to place singly,
so they are dealt by hash into bundles, of a fixed number per shard and at most about as large as the
smallest of the former, that are items in turn: what is placed is every item, by one rule. Items are placed in falling size, each on the shard where the dot
product of its (bytes, tokens, rows), as shares of the totals, with the shard's
residual capacity is highest; a shard that an item would overfill in bytes is
taken only if all would be. Moves and swaps of items then even out the bytes, as far as the three measures together gain.
The number of items has a bound that doesn't depend on the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.llm.runtime import checkpoint, shuffle_width

BUNDLES = 512
#: Groups of more than this part of a shard, in any measure, are items of their own; those of more than a whole one are split.
NOTABLE, SPLIT = 1 / 256, 1.0


def greedy(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item by dot products alone; ``sizes`` has a row of non-negative measures per item, bytes first."""
    total = np.maximum(sizes.sum(0), 1)
    share = sizes / total * shards
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(1))):
        score = left @ share[i]
        full = left[:, 0] < share[i, 0]
        score = score if full.all() else np.where(full, -np.inf, score)
        out[i] = int(score.argmax())
        left[out[i]] -= share[i]
    return out


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    return even_out(sizes, greedy(sizes, shards), shards)


def even_out(sizes: np.ndarray, where: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Moves or swaps of items between the fullest and the emptiest shard in bytes, while they narrow the range in bytes and bring all measures together nearer to even."""
    where = where.copy()
    share = sizes / np.maximum(sizes.sum(0), 1) * shards
    load = np.stack([np.bincount(where, share[:, m], shards) for m in range(share.shape[1])], 1)
    for _ in range(rounds):
        high, low = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[high] - load[low]
        a, b = np.flatnonzero(where == high), np.append(np.flatnonzero(where == low), -1)
        other = np.where(b[:, None] < 0, 0.0, share[b])
        # moving d changes the sum of squares of the two shards' measures by 2 d (d - gap); all pairs of two shards' items, of bounded number
        moved = share[a][:, None, :1] - other[None, :, :1]
        gain = sum((share[a, m][:, None] - other[None, :, m]) * (gap[m] - share[a, m][:, None] + other[None, :, m]) for m in range(share.shape[1]))
        gain = np.where((moved[:, :, 0] > 0) & (moved[:, :, 0] < gap[0]), gain, -np.inf)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if not gain[i, j] > 1e-12:
            break
        step = share[a[i]] - other[j]
        load[high] -= step
        load[low] += step
        where[a[i]] = low
        if b[j] >= 0:
            where[b[j]] = high
    return where


def shard_documents(docs: DataFrame, shards: int = 16, tokens: Column | None = None) -> DataFrame:
    """``doc_id, size, n_tokens, text_crc32, law, shard, slot, grown_shard``, one row per document.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1; ``tokens`` an
    expression over the text for the second measure, white-space-separated words
    by default. The law is ``bytes``: sizes of the shards are nearly equal.
    Slots number a shard's documents without gaps; they follow hashed sub-ranges, so
    that no task sorts a whole shard. A null text is a group of its own kind, apart from
    the empty text. Equal texts and repeated rows share a group; ties go to the
    lower shard. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.col("text"), F.lit(r"\S+")) if tokens is None else tokens
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.col("text"), F.col("text").isNull()).alias("name"),
        F.hash(F.col("text")).alias("name2"),
    )
    rows = checkpoint(rows)
    measures = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*measures).first()
    whole = [max(1, total[m] or 0) / shards for m in ("bytes", "tokens", "n")]
    part = F.greatest(*[F.col(m) / F.lit(float(w)) for m, w in zip(("bytes", "tokens", "n"), whole, strict=True)])
    groups = rows.groupBy("name", "name2", "text_crc32").agg(*measures).withColumn("part", part).where(F.col("part") > NOTABLE)
    groups = groups.select("name", "name2", "text_crc32", F.ceil(F.col("part") / F.lit(SPLIT)).cast("long").alias("pieces"))
    notable = groups.collect()  # at most 3 * shards / NOTABLE rows, of three measures
    keys = spark.createDataFrame([tuple(r) for r in notable], groups.schema)
    own = rows.join(F.broadcast(keys), ["name", "name2", "text_crc32"], "left")
    item = F.when(F.col("pieces").isNotNull(), F.concat_ws("/", F.lit("g"), "name", "name2", "text_crc32", F.pmod(F.xxhash64("doc_id"), "pieces")))
    item = item.otherwise(F.concat_ws("/", F.lit("b"), F.pmod(F.xxhash64("name"), F.lit(BUNDLES * shards))))
    own = own.withColumn("item", item)
    sizes = own.groupBy("item").agg(*measures).orderBy("item").collect()  # bounded as said above
    where = place(np.array([[r["bytes"], r["tokens"], r["n"]] for r in sizes], np.float64).reshape(-1, 3), shards) if sizes else []
    placed = F.broadcast(spark.createDataFrame([(r["item"], int(s)) for r, s in zip(sizes, where, strict=True)], "item string, shard int"))
    parts = max(1, shuffle_width(spark), (total["n"] or 0) // 100_000 // shards)
    own = own.join(placed, "item").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    before = own.groupBy("shard", "sub").agg(F.count("*").alias("k"))
    before = before.select("shard", "sub", (F.sum("k").over(Window.partitionBy("shard").orderBy("sub")) - F.col("k")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "name"))
    return own.withColumn("within", within).join(before, ["shard", "sub"]).select(
        "doc_id", "size", "n_tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

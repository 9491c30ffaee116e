"""Problem 9: fill containers of fixed capacity with the documents' tokens.

Sum-of-squares packing: an item goes where the sum of the squared numbers of open
containers per residual gap becomes smallest. Items larger than the capacity are
cut into full containers and a rest; no other item is split.

The items are dealt to shards by a hash of their id, each with about SHARD_ITEMS
items, so that no task holds more than its shard and no group is hot. A shard
packs alone. Its emptier containers are then dissolved and packed again with
those of SECOND_SHARDS other shards, so that the open ends of many shards fill
each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.encoding import TOKENIZERS, VOCABULARY, encoded
from foliolens.session import ship, table, written

CAPACITY = 2048
SHARD_ITEMS = 20_000
SECOND_SHARDS = 16


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the order given; sizes lie in 1..capacity."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    out = np.empty(len(sizes), dtype=np.int64)
    bins = 0
    for k, s in enumerate(sizes.tolist()):
        # change of the sum: the gap g loses a bin, the gap g - s gains one; a full bin counts no more
        change = 2 - 2 * count[s:] + 2 * count[: capacity + 1 - s]
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = 1 << 40
        best = int(change.argmin())
        fresh = 1 + 2 * count[capacity - s] if s < capacity else 0
        if change[best] <= fresh and change[best] < 1 << 40:
            g = best + s
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, bins
            bins += 1
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
        out[k] = b
    return out


def _pack(pdf: pd.DataFrame, capacity: int) -> np.ndarray:
    order = np.lexsort((pdf["piece"].to_numpy(), pdf["item"].to_numpy(), -pdf["size"].to_numpy()))
    out = np.empty(len(pdf), dtype=np.int64)
    out[order] = sum_of_squares(pdf["size"].to_numpy()[order], capacity)
    return out


def packed(items: DataFrame, item: str, size: str, n_items: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (item, piece, size, container) of all items.

    item: a unique bigint. Items of size 0 or null have one row with size 0 and no container.
    Larger items than the capacity are cut into full pieces and a rest. Equal ids, if
    there are any, count as separate items. An empty table gives an empty result.
    """
    ship(items.sparkSession)
    shards = max(1, -(-n_items // SHARD_ITEMS))
    rest = F.col("total") - (F.col("piece") - 1) * capacity
    cut = (
        items.select(F.col(item).cast("bigint").alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("total"))
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int"))))
        .withColumn("size", F.least(F.lit(capacity), rest))
    )
    shard = F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")
    done = "item bigint, piece int, size bigint, shard int, bin bigint, again boolean"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _pack(pdf, capacity)
        fill = np.bincount(b, weights=pdf["size"].to_numpy())
        return pdf.assign(bin=b, again=fill[b] < 0.995 * capacity)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(bin=_pack(pdf, capacity))

    some = cut.where("size > 0").select("item", "piece", "size", shard.alias("shard"))
    one = written(some.groupBy("shard").applyInPandas(first, done))
    group = F.floor(F.col("shard") / SECOND_SHARDS).cast("int")
    kept = one.where("not again").select("item", "piece", "size", F.format_string("a%d-%d", "shard", "bin").alias("container"))
    two = (
        one.where("again")
        .select("item", "piece", "size", group.alias("shard"))
        .groupBy("shard")
        .applyInPandas(second, "item bigint, piece int, size bigint, shard int, bin bigint")
        .select("item", "piece", "size", F.format_string("b%d-%d", "shard", "bin").alias("container"))
    )
    none = cut.where("size = 0").select("item", "piece", "size", F.lit(None).cast("string").alias("container"))
    return kept.unionByName(two).unionByName(none)


def p9_containers(spark, sf_dir, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Rows (doc_id, piece, n_tokens, container) for the texts of all documents.

    Null and empty texts have no tokens: one row with n_tokens 0 and a null container.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = written(encoded(docs, "text", path=path).select("doc_id", F.size("ids").alias("n")))
    out = packed(sizes, "doc_id", "n", sizes.count())
    return out.select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")

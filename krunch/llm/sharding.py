"""Shards by vector bin packing.

Equal texts stay together, unless a group is too large for that: one of more than a quarter of a shard's share, in
bytes, words or rows, is dealt out in portions by document. Small groups are gathered in cells by their hash. Cells,
large groups and portions are the items: some thousands at most, however many documents there are. They are
placed largest first, each in the shard where the dot product of its vector with the residual capacities is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 24
#: A group of this part of a shard's share is placed by itself; one of WHOLE such parts is split into as many portions
#: as it has parts. There are so many cells for each shard.
PORTION, WHOLE, CELLS = 64, 16, 128
_DIMENSIONS = ("size", "words", "one")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Item vectors -> shard of each. Capacities are the equal shares; what remains may go below zero."""
    share = np.maximum(vectors.sum(axis=0), 1e-9) / shards
    scaled = vectors / share
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(scaled)), -scaled.max(axis=1))):
        out[k] = int((left @ scaled[k]).argmax())
        left[out[k]] -= scaled[k]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key, portion for every row. The law is `bytes`.

    Null texts count as empty. A null doc_id is placed like any other. Slots follow doc_id within each item, items in turn.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = materialise(rows, "sizes")
    total = rows.agg(*(F.sum(c).alias(c) for c in _DIMENSIONS)).collect()[0]
    if not total["one"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key", F.lit(0).alias("portion"))
    most = {c: max(1.0, total[c] / shards / PORTION) for c in _DIMENSIONS}
    groups = rows.groupBy("group_key", "text_crc32").agg(*(F.sum(c).alias(c) for c in _DIMENSIONS))
    excess = F.greatest(*(F.col(c) / most[c] for c in _DIMENSIONS))
    # at most three times shards * PORTION groups can be so large
    large = groups.where(excess >= 1).select("group_key", "text_crc32", F.when(excess > WHOLE, F.ceil(excess)).otherwise(1).alias("portions"))
    dealt = rows.join(F.broadcast(large), ["group_key", "text_crc32"], "left")
    portion = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("portions")), F.lit(0)).cast("int")
    cell = F.when(F.col("portions").isNull(), F.pmod(F.col("group_key"), F.lit(shards * CELLS)))
    # an item is a cell, or a large group's portion; the latter is named by its group, below zero to stand apart
    dealt = dealt.withColumn("portion", portion).withColumn("cell", cell).withColumn("owner", F.when(cell.isNull(), F.col("group_key")))
    item = ["cell", "owner", "portion"]
    sums = dealt.groupBy(*item).agg(*(F.sum(c).alias(c) for c in _DIMENSIONS)).orderBy(*item).collect()
    where = place(np.array([[r[c] for c in _DIMENSIONS] for r in sums], float), shards)
    slots = np.zeros(len(sums), np.int64)
    for k in range(shards):
        own = np.flatnonzero(where == k)
        counts = np.array([sums[i]["one"] for i in own], np.int64)
        slots[own] = np.cumsum(counts) - counts
    table = rows.sparkSession.createDataFrame([(r["cell"], r["owner"], r["portion"], k, int(where[k]), int(slots[k])) for k, r in enumerate(sums)], "cell long, owner long, portion int, item int, shard int, first long")
    same = F.col("cell").eqNullSafe(F.col("c")) & F.col("owner").eqNullSafe(F.col("o")) & (F.col("portion") == F.col("p"))
    placed = dealt.join(F.broadcast(table.selectExpr("cell c", "owner o", "portion p", "item", "shard", "first")), same)
    rank = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key", "portion")

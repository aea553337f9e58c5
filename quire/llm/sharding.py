"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts go whole into one of k shards, so that the shards' bytes come close to each other. The groups are
dealt to buckets by hash; each bucket is differenced in one task, which leaves a partial partition of k sums; partial
partitions are differenced again, FAN_IN at a time, until one is left.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_groups, tasks

GROUPS_PER_TASK = 20_000
FAN_IN = 64
#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def differencing(sums: np.ndarray) -> np.ndarray:
    """For m partial partitions of k sums each, the final part of every one's every part (m x k).

    The two partial partitions with the largest spread are combined, the largest sums of one with the smallest of the
    other, until one is left. Ties go by position.
    """
    m, k = sums.shape
    first = np.argsort(sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, first, axis=1).astype(np.int64))
    heap = [(-int(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = nodes[a] + nodes[b][::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        nodes[a] = nodes[b] = None
        nodes.append(both)
        made.append((a, b, order))
        heapq.heapreplace(heap, (int(both[0] - both[-1]), len(nodes) - 1))
    part = [None] * len(nodes)
    if nodes:
        part[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        own = part[m + i]
        part[a] = np.empty(k, np.int64)
        part[b] = np.empty(k, np.int64)
        part[a][order] = own
        part[b][k - 1 - order] = own
        part[m + i] = None
    out = np.empty((m, k), np.int64)
    for i in range(m):
        out[i, first[i]] = part[i]
    return out


def _local(k: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(pdf), k), np.int64)
        sums[:, k - 1] = pdf["bytes"].to_numpy()
        return pd.DataFrame({"gkey": pdf["gkey"], "bucket": pdf["bucket"], "part": differencing(sums)[:, k - 1]})

    return pack


def _merge(k: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(names), k), np.int64)
        sums[at, pdf["part"].to_numpy()] = pdf["bytes"].to_numpy()
        parts = differencing(sums)
        return pd.DataFrame({"bucket": np.repeat(names, k), "part": np.tile(np.arange(k), len(names)), "upper": int(pdf["upper"].iloc[0]), "upper_part": parts.ravel(), "bytes": sums.ravel()})

    return merge


def shard_groups(groups: DataFrame, k: int) -> DataFrame:
    """groups (gkey, bytes) with `shard`, 0 to k - 1. One row for each gkey."""
    buckets = max(1, -(-groups.count() // GROUPS_PER_TASK))
    placed = cut(
        groups.select("gkey", "bytes", F.pmod(F.xxhash64("gkey"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(_local(k), "gkey string, bucket long, part long")
    )
    sums = placed.join(groups, "gkey").groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    way = None
    while buckets > 1:
        up = cut(sums.withColumn("upper", F.floor(F.col("bucket") / FAN_IN)).groupBy("upper").applyInPandas(_merge(k), "bucket long, part long, upper long, upper_part long, bytes long"))
        sums = up.groupBy(F.col("upper").alias("bucket"), F.col("upper_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
        step = up.select("bucket", "part", "upper", "upper_part")
        way = step if way is None else cut(way.join(step.toDF("upper", "upper_part", "top", "top_part"), ["upper", "upper_part"]).selectExpr("bucket", "part", "top AS upper", "top_part AS upper_part"))
        buckets = -(-buckets // FAN_IN)
    if way is None:
        return placed.select("gkey", F.col("part").cast("int").alias("shard"))
    return placed.join(way, ["bucket", "part"]).select("gkey", F.col("upper_part").cast("int").alias("shard"))


def shard(docs: DataFrame, k: int = 24) -> DataFrame:
    """Every document's shard under the law `bytes`: (doc_id, size, text_crc32, shard, slot).

    size is the text's UTF-8 bytes plus ROW_BYTES; a null text has none and the CRC of no bytes, 0, and forms a group of
    its own. Equal texts share a shard, also where doc_ids repeat. slot counts each shard's rows from 0 without gaps.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("gkey"),
        )
    )
    groups = cut(rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    placed = groups.select("gkey", "n").join(shard_groups(groups, k), "gkey")
    total = rows.count()
    out = cut(join_groups(rows, placed, "gkey", "n", total).drop("gkey", "n").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(tasks(docs)))))
    inside = out.withColumn("nth", F.row_number().over(W.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32")))
    before = (
        out.groupBy("shard", "salt").agg(F.count("*").alias("rows"))
        .withColumn("before", F.sum("rows").over(W.partitionBy("shard").orderBy("salt")) - F.col("rows"))
        .select("shard", "salt", "before")
    )
    return inside.join(before, ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))

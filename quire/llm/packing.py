"""Best-fit packing of token sequences, hierarchically: tasks pack their own pieces best-fit, give out the bins that are
nearly full, and hand the others up a tree, where they are packed again as items."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 1024
END_ID = 2
PIECES_PER_TASK = 20_000
FAN_IN = 8
#: A bin with less room than this is nearly full and leaves the tree.
NEARLY = 8
#: White space from which on a text is encoded by the tokenizers library.
LONG_SPACE = 4096


def encoder(tokenizer: str):
    """A function from texts to arrays of ids, those of the tokenizer's file (a byte-level BPE whose ids are its merges' ranks).

    The merges run in tiktoken, several times as fast; test_packing compares its ids with those of the tokenizers library.
    Special tokens' strings in a text get the special ids, as that library gives them. Its split pattern is the one that the
    file's byte-level step stands for; texts with white space too long for that pattern's backtracking go to the library.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte-level alphabet: printable bytes stand for themselves, all others, in order, for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    own = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    library, long_space = Tokenizer.from_file(tokenizer), re.compile(r"\s{%d}" % LONG_SPACE)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and long_space.search(text):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        return own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return encode


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def over(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            docs, out = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if out:
                at, *rest = (np.array(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(at)), pa.array(rest[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in rest[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return over


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, by best fit in the order of falling sizes; equal sizes go in the given order."""
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_ = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    mask = used = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        where[i], offset[i] = b, capacity - room
        if room > size:
            open_[room - size].append(b)
            mask |= 1 << (room - size)
    return where, offset


def _local(capacity: int, names: list[str]):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in ("doc_id", "piece", "start", "length", "ids_crc32")])
        where, offset = best_fit(rows["length"].to_numpy(), capacity)
        bins = rows["bucket"].to_numpy() * 2**32 + where
        return rows.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offset)).select(names)

    return pack


def _upper(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin"]).reset_index(drop=True)
        where, offset = best_fit(pdf["fill"].to_numpy(), capacity)
        # a new bin bears the smallest number of those in it
        owner = pd.Series(pdf["bin"].to_numpy()).groupby(where).transform("min")
        return pd.DataFrame({"bin": pdf["bin"], "fill": pdf["fill"], "bucket": pdf["bucket"], "owner": owner.to_numpy(), "shift": offset})

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and end_id; null counts as empty and is one id. Only documents longer than capacity are cut,
    into pieces of capacity, the first of which may be shorter. Each row of docs has its own pieces, also where doc_ids
    repeat or are null. Sequences are full from offset 0 on without gaps. An empty table gives no row; other columns are not read.
    """
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    buckets = max(1, -(-pieces.count() // per_task))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    local = cut(dealt.groupBy("bucket").applyInArrow(_local(capacity, names), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"))
    bins = local.groupBy("bin").agg(F.sum("length").alias("fill")).withColumn("bucket", F.shiftright("bin", 32))
    way = None
    while buckets > 1:
        up = cut(_open(bins, capacity, buckets).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("bucket").applyInPandas(_upper(capacity), "bin long, fill long, bucket long, owner long, shift long"))
        bins = up.groupBy(F.col("owner").alias("bin"), "bucket").agg(F.sum("fill").alias("fill")).select("bin", "fill", "bucket")
        step = up.select("bin", "owner", "shift")
        if way is not None:
            above = step.toDF("owner", "upper", "more")
            down = way.join(above, "owner", "left").select("bin", F.coalesce("upper", "owner").alias("owner"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            # bins that first move on a later step were merged bins then, so all bins of a step are already in `down` or new
            step = cut(down.unionByName(step.join(down.select("bin"), "bin", "left_anti")))
        way = step
        buckets = -(-buckets // FAN_IN)
    if way is None:
        return local.withColumnRenamed("bin", "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    out = local.join(way, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("owner", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _open(bins: DataFrame, capacity: int, buckets: int) -> DataFrame:
    """The bins that can still take part: not nearly full. Best fit leaves at most one bin up to half full in a bucket, so at
    most `buckets` bins are left that fit into another; of the fuller bins with the same fill, which are alike, a bucket
    hands up as many as that."""
    alike = W.partitionBy("bucket", "fill").orderBy("bin")
    return bins.filter(F.col("fill") <= capacity - NEARLY).withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= buckets).drop("nth")


def sequences(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """The packed sequences themselves: (sequence_id, length, parts), parts being the pieces in order."""
    part = F.struct("offset", "doc_id", "piece", "start", "length")
    return pack(docs, tokenizer, **how).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))

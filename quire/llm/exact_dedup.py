"""Exact deduplication by a stateful stream.

Normalised texts are written once, with a content locator each, and their digests are streamed from there. The stream keeps,
on disk (RocksDB) and without expiry, for each digest the stable identifier, the locator of one text and the number of rows;
its state is then read as the table it is. The locator of a digest that was hit is followed to its text, and all texts of the
digest are compared with that on their full bytes. Where bytes differ, texts count apart. Texts and state may lie in a folder
that outlives a call: later documents are then judged against all earlier ones.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove
from .common import HEAVY_KEYS, ascii_lower, cut, having, join_groups, scratch_path

#: The state is kept on disk, without preallocated files: there is a store for each shuffle partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
NO_ID = -(1 << 63)


def stored(docs: DataFrame, digest, folder: str) -> tuple[DataFrame, int]:
    """Appends the texts of docs to those of the folder: (all texts, the first locator of these). A locator is a row's number, rising in
    each file, so the row groups' statistics lead to it; numbers of a later call come after those of earlier ones."""
    spark, here, first = docs.sparkSession, f"{folder}/texts", 0
    try:
        first = (spark.read.parquet(here).agg(F.max("place")).first()[0] or 0) + 1
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # a first call that ended before it wrote leaves no file
            raise
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text.alias("body")).select((F.monotonically_increasing_id() + first).alias("place"), "doc_id", digest(F.col("body")).alias("digest"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "body")
    rows.write.mode("append").option("compression", "zstd").parquet(here)
    return spark.read.schema(rows.schema).parquet(here), first


def keyed_state(texts: DataFrame, folder: str) -> DataFrame:
    """The folder's texts that the stream has not seen yet go through its keyed state: one row (digest, keep_id, place, n) for each digest."""
    spark, state = texts.sparkSession, f"{folder}/state"
    stream = (
        spark.readStream.schema(texts.schema).parquet(f"{folder}/texts")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.max_by("place", F.coalesce("doc_id", F.lit(NO_ID))).alias("place"), F.count("*").alias("n"))
    )
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if texts.isEmpty():
        return spark.createDataFrame([], "digest binary, keep_id long, place long, n long")
    return spark.read.format("statestore").load(state).selectExpr("key.digest AS digest", "value.*").toDF("digest", "keep_id", "place", "placed", "n").drop("placed")


def sha256(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, digest=sha256, store: str | None = None) -> DataFrame:
    """Every document with what became of it: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest doc_id stays; a null doc_id is smaller than all. If that doc_id has several rows of the text, each is marked
    as kept. `digest` may be any function of the text: texts that share a digest and differ in bytes are kept apart.

    `store` names a shared folder that keeps texts and state from call to call. Rows of this call are returned; keep_id and
    group_size take in all rows given since the folder began. A call that failed after its texts were written has given its
    rows: the next call takes them in, so it is not repeated. Without `store` all begins and ends with the call.
    """
    folder = store or scratch_path(docs.sparkSession)
    texts, first = stored(docs, digest, folder)
    here = texts.filter(F.col("place") >= first).select("doc_id", "digest", "text_sha256")
    here = here if store else cut(here)
    total = texts.count()
    state = cut(keyed_state(texts, folder))
    apart = cut(_differing(texts, state.filter("n > 1"), total))
    plain = join_groups(here, state.join(apart, "digest", "left_anti").select("digest", "keep_id", "n"), "digest", "n", total)
    out = plain.select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    if not apart.isEmpty():
        odd = having(texts.select("doc_id", "body", "digest", "text_sha256", (F.col("place") >= first).alias("now")), apart, "digest")
        whole = odd.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(cut(odd.filter("now").join(whole, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "text_sha256")))
    if not store:
        remove(docs.sparkSession, f"{folder}/texts")  # nothing reads the bytes any more
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _differing(texts: DataFrame, hit: DataFrame, total: int) -> DataFrame:
    """The digests of `hit` (digest, place, n) under which a text differs from the one that the locator leads to. Copies of a
    heavy digest meet first in the tasks that read them, so few rows of it are left to compare."""
    located = having(texts.select("place", "digest", F.col("body").alias("found")), hit.select("place"), "place").drop("place")
    heavy = hit.filter(F.col("n") > total / HEAVY_KEYS).select("digest")
    light = hit.filter(F.col("n") <= total / HEAVY_KEYS).select("digest")
    bodies = texts.select("digest", "body")
    large = bodies.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest", "body").agg(F.lit(1).alias("one")).drop("one")
    return having(bodies, light, "digest").unionByName(large).join(located, "digest").filter("body <> found").select("digest").distinct()


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts one row with the largest doc_id. All columns stay as they are."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    kept = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    marked = docs.withColumn("quire_sha", F.sha2(text.cast("binary"), 256))
    on = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked["quire_sha"] == kept["text_sha256"])
    return marked.join(kept, on, "left_semi").dropDuplicates(["doc_id", "quire_sha"]).drop("quire_sha")

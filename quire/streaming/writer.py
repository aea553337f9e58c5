"""An append-only document writer as a stream.

Objects (id, size) arrive in micro-batches. Of each id the first that arrives is written, behind all that is written already; a
ledger in the shared folder holds what each micro-batch wrote and where. A micro-batch replaces its own part of the ledger, so
one that is repeated after a stop or a lost driver writes the same again, and the stream goes on from its checkpoint.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import offsets

LEDGER = "id {kind}, size long, byte_offset long, batch long"


def _ledger(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What all micro-batches wrote, each in a folder of its own."""
    return spark.read.schema(LEDGER.format(kind=kind).replace(", batch long", "")).option("basePath", folder).option("recursiveFileLookup", "true").parquet(folder).withColumn("batch", F.regexp_extract(F.input_file_name(), "batch-([0-9]+)/", 1).cast("long"))


def _exists(spark: SparkSession, folder: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_stream(objects: DataFrame, folder: str, start: int = 0, files_per_batch: int | None = None):
    """Starts to write a stream of objects (id, size) to the ledger in `folder`/ledger, from byte `start` on, with what has arrived by now; returns the
    streaming query. Objects of one micro-batch are written by id, of equal ids the smallest. Call it again with the same folder to go on."""
    kind = objects.schema["id"].dataType.simpleString()
    ledger = f"{folder}/ledger"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("id").agg(F.min("size").alias("size"))
        end = start
        if _exists(spark, ledger):
            earlier = _ledger(spark, ledger, kind).filter(F.col("batch") < number)  # a part of this number is one that was cut off
            new = new.join(earlier.select("id"), "id", "left_anti")
            end = max(start, earlier.agg(F.max(F.col("byte_offset") + F.col("size"))).first()[0] or 0)
        if new.isEmpty():
            return
        placed = offsets(new.withColumn("all", F.lit(0)), ["all"], ["id"], "size", "byte_offset").select("id", "size", (F.col("byte_offset") + end).alias("byte_offset"))
        placed.write.mode("overwrite").parquet(f"{ledger}/batch-{number:012d}")

    return objects.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def finish(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """The table of what the stream wrote: (id, size, byte_offset, batch), the same whenever it is read again."""
    ledger = f"{folder}/ledger"
    return _ledger(spark, ledger, kind) if _exists(spark, ledger) else spark.createDataFrame([], LEDGER.format(kind=kind))

"""What several operators of this package share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch_path, shared_folder  # noqa: F401

#: A key is heavy if it has more than a thousandth of all rows, so there are fewer than this many.
HEAVY_KEYS = 1000
#: Ids that may be broadcast to select rows; beyond it the selection is a shuffled join.
BROADCAST_IDS = 1_000_000

#: Vertices from here on stand for texts that have no doc_id.
NAMELESS = 1 << 62

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, at most: texts are long, and a worker holds a batch more than once.
BATCH_OPTION, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder. The session's Arrow batches are lowered to BATCH_ROWS where they are larger: the plans
    that these queries return run later, so the setting stays."""
    if not 0 < int(spark.conf.get(BATCH_OPTION)) <= BATCH_ROWS:
        spark.conf.set(BATCH_OPTION, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """A-Z lower-cased and no other letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def nameless(key):
    """The vertex of a text without doc_id, by the text's key; it comes after all doc_ids."""
    return F.xxhash64(key).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of their group (inner join on key). groups has one row for each key and in `count` its number of rows.

    Keys that hold more than a thousandth of the rows are joined by broadcast, of which there are under HEAVY_KEYS;
    all others by a shuffled join, where no key is then large.
    """
    heavy = groups.filter(F.col(count) > total / HEAVY_KEYS)
    light = groups.filter(F.col(count) <= total / HEAVY_KEYS)
    here = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return here.unionByName(rest)


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids (one column, distinct). A short list is broadcast, a long one is joined by shuffle."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def grouped(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Rows that agree in the keys (long or int), as a dictionary of Arrow columns for each group, through work(columns), which
    gives a tuple of arrays for the schema or None. Groups must be small enough for a task's memory; they follow each
    other in sorted batches, so many small groups cost little."""
    import numpy as np
    import pyarrow as pa

    names = [x.strip().split()[0] for x in schema.split(",")]

    def over(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            columns = [now.column(k).to_numpy() for k in keys]
            new = np.zeros(max(0, len(now) - 1), bool)
            for c in columns:
                new |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield from made(now, starts)
            rest = now.slice(starts[-1])
        if rest is not None and len(rest):
            yield from made(rest, [0, len(rest)])

    def made(t, starts):
        out = [got for a, b in zip(starts[:-1], starts[1:], strict=True) if (got := work({n: t.column(n).slice(a, b - a) for n in t.column_names})) is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(over, schema)


def list_arrays(column):
    """The rows of an Arrow list column as NumPy arrays."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

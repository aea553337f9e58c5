"""A corpus pipeline of operators of quire.llm: every stage reads what the one before it has written."""

from quire.llm import exact_dedup, jaccard, mixing, packing, quality
from quire.llm.common import scratch_path, table
from quire.llm.queries import tokenizer_path


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """Of documents that share 80 percent of their 5-word shingles one stays."""
    return jaccard.one_of_each(docs, 5, 80)


def mixing_stage(spark, docs, sf_dir):
    """Documents stand as often as the mix takes them."""
    return mixing.take(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces and their places in the sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: a classifier is learned, and the mix orders by a hash that DuckDB lacks.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

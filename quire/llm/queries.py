"""The queries opN_<name> over the driver's tables."""

from pyspark.sql import functions as F

from . import arc, collocations, exact_dedup, jaccard, mixing, near_vectors, packing, passages, quality, sharding, suffixes, url_filter, whitening
from .common import table

SHARDS = 24


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_kk_sharding(spark, sf_dir):
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.make_rules(spark, URL_RULES))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_quality_gam(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_near_passages(spark, sf_dir):
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark, sf_dir):
    return suffixes.repeated_spans(table(spark, sf_dir, "documents")).drop("runs")


def op10_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_arc_to_warc(spark, sf_dir):
    return arc.archive(table(spark, sf_dir, "pages")).drop("intact")


QUERIES = {f.__name__: f for f in (op1_kk_sharding, op2_exact_dedup, op3_url_filter, op4_source_mixing, op5_quality_gam, op6_near_vectors, op7_packing, op8_near_passages, op9_suffix_array, op10_jaccard_join, op11_phrase_mining, op12_whitening, op13_arc_to_warc)}

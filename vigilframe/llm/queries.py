"""The queries and SQL of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.llm import curve_neighbours, jaccard_join, mixing, packing, quality_rules, quotation_links, secret_scan, sharding, suffix_dedup, token_counts
from vigilframe.llm.util import table


def op1_curve_neighbours(spark, sf_dir):
    return curve_neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op6_quotation_links(spark, sf_dir):
    return quotation_links.format_chats(table(spark, sf_dir, "conversations"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tag")


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_curve_neighbours, op2_token_counts, op3_jaccard_join, op4_quality_rules, op5_suffix_dedup, op6_quotation_links, op7_best_fit_packing, op8_sharding, op9_mixing, op10_secret_scan)}
SQL = {"op4_quality_rules": quality_rules.SQL, "op6_quotation_links": quotation_links.SQL}

"""Each operator over its whole table with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stonefly.llm import ann, bpe, mixing, pii, quality, rules, secrets, simhash, spans, warc
from stonefly.llm.common import Scratch, input_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pseudonyms(spark, d):
    return pii.pseudonymise(input_table(spark, d, "documents", spread=True))


@query
def op2_adaptive_rules(spark, d):
    return rules.judge(input_table(spark, d, "documents", spread=True))


SQL["op2_adaptive_rules"] = rules.SQL


@query
def op3_secret_scan(spark, d):
    return secrets.find_secrets(input_table(spark, d, "documents", spread=True))


@query
def op4_byte_bpe(spark, d):
    return bpe.digests(input_table(spark, d, "documents", spread=True))


@query
def op5_multi_index(spark, d):
    return ann.nearest(input_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_warc(spark, d):
    root = Scratch(spark).path()
    warc.write(input_table(spark, d, "pages", spread=True), root)
    return warc.read(spark, root).drop("url", "archive")


SQL["op6_warc"] = warc.SQL


@query
def op7_sentence_spans(spark, d):
    return spans.remove_repeats(input_table(spark, d, "documents", spread=True))


@query
def op8_mix_sources(spark, d):
    return mixing.mix(input_table(spark, d, "documents"))


SQL["op8_mix_sources"] = mixing.SQL


@query
def op9_quality_classifier(spark, d):
    return quality.score(input_table(spark, d, "documents", spread=True), input_table(spark, d, "labels"))


@query
def op10_simhash(spark, d):
    return simhash.near_duplicates(input_table(spark, d, "documents", spread=True))


@query
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

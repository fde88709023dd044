"""From raw documents to token ids in five stages, each written and reread as Parquet.

Rejected documents go, one document of each near-duplicate group stays, secrets
are masked, sources are mixed to their targets, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stonefly.llm import bpe, mixing, quality, secrets, simhash
from stonefly.llm.common import Scratch, input_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that it may use, gives a score under its threshold go.

    Null, empty and blank texts are scored by their zero statistics; rows with a null id are scored and train nothing;
    repeated rows share their fate; without labels all stay; all columns pass; no rows give no rows.
    """
    return quality.keep_good(docs, input_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays.

    Null, empty and blank texts are copies of each other; of rows with that id the one of least text hash stays, so exact
    repeats go; a row without an id goes if its group has one with an id; all columns pass; no rows give no rows.
    """
    return simhash.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; all documents stay.

    Null and empty texts have none; repeated rows get the same text; ``n_chars`` follows the text; no rows give no rows.
    """
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: never, once or twice.

    Null and empty texts have size 0; a null source is a source of its own, the last; equal keys go by id, then size, and
    rows alike in both share their fate; all columns pass; no rows give no rows.
    """
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` of every row; null and empty texts have no ids; null ids stay null; repeated rows
    are encoded as often; further columns are left out; no rows give no rows."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The classifier, the fingerprints and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = input_table(spark, sf_dir, "documents", spread=True)
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

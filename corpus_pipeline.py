"""From raw documents to packed token sequences: five stages, each written and read again as the next one's documents.

Every stage takes an empty table and gives an empty one, and all but the last keep the columns that they get, whatever
their names. Rows without doc_id and null texts pass through the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskrisk.llm.common import table, written
from maskrisk.llm.line_dedup import without_lines
from maskrisk.llm.packing import packing_digest
from maskrisk.llm.quality_mil import drop_rejected
from maskrisk.llm.simhash import drop_near_copies
from maskrisk.llm.suffix_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, of the labels in ``sf_dir``.

    Null and empty texts are scored as texts without a word; repeated rows are scored each; without labels the score is
    0.5, which accepts.
    """
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that align with those of an earlier document.

    Every row stays, with an empty text where all its lines go; null texts stay null; repeated rows do not remove each
    other's lines.
    """
    return without_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Texts without a word, null ones included, are copies of each other; of repeated rows of a doc_id one stays; rows
    without doc_id all stay.
    """
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings of an earlier document.

    Every row stays; null texts stay null; a row without doc_id counts as the last; repeated rows do not remove each
    other's bytes.
    """
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids.

    Null and empty texts are a piece of the closing id alone; repeated rows are pieces each.
    """
    import public_tokenizers

    return packing_digest(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

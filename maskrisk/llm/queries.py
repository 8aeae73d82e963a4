"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import token_digest
from .collocations import collocations
from .common import table
from .html_extract import extract
from .line_dedup import line_digest
from .minhash import fingerprint_edits
from .packing import packing_digest
from .prefix_trie import prefix_trie
from .quality_mil import classify
from .quality_rules import judge_quality
from .sentencepiece_codec import round_trip
from .simhash import near_groups
from .suffix_dedup import covered_bytes
from .url_filter import judge_urls

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages`` by URL_RULES; nulls, repeats and empty tables as in ``judge_urls``."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of ``documents`` in sequences of at most 2048 ids; odd rows as in ``token_pieces`` and ``pack``."""
    import public_tokenizers

    return packing_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text of ``documents``, linked at 4 or fewer bits; odd rows as in ``near_groups``."""
    return near_groups(table(spark, sf_dir, "documents"), bits=4, shingle=4)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text of ``documents``, learned from ``labels`` that are not held out; odd rows as in ``train`` and ``score``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text of ``documents``; odd rows as in ``judge_quality``."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents``, of its edited text and of the next; odd rows as in ``fingerprint_edits``."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text of ``documents`` without 50-byte strings of earlier ones; odd rows as in ``covered_bytes``."""
    made = covered_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text of ``documents`` without lines aligned with earlier ones; odd rows as in ``without_lines``."""
    return line_digest(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents`` and what they decode to; a null or empty text has none."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``; odd rows as in ``extract``."""
    return extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``; odd rows as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of ``conversations``; odd rows as in ``prefix_trie``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents`` and what they decode to; odd rows as in ``round_trip``."""
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lines": op2_lines,
    "op3_html": op3_html,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_rules": op7_rules,
    "op8_url_filter": op8_url_filter,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}

"""The corpus pipeline: from raw documents to token ids of a mixed, deduplicated corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written to the shared folder and read again
as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_trie, language_id, mixing, near_dedup, quality_rules
from tidemark.llm.cluster import saved
from tidemark.llm.vocabulary import default_path


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters recognise (operator 2).

    Null texts and texts without a letter go; equal texts share their fate, whatever their labels; ties between languages
    go to the first in code point order. Repeated rows stay repeated. Very long texts are read piece by piece. Other
    columns, whatever their names, pass unchanged. Empty table: no rows.
    """
    return language_id.accepted(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by their host's boilerplate (operator 4).

    Null, empty and short texts go, as they fail the base rules. A null source is a host. Rows equal in id, text and
    source share their fate; repeated rows stay repeated. Other columns pass unchanged. Empty table: no rows.
    """
    return quality_rules.accepted(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 10): the one with the least id.

    Null, empty and wordless texts are groups of their own. Of rows equal in id and text one stays; of an id with several
    texts each text is judged by itself. Other columns pass unchanged. Empty table: no rows.
    """
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, twice at most (operator 8).

    Null text: no words, so it adds none to its source. Null source: a source of its own, the last. Rows equal in id and text are
    interchangeable; reruns agree. All columns pass unchanged. Empty table: no rows.
    """
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text (operator 9).

    Of the columns of documents only these three stay. Null text: as an empty one, no ids. Each copy of a document that the
    mix took is a row. Very long texts are encoded piece by piece. Empty table: no rows.
    """
    return bpe_trie.encoded(docs, default_path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])


STAGES = [("language", recognised), ("quality", good), ("near-dedup", deduplicated), ("mix", mixed), ("bpe", encoded)]

#: No SQL can express the tokenizer or the language filters; tests hold the operators behind the stages against brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

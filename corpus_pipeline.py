"""Documents from raw to packed: quality, repeated lines, near duplicates, source weights, sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import lines, mixing, neardup, packing, quality
from ridgeline.llm.common import save, table

#: For whole documents the mix is made of blocks of some documents each.
MIX_BLOCK_WORDS = 1024


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, doesn't reject.

    Each row is judged by its own text, so ids may repeat or be null; null, empty and blank texts get the score of no evidence; very
    long texts are read whole; an empty table gives none. All columns are kept, whatever their names."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or nearly equals; n_chars follows the text.

    Null texts stay null (n_chars too), texts that lose all lines are empty. Rows that repeat an id and a text keep and lose the same
    lines; null ids come first. An empty table gives none. All other columns are kept, n_lines and n_dropped too if docs has them."""
    out = lines.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8), the one with the least doc_id.

    Decided by row: null ids come last, and of rows that repeat an id and a text one stays. Texts that are null or without words
    all stay. An empty table gives none; all columns are kept."""
    return neardup.one_of_each(docs, words=5, share=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for.

    Rows that share an id share its plan; a null id or source is one like any other. Texts without words (null, empty, blank) are no
    part of a mix and go. An empty table gives none; all columns are kept."""
    plan = save(mixing.mix_sources(docs, block_words=MIX_BLOCK_WORDS), "pipeline-mix")
    return mixing.repeat_documents(docs, plan)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence.

    A null or empty text is a piece of one id, a long one is cut; repeated rows and null ids are packed as often as they come; an
    empty table gives none. Only doc_id and text are read, so other columns cannot clash."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_documents), ("lines", unrepeated_lines), ("near duplicates", near_unique), ("mix", mixed), ("pack", packed)]
#: Trained scores, sketches and seeded choices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else save(docs, f"pipeline-{i}")
    return docs

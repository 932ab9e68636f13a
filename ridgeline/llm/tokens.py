"""Token ids as Parquet list columns that allow selective reads of tokens and of what describes them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, save, text_or_empty
from .encoding import encoder, groups

COLUMNS = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"
#: Ids take a dictionary (a vocabulary fits its page); the sorted and running numbers take delta encoding. Row groups and pages
#: are small enough that a read by doc_id touches few of them; the page index is always written.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def _encode_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts):
                values, bounds = encoder(path, True).encode(texts[a:b])
                values = np.insert(values.astype(np.int32), bounds[1:], end_id)
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every whole text (null: empty) of docs, append end_id to each, and write the ids in ascending order of doc_id.

    The order runs through the files and within each: docs are dealt out by ranges of doc_id before they are encoded. A file holds
    doc_id, its own number (part), the count of ids before the document in it, n_tokens and ids. Null ids come first, equal ids
    go by text. Only doc_id and text are read; an empty table writes files without rows.
    """
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    save(ordered.mapInArrow(_encode_batches(tokenizer, end_id), COLUMNS), path=path, **FILE_OPTIONS)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows with start, the ids before each document: sums within a file and over files. What crosses files is one row per file."""
    totals = spark.read.schema(COLUMNS).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("part", before.alias("base")), "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens; the ids' column chunks aren't read."""
    return _with_start(spark, path, spark.read.schema(COLUMNS).parquet(path)).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids. A filter on doc_id reaches row groups and pages; columns that aren't asked for aren't read."""
    return _with_start(spark, path, spark.read.schema(COLUMNS).parquet(path)).select("doc_id", "start", "n_tokens", "ids")


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        bounds = np.asarray(lists.offsets)
        values = np.asarray(lists.values).astype("<u4")
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of a document's ids, all read back from the files at path."""
    rows = spark.read.schema(COLUMNS).parquet(path)
    crcs = rows.mapInArrow(_crc_batches, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return _with_start(spark, path, save(crcs, "token-crcs")).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """docs written as token files in the shared folder and read back as digests; what the query returns."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)

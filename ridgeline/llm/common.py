"""What the corpus operators share: tables, the shared scratch folder, hashing of byte runs."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; words are what stands between them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_mark(name: str = "text") -> Column:
    """128 bits of the text's SHA-256 (null: of the empty text): which of the rows under one id this is."""
    return F.substring(F.unhex(F.sha2(text_or_empty(name), 256)), 1, 16)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the length of a block; what was set before comes back."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for n, old in before.items():
            spark.conf.unset(n) if old is None else spark.conf.set(n, old)


def matched(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left, whose rows hold texts, joined with right, which has one small row per key: both are shuffled, and each task keeps its part
    of right in a hash table, so that texts are not sorted."""
    return left.join(right.hint("shuffle_hash"), on, how)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right by a sort-merge join: for sides that grow with the input, so that neither is ever broadcast."""
    return left.join(right.hint("merge"), on, how)


#: For tables that are mostly hashes: a dictionary of them is lost work.
HASHES = {"parquet.enable.dictionary": "false"}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "", path: str = "", batch_rows: int = BATCH_ROWS, **options: str) -> DataFrame:
    """Write df to the shared folder (or to path) and read it back: cuts lineage in a way that outlives any executor.

    While it is written, Arrow batches hold batch_rows rows at most, which keeps both ends of the pipe to Python small where texts are
    long, and its shuffle files go when the write is done, as nothing can ask for them again."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(batch_rows), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ridgeline_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files behind frames that save() made and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_ridgeline_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, and each row's bounds in them (nulls: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def blocks(bounds: np.ndarray, most: int = 1 << 18):
    """Row ranges whose bytes come to about `most`, so that work arrays stay small; one row at least."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits of a hash depend on all of its input."""
    shifted = x >> np.uint64(30)
    out = x ^ shifted
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        out *= np.uint64(factor)
        np.right_shift(out, np.uint64(shift), out=shifted)
        out ^= shifted
    return out


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = 256) -> np.ndarray:
    """A 64-bit hash of each run of bytes data[start:end]: eight bytes at a time are mixed in, and runs over `longest` bytes are digested.

    For features that may share a bucket: whoever knows the constants can build two runs of one hash, so nothing is told apart by it."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix64(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    going, at = np.flatnonzero((lengths > 0) & (lengths <= longest)), 0
    while len(going):
        rest = np.minimum(lengths[going] - at, 8).astype(np.uint64)
        block = eight[starts[going] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[going] = mix64(out[going] * np.uint64(0x9E3779B97F4A7C15) ^ block)
        at += 8
        going = going[lengths[going] > at]
    for i in np.flatnonzero(lengths > longest).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class WordHashes:
    """64-bit blake2b hashes of words, one for each key; some KEPT words of up to LONGEST bytes are remembered.

    Under a key that is drawn when a query starts, no text can have been made so that two of its words, or shingles of them, collide."""

    KEPT, LONGEST = 200_000, 48

    def __init__(self, *keys: bytes):
        self.keys, self.known, self.count, self.values = keys, {}, 0, np.zeros((len(keys), 1 << 12), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row of hashes for each key."""
        import pyarrow as pa

        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        if self.count > self.KEPT:
            self.known, self.count = {}, 0
        number_of, first = self.known.get, self.count
        numbers = np.array([number_of(w, -1) for w in different], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            while first + len(new) > self.values.shape[1]:
                self.values = np.concatenate([self.values, np.zeros_like(self.values)], axis=1)
            numbers[new] = np.arange(first, first + len(new))
            fresh = [different[i] for i in new.tolist()]
            self.known.update((w, k) for k, w in enumerate(fresh, first) if len(w) <= self.LONGEST)
            self.count += len(new)
            for k, key in enumerate(self.keys):
                raw = b"".join(hashlib.blake2b(w, digest_size=8, key=key).digest() for w in fresh)
                self.values[k, first : first + len(new)] = np.frombuffer(raw, "<u8")
        return self.values[:, numbers[np.asarray(coded.indices)]]


def digest(data: bytes) -> bytes:
    """A 128-bit name of a content: what is merged without another look must share it."""
    return hashlib.blake2b(data, digest_size=16).digest()


def nodes_of(names: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest: enough for finding candidates, never for merging."""
    return np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)[:, 0]

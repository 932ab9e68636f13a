"""Quality by supervised subword embeddings: hashed words and character n-grams, averaged per document, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, run_hashes, save, settings, text_bytes, text_or_empty

BUCKETS, WIDTH, GRAMS, RECENT = 1 << 18, 16, (3, 5), 8
#: At most so many labelled rows, and so many bytes of their features, are learnt from, those whose hashed ids come first: this is all that reaches the driver.
TRAIN_ROWS, TRAIN_BYTES = 2000, 256 << 20
EPOCHS, RATE, SEED = 12, 8.0, 7
#: Rows whose crc32(doc_id) has this remainder by 3 are held out.
HELD_OUT = 1


def features(data: np.ndarray, bounds: np.ndarray, grams: tuple[int, ...] = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, word pattern and in-word n-gram (first and last byte may be a blank) of each text, and the text it is in."""
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where(blank, np.uint8(32), data)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends_text = bounds[1:][owner]
    inside = ~blank
    first = inside.copy()
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[bounds] = True
    first[1:] &= blank[:-1] | starts_text[1:-1]
    last = inside.copy()
    last[:-1] &= blank[1:] | starts_text[1:-1]
    begins, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    words, whose = run_hashes(data, begins, stops), owner[begins]
    # a word n-gram's pattern: how many words back the same word stands, whatever word it is
    back = np.zeros(len(words), np.uint64)
    for k in range(RECENT, 0, -1):
        back[k:][(words[k:] == words[:-k]) & (whose[k:] == whose[:-k])] = k
    kinds, owners = [words, mix64(back + np.uint64(1 << 60))], [whose, whose]
    blanks = np.concatenate([[0], np.cumsum(blank)])
    place = np.arange(len(data))
    for n in grams:
        if len(data) < n:
            continue
        ok = np.flatnonzero((place[: len(data) - n + 1] + n <= ends_text[: len(data) - n + 1]) & (blanks[n - 1 : len(data)] == blanks[1 : len(data) - n + 2]))
        code = np.zeros(len(ok), np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + data[ok + k]
        kinds.append(mix64(code + np.uint64(n << 56)))
        owners.append(owner[ok])
    return (np.concatenate(kinds) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(owners)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column(2))
        out = []
        for i in range(batch.num_rows):
            found, times = np.unique(features(data, bounds[i : i + 2])[0], return_counts=True)
            out.append((found.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "quality", "found", "times"])


@dataclass
class Model:
    """Softmax over two classes of a document's mean embedding. As only the difference of the logits counts, each bucket's
    embedding is kept as its share of that difference (margins); bias is the rest."""

    margins: np.ndarray
    bias: float

    def score(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.bias, -60, 60)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling linearly to 0. examples: buckets, counts, label 0 or 1.

    Both classes weigh the same in all. Without examples of both classes the score is the smoothed share of label 1."""
    ones = sum(y for _, _, y in examples)
    if not 0 < ones < len(examples):
        return Model(np.zeros(buckets, np.float32), float(np.log((ones + 1) / (len(examples) - ones + 1))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    shares = [(at, (n / max(n.sum(), 1)).astype(np.float32), y) for at, n, y in examples]
    weight = np.array([len(examples) / (2 * (len(examples) - ones)), len(examples) / (2 * ones)], np.float32)
    steps, step = epochs * len(shares), 0
    for _ in range(epochs):
        for i in rng.permutation(len(shares)):
            at, share, y = shares[i]
            now = rate * (1 - step / steps)
            mean = share @ vectors[at]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[y] -= 1
            slope *= weight[y]
            back = out @ slope
            out -= 0.1 * now * np.outer(mean, slope)
            bias -= 0.01 * now * slope
            # a share is tiny, so rows move at the rate of a text of few features
            vectors[at] -= now * np.sqrt(share)[:, None] * back / np.sqrt(len(at))
            step += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality from at most `rows` labelled documents that are not held out.

    The sample is the label rows whose hashed ids are smallest, so it is the same at every run. Labels other than 0 and 1, null
    ids, and labels without a document teach nothing; of contradicting labels of a document the lower counts."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample has `rows` rows of 12 bytes at most; of what is learnt from, TRAIN_BYTES come to the driver at most, in the same order
    joined = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    made = save(joined.mapInArrow(_feature_batches, "doc_id bigint, quality int, found binary, times binary"), "quality-sample")
    place = F.struct(F.xxhash64("doc_id").alias("at"), "doc_id")
    sizes = sorted(tuple(r) for r in made.select(place["at"], "doc_id", (F.octet_length("found") + F.octet_length("times")).cast("bigint")).collect())
    fits = int(np.searchsorted(np.cumsum([n for *_, n in sizes], dtype=np.int64), TRAIN_BYTES, "right"))
    if fits < len(sizes):
        at, doc_id, _ = sizes[fits]
        made = made.where(place < F.struct(F.lit(at).alias("at"), F.lit(doc_id).alias("doc_id")))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        got = made.toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    found, times, quality = (got.column(c).to_pylist() for c in ("found", "times", "quality"))
    return fit([(np.frombuffer(found[i], "<u4").astype(np.int64), np.frombuffer(times[i], "<u4"), quality[i]) for i in order])


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            scores = []
            for a, b in blocks(bounds):
                at, owner = features(data, bounds[a : b + 1])
                sums, counts = np.bincount(owner, model.margins[at], b - a), np.bincount(owner, minlength=b - a)
                scores.append(model.score(sums, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (higher: label 1 likelier) of every whole text, from its bytes alone; null and blank texts have the model's bias."""
    return save(docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_score_batches(model), "doc_id bigint, score double"), "scores")


def _keep_batches(model: Model, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(at))
            scores = [np.zeros(0)]
            for a, b in blocks(bounds):
                found, owner = features(data, bounds[a : b + 1])
                scores.append(model.score(np.bincount(owner, model.margins[found], b - a), np.bincount(owner, minlength=b - a)))
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return run


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold; each row is judged by itself, so ids may repeat or be null."""
    return save(docs.mapInArrow(_keep_batches(model, threshold, docs.columns.index("text")), docs.schema), "good")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the query returns: doc_id, held_out, score, predicted for every row of docs (none for an empty table).

    Each row is scored by its own whole text, however long, so rows that repeat an id or a text are scored alike and null ids like others; null, empty and
    blank texts get the score of no evidence. Only doc_id and text are read, so other columns cannot clash."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

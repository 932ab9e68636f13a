"""Media columns as ISO base media files: a writer for raw 8-bit frames, and a reader that walks boxes and sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save, text_or_empty

#: A frame is 8 by 8 grey pixels of 8 bits; every GOP-th frame is a key frame and begins a chunk.
SIDE, GOP, TIMESCALE = 8, 16, 25
FRAME = SIDE * SIDE
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """payload and zero bytes up to a positive multiple of the frame size."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def mux(payload: bytes) -> bytes:
    """One video track of raw grey frames that hold payload, whose length is a multiple of the frame size."""
    n = len(payload) // FRAME
    chunks = -(-n // GOP)
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )
    to_chunk = [(1, GOP, 1)] if n >= GOP else []
    if n % GOP:
        to_chunk.append((chunks, n % GOP, 1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (GOP * FRAME)
        wide = bool(offsets[-1] >> 32)
        table = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            _full(b"stss", 0, struct.pack(">I", chunks), (np.arange(chunks) * GOP + 1).astype(">u4").tobytes()),
            _full(b"stsc", 0, struct.pack(">I", len(to_chunk)), *(struct.pack(">III", *x) for x in to_chunk)),
            _full(b"stsz", 0, struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), table),
        )
        track = _full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        return _box(b"moov", _full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, media))

    before = len(head) + len(movie(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return head + movie(before) + _box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box in data as (path, start of its body, end); containers before what they hold. Raises ValueError if a box overruns."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError(f"cut box at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} overruns")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _table(data: memoryview, at: int, dtype: str, skip: int = 4, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + skip)
    return np.frombuffer(data, dtype, n * width, at + skip + 4).astype(np.int64).reshape(n, width) if width > 1 else np.frombuffer(data, dtype, n, at + skip + 4).astype(np.int64)


def _read_track(data: memoryview, boxes: dict[bytes, int]) -> dict:
    version = data[boxes[b"mdhd"]]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, boxes[b"mdhd"] + (20 if version else 12))
    codec = bytes(data[boxes[b"stsd"] + 12 : boxes[b"stsd"] + 16]).decode("latin-1")
    fixed, n = struct.unpack_from(">II", data, boxes[b"stsz"] + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else _table(data, boxes[b"stsz"], ">u4", 8)
    chunks = _table(data, boxes[b"co64"], ">u8") if b"co64" in boxes else _table(data, boxes[b"stco"], ">u4")
    runs = _table(data, boxes[b"stsc"], ">u4", width=3)
    reps = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    per_chunk = np.repeat(runs[:, 1], reps)
    if per_chunk.sum() != n:
        raise ValueError("sample tables disagree")
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk] + before - before[np.minimum(first, max(n - 1, 0))][chunk] if n else np.zeros(0, np.int64)
    keys = _table(data, boxes[b"stss"], ">u4") - 1 if b"stss" in boxes else np.arange(n)
    return {"codec": codec, "handler": bytes(data[boxes[b"hdlr"] + 8 : boxes[b"hdlr"] + 12]).decode("latin-1"), "timescale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys}


def read_tracks(media: bytes) -> list[dict]:
    """Codec, duration, sample and key-frame places of each track; payload bytes are not touched."""
    data, tracks = memoryview(media), []
    for path, body, _ in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], body)
    return [_read_track(data, boxes) for boxes in tracks]


def read_payload(media: bytes, track: dict) -> bytes:
    """The bytes of all samples in order; neighbouring samples are read as one range."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, cuts)], (offsets + sizes)[np.append(cuts - 1, len(offsets) - 1)]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [t.encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each whole text (null: empty) as the frames of an ISO media file.

    Equal texts give equal files. Only doc_id and text are read; rows may repeat; an empty table gives no rows."""
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_mux_batches, "doc_id bigint, n_bytes bigint, media binary")


INDEX = "doc_id bigint, n_bytes bigint, codec string, timescale bigint, duration bigint, samples bigint, keyframes array<struct<offset:bigint,length:bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, error string"


def _index_one(media: bytes) -> dict:
    out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        track = next(iter(read_tracks(media)), None)
        if track is None:
            return out | {"error": "no track"}
        payload = read_payload(media, track)
        keys = track["keys"]
        return out | {
            "codec": track["codec"], "timescale": track["timescale"], "duration": track["duration"], "samples": len(track["sizes"]),
            "keyframes": [{"offset": o, "length": n} for o, n in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist(), strict=True)],
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        }
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            rows = [{} if m is None else _index_one(m) for m in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_pylist([r | {"doc_id": d, "n_bytes": n} for r, d, n in zip(rows, part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], ARROW_INDEX)


ARROW_INDEX = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()),
     ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())]
)


def index_media(stored: DataFrame) -> DataFrame:
    """Codec, duration, key-frame byte ranges and payload digests of a table with doc_id, n_bytes and media.

    A null file gives nulls; a broken one gives its size, digest and an error. Nothing is decoded: boxes and sample tables
    are walked, and payload bytes are only copied for their digests."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_index_batches, INDEX)


def media_features(docs: DataFrame) -> DataFrame:
    """docs stored as media files in the shared folder, read back and indexed; what the query returns."""
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    feature = F.concat(F.lit("codec="), "codec", F.lit(";duration="), F.col("duration").cast("string"), F.lit("/"), F.col("timescale").cast("string"), F.lit(";samples="), F.col("samples").cast("string"), F.lit(";keyframes="), ranges)
    stored = save(encode_media(docs), "media", **{"parquet.block.size": str(16 << 20)})
    out = save(index_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")), "media-index")
    forget(stored)
    return out

"""Media columns: AVI files of motion-JPEG frames, and the clips between their shot changes.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of grey frames 64 samples
wide and up to 64 rows high. Frames are intra-coded by lossless JPEG (SOF3, the left neighbour predicts a sample). Its
Huffman table gives the difference category k a code of 9 - k bits, so that every sample takes nine bits with the k
bits that follow and numpy packs and unpacks whole frames. The file is RIFF AVI: header lists, a movi list with a
chunk for each frame, and the idx1 index.

Reading goes by the index, or by a walk over the movi list where the index is absent. It takes these frames and those
of ordinary motion-JPEG files, baseline DCT with any tables (module dct), of which the luma plane counts; other codings
raise ValueError. Shots change where the histogram difference of neighbouring frames exceeds the mean plus SPREAD
deviations of the differences so far in the shot.

Defined cases: a null or empty text is 64 zero bytes in one frame; equal texts give equal files and features, repeated
rows equal rows; a null doc_id is kept; a text of any length goes into one file, frame by frame; a null media value gives
no clip; an empty table gives an empty result; only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents
from .dct import decode_baseline

WIDTH, HEIGHT, FRAMES_PER_SECOND = 64, 64, 25
SPREAD, LEAST_DIFFERENCE = 3.0, 0.25
CHUNK_BYTES = 1 << 22


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Nine bits for each difference from -255 to 255, and the difference of each nine bits."""
    code, difference = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        bits = d if d > 0 else d + (1 << k) - 1
        code[d + 255] = (((1 << (8 - k)) - 1) << (k + 1)) | bits
        difference[code[d + 255]] = d
    return code, difference


CODE, DIFFERENCE = _codes()
#: One code of each length from 1 to 9, for the categories from 8 down to 0.
HUFFMAN = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = b"\xff\xd8" + _segment(0xE0, b"AVI1" + bytes(12)) + _segment(0xC4, b"\x00" + HUFFMAN)
SCAN = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frame(samples: np.ndarray) -> bytes:
    """A lossless JPEG of a uint8 array of some rows of WIDTH samples."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[0, 0] = x[0, 0] - 128
    w = CODE[d.ravel() + 255].reshape(-1, 8)
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = ((w[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (w[:, j] >> (j + 1))
    out[:, 8] = w[:, 7] & 255
    header = _segment(0xC3, struct.pack(">BHHBBBB", 8, x.shape[0], x.shape[1], 1, 1, 0x11, 0))
    return TABLES + header + SCAN + out.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples of a frame, or the luma plane of a baseline one."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, rows, columns, table = 2, 0, 0, b""
    while True:
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            table = body[1:]
        elif marker == 0xC3:
            precision, rows, columns, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only grey 8-bit frames are read")
        elif 0xC0 <= marker <= 0xCF:
            return decode_baseline(jpeg)
        elif marker == 0xDA:
            break
    if table != HUFFMAN or columns % 8 or body[3] != 1:
        raise ValueError("another table of codes, width or predictor")
    b = np.frombuffer(jpeg[at : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        w[:, i] = ((b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1)) | (b[:, i + 1] >> (7 - i))
    d = DIFFERENCE[w.ravel()].reshape(rows, columns)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1, dtype=np.int16).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(payload: bytes) -> bytes:
    """The file of a payload whose length is a positive multiple of WIDTH."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [encode_frame(samples[i : i + HEIGHT]) for i in range(0, len(samples), HEIGHT)]
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, most * FRAMES_PER_SECOND, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    at, index, movie = 4, [], []
    for x in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        movie.append(_chunk(b"00dc", x))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + headers + _list(b"movi", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def frame_spans(avi: bytes) -> list[tuple[int, int]]:
    """Start and end of each frame's JPEG in the file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index = 12, None, None
    while at + 8 <= len(avi):
        name, size = struct.unpack_from("<4sI", avi, at)
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movie = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + size % 2
    if movie is None:
        raise ValueError("no movi list")
    if index:
        entries = [e for e in struct.iter_unpack("<4sIII", avi[index[0] : index[0] + index[1]]) if e[0][2:] in (b"dc", b"db")]
        return [(movie[0] + at + 8, movie[0] + at + 8 + size) for _, _, at, size in entries]
    spans, at = [], movie[0] + 4
    while at + 8 <= movie[1]:
        name, size = struct.unpack_from("<4sI", avi, at)
        spans += [(at + 8, at + 8 + size)] * (name[2:] in (b"dc", b"db"))
        at += 8 + size + size % 2
    return spans


def read_avi(avi: bytes) -> list[np.ndarray]:
    return [decode_frame(avi[a:b]) for a, b in frame_spans(avi)]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First frame and the one after the last of each shot."""
    if not frames:
        return []
    bins = [np.bincount(x.ravel() >> 4, minlength=16) / x.size for x in frames]
    cuts, seen = [0], []
    for i in range(1, len(bins)):
        d = float(np.abs(bins[i] - bins[i - 1]).sum() / 2)
        limit = max(LEAST_DIFFERENCE, float(np.mean(seen) + SPREAD * np.std(seen))) if seen else LEAST_DIFFERENCE
        if d > limit:
            cuts.append(i)
            seen = []
        else:
            seen.append(d)
    return list(zip(cuts, [*cuts[1:], len(bins)], strict=True))


def clips(frames: list[np.ndarray]) -> list[dict]:
    """A row for each shot: its times in milliseconds, frames and mean sample."""
    step = 1000 // FRAMES_PER_SECOND
    return [
        {"clip": k, "start_ms": a * step, "end_ms": b * step, "frames": b - a, "mean": int(sum(int(x.sum()) for x in frames[a:b]) // sum(x.size for x in frames[a:b]))}
        for k, (a, b) in enumerate(shots(frames))
    ]


CLIP = pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32()), ("mean", pa.int32())])
CLIPS_SQL = "array<struct<clip:int,start_ms:bigint,end_ms:bigint,frames:int,mean:int>>"


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, files, held = 0, [], [], 0
            for n, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                files.append(write_avi(data + b"\0" * (-len(data) % 64 or 64 * (not data))))
                held += len(files[-1])
                if held >= CHUNK_BYTES or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    at, sizes, files, held = n + 1, [], [], 0

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def with_clips(media: DataFrame) -> DataFrame:
    """media's rows with digests of what is read back and an array of clips; explode it for timed clip rows."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(CLIP)]

    def row(avi: bytes | None) -> tuple:
        if avi is None:
            return (None,) * 5 + ([],)
        frames = read_avi(avi)
        payload = b"".join(x.tobytes() for x in frames)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), clips(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column(2)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, clips {CLIPS_SQL}"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each clip of each file."""
    return with_clips(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as an AVI file, read back."""
    feature = F.array_join(
        F.transform("clips", lambda c: F.concat_ws(":", *[c[x].cast("string") for x in ("clip", "start_ms", "end_ms", "frames", "mean")])), ";"
    )
    return with_clips(with_media(documents(spark, sf_dir))).withColumn("feature", feature).drop("clips")


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips of every text as an AVI file."""
    return clip_rows(with_media(documents(spark, sf_dir)))

"""Media columns: motion JPEG in AVI files.

Bytes become frames of uniform 8 x 8 blocks, whose only coefficient is the block's grey level, so a baseline JPEG keeps
them exactly. A file holds the frames with a RIFF index. Reading parses the index, decodes the intra frames and finds
shots where the histogram changes by more than the recent changes suggest; shots are timed clips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Blocks of a frame's side; 1024 samples a frame.
SIDE = 32
FRAME = SIDE * SIDE
#: Blocks between restart markers.
RUN = 64
FPS = 25
UNIT = 64
#: Samples that are coded at once.
SLICE = 1 << 21
BINS = 16
RECENT = 8


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(side: int = SIDE) -> bytes:
    """Start of a grey baseline JPEG: steps of 8, so a level is its DC coefficient plus 128; level differences of 0 to 8
    bits have codes of 4 bits in order, the end of a block has one bit; a restart after every ``RUN`` blocks."""
    return (b"\xff\xd8" + segment(0xDB, b"\x00" + bytes([8] * 64)) + segment(0xC0, struct.pack(">BHHB3B", 8, 8 * side, 8 * side, 1, 1, 0x11, 0))
            + segment(0xC4, b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))) + segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
            + segment(0xDD, struct.pack(">H", RUN)) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"))


def encode_frames(levels: np.ndarray) -> list[bytes]:
    """A JPEG for each row of ``FRAME`` grey levels."""
    runs = levels.reshape(-1, RUN).astype(np.int32)
    diff = np.diff(runs, axis=1, prepend=128)
    bits = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    value = (bits << (bits + 1)) | (np.where(diff < 0, diff + (1 << bits) - 1, diff) << 1)
    width = bits + 5
    ends = np.cumsum(width, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = (8 * first)[:, None] + ends - width
    word = (value << (24 - (at & 7) - width)).ravel()
    byte, n = (at >> 3).ravel(), int(size.sum())
    raw = np.zeros(n + 2)
    for k in range(3):  # the bits of a byte come from different words, so their sum is their union
        raw += np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, n + 2)
    raw = raw[:n].astype(np.int32)
    last = first + size - 1
    raw[last] |= (1 << (8 * size - ends[:, -1])) - 1
    header = frame_header()
    run_of = np.repeat(np.arange(len(runs)), size)
    per = FRAME // RUN
    stuffed = np.concatenate(([0], np.cumsum(raw == 255)))
    out_at = np.arange(n) + stuffed[:-1] + 2 * run_of + len(header) * (run_of // per + 1)
    out = np.zeros(n + int(stuffed[-1]) + 2 * len(runs) + len(header) * len(levels), np.uint8)
    out[out_at] = raw
    index = np.arange(len(runs))
    mark = last + 1 + stuffed[last + 1] + 2 * index + len(header) * (index // per + 1)
    out[mark] = 255
    out[mark + 1] = np.where(index % per == per - 1, 0xD9, 0xD0 + index % per % 8)
    stops = mark[per - 1::per] + 2
    starts = np.concatenate(([0], stops[:-1]))
    out[(starts[:, None] + np.arange(len(header))).ravel()] = np.tile(np.frombuffer(header, np.uint8), len(levels))
    data = out.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def scan_of(jpeg: bytes) -> bytes:
    """The coded data of a frame, from behind the scan header to the end marker."""
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return jpeg[at:]


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The grey levels of the frames, one row each; all restart runs are read side by side."""
    data = np.frombuffer(b"".join(map(scan_of, jpegs)), np.uint8)
    full = data[:-1] == 255
    stuffing, marks = full & (data[1:] == 0), full & (data[1:] != 0)
    keep = np.ones(len(data), bool)
    keep[1:][stuffing] = False
    keep[:-1][marks] = False
    keep[1:][marks] = False
    ends = np.cumsum(keep)[:-1][marks]
    raw = np.concatenate((data[keep], np.zeros(4, np.uint8))).astype(np.int32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = 8 * np.concatenate(([0], ends[:-1]))
    level, out = np.full(len(ends), 128, np.int32), np.zeros((len(ends), RUN), np.uint8)
    for k in range(RUN):
        word = (window[at >> 3] << (at & 7)) & 0xFFFFFF
        bits = word >> 20
        value = (word >> (20 - bits)) & ((1 << bits) - 1)
        level += np.where(value >> np.maximum(bits - 1, 0), value, value - (1 << bits) + 1) * (bits > 0)
        out[:, k] = level
        at = at + bits + 5
    return out.reshape(-1, FRAME)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], n_bytes: int, payload: int) -> bytes:
    """An AVI file of the frames; the stream's data chunk has the bytes of the text and of the payload."""
    width, most = 8 * SIDE, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, width, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, width)
    image = struct.pack("<I2i2H4s5I", 40, width, width, 1, 8, b"MJPG", width * width, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", stream) + chunk(b"strf", image) + chunk(b"strd", struct.pack("<2Q", n_bytes, payload))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", strl))
    entries, at = [], 4
    for f in frames:
        entries.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(entries)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in ``data[at:end]``; a list has its kind as name."""
    while at + 8 <= end:
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8:at + 12], at + 12, at + 8 + size
        else:
            yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """The frames that the index lists, and the bytes of text and payload."""
    (kind, at, end), = list(chunks(data, 0, len(data)))[:1]
    if kind != b"AVI ":
        raise ValueError("no AVI file")
    parts = {name: (a, b) for name, a, b in chunks(data, at, end)}
    stream = dict((name, (a, b)) for name, a, b in chunks(data, *next((a, b) for name, a, b in chunks(data, *parts[b"hdrl"]) if name == b"strl")))
    n_bytes, payload = struct.unpack_from("<2Q", data, stream[b"strd"][0])
    base, (a, b) = parts[b"movi"][0] - 4, parts[b"idx1"]
    return [data[base + o + 8:base + o + 8 + n] for _, _, o, n in struct.iter_unpack("<4s3I", data[a:b])], n_bytes, payload


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A cut lies before a frame whose histogram differs from the one before by more than the mean of the last ``RECENT``
    differences plus twice their deviation, and by a tenth of the picture at least.
    """
    n = len(levels)
    hist = np.bincount((np.arange(n)[:, None] * BINS + (levels >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * levels.shape[1])
    cuts = []
    for i, c in enumerate(change.tolist()):
        recent = change[max(0, i - RECENT):i]
        limit = max(0.1, float(recent.mean() + 2 * recent.std()) if len(recent) else 0.3)
        if c > limit:
            cuts.append(i + 1)
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = utf8(text)
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def runs_of(sizes: list[int]) -> list[range]:
    """Consecutive rows of about ``SLICE`` bytes together."""
    cuts, size = [0], 0
    for i, n in enumerate(sizes):
        if size + n > SLICE and i > cuts[-1]:
            cuts.append(i)
            size = 0
        size += n
    return [range(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if b > a]


def encode_all(texts: list[str | None]) -> list[bytes]:
    """An AVI file for each text."""
    raw = [payload_of(t) for t in texts]
    whole = b"".join(p + bytes(-len(p) % FRAME) for p, _ in raw)
    levels = np.frombuffer(whole, np.uint8).reshape(-1, FRAME)
    step = SLICE // FRAME
    frames = [f for k in range(0, len(levels), step) for f in encode_frames(levels[k:k + step])]
    files, at = [], 0
    for p, n in raw:
        count = -(-len(p) // FRAME)
        files.append(avi(frames[at:at + count], n, len(p)))
        at += count
    return files


def decode_all(files: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """Frames, bytes of the text and of the payload of each file."""
    read = [read_avi(f) for f in files]
    jpegs = [j for frames, _, _ in read for j in frames]
    step = SLICE // FRAME
    levels = np.concatenate([decode_frames(jpegs[k:k + step]) for k in range(0, len(jpegs), step)])
    ends = np.cumsum([len(frames) for frames, _, _ in read])
    return [(part, n, p) for part, (_, n, p) in zip(np.split(levels, ends[:-1]), read, strict=True)]


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: each text's bytes, filled up with zeros to a multiple of 64, as an AVI file. A null text is empty."""
    inputs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in runs_of([len(t or "") for t in texts]):
                files = encode_all([texts[i] for i in part])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(part.start, len(part)), pa.array(files, pa.binary())], names=["key", "media"])

    return inputs.mapInArrow(run, inputs.select("key").schema.add("media", "binary"))


CLIP = "array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"


def read_media(media: DataFrame) -> DataFrame:
    """key, digests of what the files of ``media`` (key, media) hold, their clips and a feature string."""
    fields = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIP}, feature string"
    schema = media.select("key").schema
    for field in media.sparkSession.createDataFrame([], fields).schema:
        schema = schema.add(field)

    def row(file: bytes, levels: np.ndarray, n_bytes: int, size: int) -> tuple:
        payload = levels.tobytes()[:size]
        found = shots(levels)
        clips = [(i, a, b, a / FPS, b / FPS) for i, (a, b) in enumerate(found)]
        feature = f"frames={len(levels)};shots={len(found)};cuts={','.join(str(a) for a, _ in found[1:])}"
        return (n_bytes, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), clips, feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in batches:
            files = batch.column("media").to_pylist()
            for part in runs_of([len(f) for f in files]):
                mine = [files[i] for i in part]
                rows = [row(f, *d) for f, d in zip(mine, decode_all(mine), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(part.start, len(part)), *(
                    pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return media.select("key", "media").mapInArrow(run, schema)


def clips(read: DataFrame) -> DataFrame:
    """A row for each shot: key, clip, first_frame, end_frame, start_s, end_s."""
    return read.select("key", F.explode("clips").alias("c")).select("key", "c.*")


def op10(docs: DataFrame) -> DataFrame:
    return read_media(stored(docs)).drop("clips").withColumnRenamed("key", "doc_id")

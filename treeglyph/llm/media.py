"""Media columns: texts as ISO media files, and a reader that walks boxes without decoding payloads.

``write_iso`` stores a payload, a multiple of 64 bytes, as the frames of an uncompressed 8 x 8 grey track of 8-bit samples.
``read_iso`` walks nested boxes of any such container, decodes the sample tables of every track (stts, stsc, stsz or stz2, stco or
co64, stss) and gives codec, duration and the byte ranges of keyframes; contiguous ranges are merged. The duration is that of mdhd or, where that has
none (0, or all bits set), the sum of stts. Composition offsets (ctts) change neither and are not decoded. Samples in fragments (moof) are not read.

Nulls are as empty texts; an empty text is stored as 64 zero bytes; other columns are ignored; equal texts give equal values; an empty table gives an empty
result. ``media_features`` gives null for what isn't an ISO media file or has tables that are cut short, contradict each other or lead out of the file.
What a table's count makes the reader hold is bounded by the file's size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

FRAME, PER_CHUNK, TIMESCALE, TICK = 64, 1024, 25, 1
#: Boxes whose content is boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex"))
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(text: bytes) -> bytes:
    return text + bytes(FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def write_iso(payload: bytes) -> bytes:
    n = len(payload) // FRAME
    chunks, last = -(-n // PER_CHUNK), n - (-(-n // PER_CHUNK) - 1) * PER_CHUNK
    runs = [(1, min(n, PER_CHUNK), 1)] + ([(chunks, last, 1)] if chunks > 1 and last != PER_CHUNK else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    tables = [
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, TICK)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
    ]
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAME * PER_CHUNK)
        wide = first + len(payload) > 0xFFFFFFFF
        stco = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">i8" if wide else ">u4").tobytes())
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *tables, stco))
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * TICK, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * TICK), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * TICK, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    # the size of moov doesn't depend on the offsets in it, unless they need 64 bits
    first = len(ftyp) + len(moov(0)) + 8
    head = struct.pack(">I4s", len(payload) + 8, b"mdat")
    if len(payload) + 8 > 0xFFFFFFFF:
        head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
        first = len(ftyp) + len(moov(1 << 33)) + 16
    return ftyp + moov(first) + head + payload


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    n_samples: int = 0

    def ranges(self, keyframes: bool = True) -> list[tuple[int, int]]:
        """Offset and length of the samples, or of those that are keyframes, with contiguous ones merged."""
        o, s = (self.offsets[self.keys], self.sizes[self.keys]) if keyframes else (self.offsets, self.sizes)
        if not len(o):
            return []
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1] + s[:-1]])
        ends = np.r_[starts[1:], len(o)] - 1
        return [(int(o[a]), int(o[b] + s[b] - o[a])) for a, b in zip(starts, ends, strict=True)]


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box in data[at:end]; stops at what isn't a box."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield bytes(kind), at + head, at + size
        at += size


class MediaError(ValueError):
    """Boxes or tables that can't be what they say."""


DEEPEST = 16


def read_iso(data: bytes, file_size: int | None = None) -> list[Track]:
    """The tracks of a file, or of its head (then ``file_size`` is that of the whole); MediaError where a table can't be what it says."""
    view, tracks = memoryview(data), []

    def walk(at: int, end: int, track: Track | None, depth: int) -> None:
        if depth > DEEPEST:
            raise MediaError("boxes are nested too deep")
        for kind, a, b in boxes(view, at, end):
            if kind == b"trak":
                tracks.append(own := Track())
                walk(a, b, own, depth + 1)
            elif kind in CONTAINERS:
                walk(a, b, track, depth + 1)
            elif track is not None and kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
                track.tables[kind] = bytes(view[a:b])

    walk(0, len(view), None, 0)
    for t in tracks:
        try:
            _decode(t, file_size or len(view))
        except struct.error as e:
            raise MediaError(f"a table is too short: {e}") from e
    return tracks


def _ints(x: bytes, kind: str, at: int, count: int) -> np.ndarray:
    if count * np.dtype(kind).itemsize > len(x) - at:
        raise MediaError("a table is shorter than its count")
    return np.frombuffer(x, kind, count, at).astype(np.int64)


def _sizes(x: dict[bytes, bytes], file_size: int) -> np.ndarray:
    if h := x.get(b"stsz"):
        size, n = struct.unpack_from(">II", h, 4)
        if size and n > file_size // size:
            raise MediaError("more samples than the file has room for")
        return np.full(n, size, np.int64) if size else _ints(h, ">u4", 12, n)
    if not (h := x.get(b"stz2")):
        return np.empty(0, np.int64)
    bits, n = struct.unpack_from(">BI", h, 7)
    if bits == 4:
        pairs = _ints(h, ">u1", 12, -(-n // 2))
        return np.c_[pairs >> 4, pairs & 15].ravel()[:n]
    if bits not in (8, 16):
        raise MediaError(f"sizes of {bits} bits")
    return _ints(h, f">u{bits // 8}", 12, n)


def _decode(t: Track, file_size: int) -> None:
    x = t.tables
    if h := x.get(b"mdhd"):
        t.timescale, t.duration = struct.unpack_from(">IQ", h, 20) if h[0] else struct.unpack_from(">II", h, 12)
        if t.duration in (0, (1 << 64) - 1 if h[0] else (1 << 32) - 1):
            t.duration = 0
            if h := x.get(b"stts"):
                runs = _ints(h, ">u4", 8, 2 * struct.unpack_from(">I", h, 4)[0])
                t.duration = sum(n * ticks for n, ticks in zip(runs[::2].tolist(), runs[1::2].tolist()))
    if h := x.get(b"hdlr"):
        t.handler = h[8:12].decode("latin-1")
    if (h := x.get(b"stsd")) and len(h) >= 16:
        t.codec = h[12:16].decode("latin-1")
    t.sizes = _sizes(x, file_size)
    t.n_samples = n = len(t.sizes)
    h = x.get(b"co64") or x.get(b"stco")
    at = _ints(h, ">i8" if b"co64" in x else ">u4", 8, struct.unpack_from(">I", h, 4)[0]) if h else np.empty(0, np.int64)
    if n and len(at) and (h := x.get(b"stsc")):
        runs = _ints(h, ">u4", 8, 3 * struct.unpack_from(">I", h, 4)[0]).reshape(-1, 3)
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
            raise MediaError("chunks aren't in order")
        per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(at) + 1), "right") - 1, 1]
        ends = np.cumsum(np.minimum(per, n))
        sample = np.arange(min(n, int(ends[-1])))
        chunk = np.searchsorted(ends, sample, "right")
        before = np.cumsum(t.sizes) - t.sizes
        t.offsets = at[chunk] + before[: len(sample)] - before[np.r_[0, ends][chunk]]
        if (t.offsets < 0).any():
            raise MediaError("samples before the file")
    t.sizes = t.sizes[: len(t.offsets)]
    h = x.get(b"stss")
    keys = _ints(h, ">u4", 8, struct.unpack_from(">I", h, 4)[0]) - 1 if h else np.arange(len(t.offsets))
    t.keys = keys[(keys >= 0) & (keys < len(t.offsets))]


def describe(tracks: list[Track]) -> str:
    """One line for all tracks: handler, codec, duration in seconds, samples, keyframes and their byte ranges."""
    return ";".join(f"{t.handler}/{t.codec.strip()} {t.duration / (t.timescale or 1):.2f}s n={t.n_samples} key={len(t.keys)} at={','.join(f'{a}+{b}' for a, b in t.ranges())}" for t in tracks)


def with_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and ``media`` binary: the text's payload as an ISO media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 256):
                raw = [t.as_py().encode() if t.is_valid else b"" for t in texts.slice(at, 256)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(list(map(len, raw)), pa.int64()), pa.array([write_iso(pad(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string")), run, f"{id_col} {kind}, n_bytes long, media binary")


def media_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What with_media gives, with codec, duration_s and keyframes (byte ranges), and digests of what the sample tables lead to."""
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,length:long>>"
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def one(data: bytes | None) -> tuple:
        try:
            tracks = read_iso(data) if data is not None else []
        except MediaError:
            tracks = []
        if not tracks or any((t.offsets + t.sizes > len(data)).any() for t in tracks):
            return (None,) * 9
        sha, tail, size = hashlib.sha256(), b"", 0
        view = memoryview(data)
        for t in tracks:
            for a, b in t.ranges(keyframes=False):
                sha.update(view[a : a + b])
                tail, size = (tail + bytes(view[a : a + b][-FRAME:]))[-FRAME:], size + b
        first = tracks[0]
        keys = [{"offset": a, "length": b} for t in tracks for a, b in t.ranges()]
        return size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), describe(tracks), first.codec.strip(), first.duration / (first.timescale or 1), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges]
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return map_arrow(media.select(id_col, "n_bytes", "media"), run, schema)

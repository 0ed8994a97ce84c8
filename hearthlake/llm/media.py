"""Media columns: ISO base media files, written and read box by box.

``encode`` stores bytes losslessly as 8-bit samples: a movie box first (so that a reader needs no seek),
one track of ``raw `` sound, frames of FRAME bytes, chunks of CHUNK_FRAMES frames, the first frame of each
chunk a sync sample, then the media data box. ``parse`` walks the boxes of any such file, decodes the
sample tables (stsd, mdhd, stts, stsc, stsz or stz2, stco or co64, stss) and gives codec, duration and the
byte ranges of the keyframes; payloads are sliced, never decoded.

Cases: null text counts as empty; an empty payload is padded to one frame of zeros; media with no
or broken boxes parse to no tracks and keep what could be read, however deep boxes are nested or however many
samples they claim to have; boxes whose size says "to the end" and 64-bit sizes are read; empty tables give empty
results; equal texts, and so repeated rows, give equal values; very long texts are stored whole (up to what Arrow
holds in one value, 2 GB); a null doc_id is carried along; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

FRAME = 64
CHUNK_FRAMES = 256
RATE = 8000
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of FRAME."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def encode(payload: bytes) -> bytes:
    """payload: whole frames. One sample is one frame; mono, 8 bits, so a frame lasts FRAME ticks."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    ticks = frames * FRAME
    runs = [(1, CHUNK_FRAMES, 1)] if last == CHUNK_FRAMES or chunks > 1 else []
    if last != CHUNK_FRAMES:
        runs.append((chunks, last, 1))

    def movie(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        wide = first + len(payload) > 0xFFFFFFFF
        offsets = [first + k * CHUNK_FRAMES * FRAME for k in range(chunks)]
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, frames + 1, CHUNK_FRAMES))),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        version = ticks > 0xFFFFFFFF  # 64-bit durations then
        head = struct.pack(">BxxxQQIQ", 1, 0, 0, RATE, ticks) if version else struct.pack(">BxxxIIII", 0, 0, 0, RATE, ticks)
        media = _box(b"mdia", _box(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), info)
        track_head = struct.pack(">BxxBQQIIQ", 1, 7, 0, 0, 1, 0, ticks) if version else struct.pack(">BxxBIIIII", 0, 7, 0, 0, 1, 0, ticks)
        track = _box(b"trak", _box(b"tkhd", track_head, bytes(8), struct.pack(">hhHH", 0, 0, 0x0100, 0), UNITY, bytes(8)), media)
        return _box(b"moov", _box(b"mvhd", head, struct.pack(">IHHQ", 0x10000, 0x0100, 0, 0), UNITY, bytes(24), struct.pack(">I", 2)), track)

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    wide = len(payload) + 8 > 0xFFFFFFFF
    before = len(kind) + len(movie(0)) + (16 if wide else 8)
    before = len(kind) + len(movie(before)) + (16 if wide else 8)
    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([kind, movie(before), data, payload])


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    fixed: tuple[int, int] = (0, 0)  # size and number of samples of one size
    runs: list[tuple[int, int]] = field(default_factory=list)  # (first chunk, samples in a chunk)
    chunks: list[int] = field(default_factory=list)
    sync: list[int] | None = None  # None: all samples are sync samples
    times: list[tuple[int, int]] = field(default_factory=list)

    @property
    def samples(self) -> int:
        return self.fixed[1] if self.fixed[0] else len(self.sizes)

    def per_chunk(self) -> Iterator[tuple[int, int, int]]:
        """(first sample, samples, offset) of every chunk."""
        at, run = 0, 0
        for k, offset in enumerate(self.chunks, 1):
            while run + 1 < len(self.runs) and self.runs[run + 1][0] <= k:
                run += 1
            n = min(self.runs[run][1] if self.runs else 0, self.samples - at)
            yield at, n, offset
            at += n

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of every chunk's samples."""
        if self.fixed[0]:
            return [(offset, n * self.fixed[0]) for _, n, offset in self.per_chunk()]
        return [(offset, sum(self.sizes[a : a + n])) for a, n, offset in self.per_chunk()]

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, end) of the sync samples."""
        wanted = None if self.sync is None else {k - 1 for k in self.sync}
        found = []
        for first, n, offset in self.per_chunk():
            if self.fixed[0] and wanted is not None:
                size = self.fixed[0]
                found += [(offset + (k - first) * size, offset + (k - first + 1) * size) for k in range(first, first + n) if k in wanted]
                continue
            at = offset
            for k in range(first, first + n):
                size = self.fixed[0] or self.sizes[k]
                if wanted is None or k in wanted:
                    found.append((at, at + size))
                at += size
        return found


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body's start, end) of the boxes in a range; stops at the first that doesn't fit."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def parse(media: bytes) -> list[Track]:
    """The tracks of an ISO media file."""
    data = memoryview(media)
    tracks: list[Track] = []

    def table(at: int, end: int, form: str, skip: int = 4) -> list[tuple]:
        """The entries of a counted table, as many as there is room for."""
        if at + skip + 4 > end:
            return []
        n = struct.unpack_from(">I", data, at + skip)[0]
        size = struct.calcsize(form)
        first = at + skip + 4
        n = min(n, (end - first) // size)
        return list(struct.iter_unpack(form, data[first : first + n * size]))

    def walk(start: int, end: int) -> None:
        inner = [boxes(data, start, end)]  # the boxes of each holder that is open
        while inner:
            kind, at, stop = next(inner[-1], (b"", 0, 0))
            if not kind:
                inner.pop()
                continue
            if kind == b"trak":
                tracks.append(Track())
            if kind in HOLDERS:
                inner.append(boxes(data, at, stop))
                continue
            if not tracks:
                continue
            t = tracks[-1]
            try:
                if kind == b"mdhd":
                    t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
                elif kind == b"hdlr":
                    t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
                elif kind == b"stsd":
                    t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
                elif kind == b"stts":
                    t.times = table(at, stop, ">II")
                elif kind == b"stss":
                    t.sync = [x[0] for x in table(at, stop, ">I")]
                elif kind == b"stsc":
                    t.runs = [x[:2] for x in table(at, stop, ">III")]
                elif kind == b"stco":
                    t.chunks = [x[0] for x in table(at, stop, ">I")]
                elif kind == b"co64":
                    t.chunks = [x[0] for x in table(at, stop, ">Q")]
                elif kind == b"stsz":
                    size, n = struct.unpack_from(">II", data, at + 4)
                    if size:
                        t.fixed = (size, min(n, len(data) // size))  # more samples than that have no bytes
                    else:
                        t.sizes = [x[0] for x in table(at, stop, ">I", skip=8)]
                elif kind == b"stz2":
                    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
                    raw = bytes(data[at + 12 : stop])
                    each = [v for b in raw for v in (b >> 4, b & 15)] if bits == 4 else list(raw) if bits == 8 else [x[0] for x in struct.iter_unpack(">H", raw[: len(raw) // 2 * 2])]
                    t.sizes = each[:n]
            except (struct.error, IndexError):
                continue

    walk(0, len(data))
    return tracks


def samples(media: bytes, track: Track) -> bytes:
    """The track's samples in order."""
    view = memoryview(media)
    return b"".join(view[a : a + n] for a, n in track.ranges())


def feature(track: Track) -> str:
    """codec, duration in seconds, samples, keyframes with the first and last range, and a digest of all ranges."""
    keys = track.keyframes()
    ends = ["{}-{}".format(*k) for k in (keys[:1] + keys[1:][-1:])]
    digest = zlib.crc32(b"".join(struct.pack("<QQ", *k) for k in keys))
    return f"codec={track.codec.strip()};seconds={track.duration / max(1, track.timescale):.3f};samples={track.samples};keyframes={len(keys)}:{'..'.join(ends)};ranges_crc32={digest}"


def media_info(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``tracks`` for a binary column of ISO media: codec, handler, seconds, samples and keyframe byte ranges."""

    @F.pandas_udf("array<struct<codec:string,handler:string,seconds:double,samples:long,keyframes:array<struct<start:long,end:long>>>>")
    def info(files):
        return files.map(
            lambda f: [
                {"codec": t.codec, "handler": t.handler, "seconds": t.duration / max(1, t.timescale), "samples": t.samples, "keyframes": [{"start": a, "end": b} for a, b in t.keyframes()]}
                for t in parse(f or b"")
            ]
        )

    return df.withColumn("tracks", info(F.col(content)))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): every whole text as an ISO media file."""

    def per_batch(texts: list[str]) -> list[pa.Array]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return [pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(pad(r)) for r in raw], pa.binary())]

    return map_texts(docs, per_batch, "n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Read the stored bytes back and compute the columns of op7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                track = parse(media)[0]
                payload = samples(media, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = dict(stored.dtypes)["doc_id"]
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7(docs: DataFrame) -> DataFrame:
    return features(store(docs))

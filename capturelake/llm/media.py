"""ISO media containers in a binary column: write, walk, decode sample tables.

`wrap` stores bytes losslessly as 24 x 24 frames of 8-bit grey samples, 576 bytes a frame, in one raw video track.
`walk` yields nested boxes, `tracks` decodes each track's sample tables and movie fragments into codec, duration and the
byte ranges of its key frames without touching the payload. Null and empty texts give one frame of padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from capturelake.llm.common import base_columns

FRAME = 576
SIDE = 24
TIMESCALE, FRAME_TICKS = 24_000, 1_000
KEY_EVERY, PER_CHUNK = 12, 8
NESTED = frozenset({b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"moof", b"traf", b"mvex", b"udta"})
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the frame size."""
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)


def wrap(payload: bytes) -> bytes:
    """A complete file around the payload, whose length is a positive multiple of the frame size."""
    frames = len(payload) // FRAME
    ticks = frames * FRAME_TICKS
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(
        b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HH", SIDE, SIDE), struct.pack(">II", 72 << 16, 72 << 16),
        b"\0" * 4, struct.pack(">H", 1), b"\4grey".ljust(32, b"\0"), struct.pack(">Hh", 40, -1),
    )
    chunks = -(-frames // PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] if frames >= PER_CHUNK else []
    if frames % PER_CHUNK:
        runs.append((chunks, frames % PER_CHUNK, 1))
    keys = range(1, frames + 1, KEY_EVERY)

    def movie(base: int) -> bytes:
        places = [base + i * PER_CHUNK * FRAME for i in range(chunks)]
        table = full(b"co64", struct.pack(f">I{chunks}Q", chunks, *places)) if base + len(payload) >= 2**32 else full(b"stco", struct.pack(f">I{chunks}I", chunks, *places))
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)), full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full(b"stsz", struct.pack(">II", FRAME, frames)), table,
        )
        minf = box(b"minf", full(b"vmhd", b"\0" * 8, flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"samples\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), b"\0" * 16, MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) + 8 >= 2**32
    mdat_head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(head) + len(movie(0)) + len(mdat_head)
    moov = movie(base)
    if len(head) + len(moov) + len(mdat_head) != base:  # 64-bit places made the table longer
        moov = movie(len(head) + len(moov) + len(mdat_head))
    return b"".join((head, moov, mdat_head, payload))


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, outer boxes first; a damaged or cut box ends its level. Any depth."""
    levels = [(start, len(data) if end is None else min(end, len(data)), ())]
    while levels:
        at, stop, path = levels.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > stop:
                continue
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            continue
        levels.append((at + size, stop, path))
        inner = (*path[-7:], kind)  # standard boxes nest less deep
        yield inner, at + head, at + size
        if kind in NESTED:
            levels.append((at + head, at + size, inner))


class _Body:
    """Reads inside one box; what lies beyond its end is missing, never taken from the next box."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        self.data, self.at, self.end = data, start, end

    def ints(self, form: str) -> tuple[int, ...]:
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise ValueError("box too short")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def table(self, form: str) -> list[tuple[int, ...]]:
        """Entries after their count; those that the box has room for."""
        (n,) = self.ints(">I")
        n = min(n, (self.end - self.at) // struct.calcsize(form))
        return list(struct.iter_unpack(form, self.data[self.at : self.at + n * struct.calcsize(form)]))


def _media_head(body: _Body) -> tuple[int, int]:
    (version,) = body.ints(">B3x")
    return body.ints(">16xIQ" if version == 1 else ">8xII")


def _sizes(body: _Body, room: int) -> tuple[int, int | list[int]]:
    """(count, one size or all sizes); samples that the file cannot hold are left out."""
    size, count = body.ints(">4xII")
    if size:
        return min(count, room // size), size
    count = min(count, (body.end - body.at) // 4)
    return count, [x for (x,) in struct.iter_unpack(">I", body.data[body.at : body.at + 4 * count])]


def _sample_table(boxes: dict[bytes, tuple[int, int]], data: bytes) -> list[tuple[int, int, bool]]:
    """(start, size, key) of the samples that a track's tables place inside the file."""
    body = lambda kind, skip=4: _Body(data, boxes[kind][0] + skip, boxes[kind][1])
    count, size = _sizes(body(b"stsz", 0), len(data))
    places = [x for (x,) in (body(b"co64").table(">Q") if b"co64" in boxes else body(b"stco").table(">I"))]
    runs = body(b"stsc").table(">III")
    keys = {k for (k,) in body(b"stss").table(">I")} if b"stss" in boxes else None
    out: list[tuple[int, int, bool]] = []
    for i, (chunk, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(places) + 1
        for c in range(max(chunk, 1), min(last, len(places) + 1)):
            place = places[c - 1]
            for _ in range(min(per, count - len(out))):
                n = size if isinstance(size, int) else size[len(out)]
                if place + n > len(data):
                    return out
                out.append((place, n, keys is None or len(out) + 1 in keys))
                place += n
    return out


def _fragments(data: bytes, track: int, defaults: tuple[int, int, int]) -> tuple[list[tuple[int, int, bool]], int]:
    """Samples and ticks of a track's movie fragments (moof, traf, trun)."""
    out: list[tuple[int, int, bool]] = []
    ticks, moof, here, base, settings = 0, 0, None, 0, defaults
    for path, a, b in walk(data):
        body = _Body(data, a, b)
        try:
            if path[-1] == b"moof":
                moof = a - 8
            elif path[-1] == b"tfhd":
                flags, here = body.ints(">II")
                base = body.ints(">Q")[0] if flags & 1 else moof
                if flags & 2:
                    body.ints(">I")
                settings = tuple(body.ints(">I")[0] if flags & bit else d for bit, d in zip((8, 16, 32), defaults, strict=True))
            elif path[-1] == b"trun" and here == track:
                flags, count = body.ints(">II")
                place = base + body.ints(">i")[0] if flags & 1 else base
                first = body.ints(">I")[0] if flags & 4 else None
                width = 4 * sum(bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800))
                room = (b - body.at) // width if width else len(data) // max(settings[1], 1)
                for i in range(min(count, room)):
                    duration, size, marks = (body.ints(">I")[0] if flags & bit else d for bit, d in zip((0x100, 0x200, 0x400), settings, strict=True))
                    if flags & 0x800:
                        body.ints(">I")
                    if i == 0 and first is not None:
                        marks = first
                    if place < 0 or place + size > len(data):
                        break
                    out.append((place, size, not marks & 0x10000))
                    ticks += duration
                    place += size
                base = place
        except ValueError:
            continue
    return out, ticks


def tracks(data: bytes) -> list[dict]:
    """Per track with a readable head and sample description, in file order: id, codec, timescale, duration in ticks,
    summed ticks, samples, their byte ranges in runs, and the ranges of key samples, fragments included.

    A damaged file gives what its whole boxes say: samples that lie beyond the file are left out, tracks without a
    media head or sample description are too.
    """
    found: list[dict[bytes, tuple[int, int]]] = []
    extends: dict[int, tuple[int, int, int]] = {}
    for path, a, b in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path and found:
            found[-1].setdefault(path[-1], (a, b))
        elif path[-1] == b"trex" and b - a >= 24:
            track, _, duration, size, marks = struct.unpack_from(">4xIIIII", data, a)
            extends[track] = (duration, size, marks)
    out = []
    for boxes in found:
        try:
            timescale, duration = _media_head(_Body(data, *boxes[b"mdhd"]))
            (codec,) = _Body(data, *boxes[b"stsd"]).ints(">12x4s")
            version = _Body(data, *boxes[b"tkhd"]).ints(">B")[0] if b"tkhd" in boxes else 0
            (track,) = _Body(data, *boxes[b"tkhd"]).ints(">20xI" if version == 1 else ">12xI") if b"tkhd" in boxes else (0,)
            samples = _sample_table(boxes, data) if b"stsz" in boxes and b"stsc" in boxes and (b"stco" in boxes or b"co64" in boxes) else []
            ticks = sum(n * d for n, d in _Body(data, boxes[b"stts"][0] + 4, boxes[b"stts"][1]).table(">II")) if b"stts" in boxes else 0
        except (KeyError, ValueError):
            continue
        more, more_ticks = _fragments(data, track, extends.get(track, (0, 0, 0)))
        samples += more
        spans: list[list[int]] = []
        for s, n, _ in samples:
            if spans and spans[-1][1] == s:
                spans[-1][1] = s + n
            else:
                spans.append([s, s + n])
        out.append({"track": track, "codec": codec.decode("latin-1").strip(), "timescale": timescale, "duration": duration, "ticks": ticks + more_ticks, "samples": len(samples), "spans": spans, "keys": [(s, s + n) for s, n, key in samples if key]})
    return out


def track_table(data: bytes) -> dict | None:
    """The first readable track of a file, or None."""
    return next(iter(tracks(data)), None)


def container_index(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Codec, duration in seconds, sample count and key frame byte ranges of each file's first track in a binary column; nulls where the file is null, damaged or without a track."""

    def run(batches):
        for batch in batches:
            rows = [track_table(m) if m else None for m in batch.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array([r and r["codec"] for r in rows], pa.string()), pa.array([r and (r["duration"] or r["ticks"]) / max(r["timescale"], 1) for r in rows], pa.float64()), pa.array([r and r["samples"] for r in rows], pa.int64()),
                    pa.array([r and [{"start": a, "end": b} for a, b in r["keys"]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                [key, "codec", "seconds", "samples", "key_ranges"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"{key} {kind}, codec string, seconds double, samples long, key_ranges array<struct<start: long, end: long>>")


def media_column(df: DataFrame) -> DataFrame:
    """The documents' texts as media files: doc_id, n_bytes, media binary."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a in range(0, len(raw), 256):
                part = raw[a : a + 256]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(part)), pa.array(map(len, part), pa.int64()), pa.array([wrap(padded(r)) for r in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return base_columns(df, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digests(df: DataFrame) -> DataFrame:
    """Per document: writes the file, reads the samples back by its tables, and returns digests and a feature string."""

    def one(raw: bytes) -> tuple:
        media = wrap(padded(raw))
        table = track_table(media)
        payload = b"".join(media[a:b] for a, b in table["spans"])
        keys = hashlib.sha256(";".join(f"{a}-{b}" for a, b in table["keys"]).encode()).hexdigest()[:16]
        feature = f"codec={table['codec']};size={SIDE}x{SIDE};samples={table['samples']};seconds={table['ticks'] / table['timescale']:.6f};keys={len(table['keys'])};key_ranges={keys};mean={sum(payload) / len(payload):.4f}"
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        for batch in batches:
            rows = [one((t or "").encode()) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return base_columns(df, {"doc_id": "long", "text": "string"}).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

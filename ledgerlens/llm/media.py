"""Media columns in ISO base media containers: boxes are walked and sample tables decoded, payloads are not.

A payload is stored as mono 8-bit unsigned samples in fixed frames. ``probe`` reads any such file from its boxes
alone, those of fragments included: codec, duration, samples and the byte range of every keyframe.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import raw

FRAME = 64
RATE = 8000
FRAMES_PER_CHUNK = 64
KEY_EVERY = 16
#: Boxes that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Optional fields of a track fragment's header and of a run, by flag; the samples' own fields; what they say.
FRAGMENT_FIELDS = ((0x1, "base", ">Q"), (0x2, "entry", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I"))
RUN_FIELDS, SAMPLE_FIELDS = ((0x1, "offset", ">i"), (0x4, "first", ">I")), ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
BASE_IS_FRAGMENT, NO_KEYFRAME = 0x20000, 0x10000


def padded(data: bytes, unit: int = FRAME) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _table(kind: bytes, values: np.ndarray, width: str) -> bytes:
    return _full(kind, 0, struct.pack(">I", len(values)), values.astype(width).tobytes())


UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def encode(payload: bytes) -> bytes:
    """A file of one sound track whose samples are the frames of ``payload`` (a positive multiple of FRAME bytes)."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != FRAMES_PER_CHUNK)
    length = frames * FRAME
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def movie(start: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        offsets = start + np.arange(chunks, dtype=np.int64) * FRAME * FRAMES_PER_CHUNK
        tables = _box(
            b"stbl", _full(b"stsd", 0, struct.pack(">I", 1), entry), _full(b"stts", 0, struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", 0, struct.pack(">I", -(-frames // KEY_EVERY)), np.arange(1, frames + 1, KEY_EVERY).astype(">u4").tobytes()),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), _full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            _table(b"stco", offsets, ">u4") if start + length < 1 << 32 else _table(b"co64", offsets, ">u8"),
        )
        data = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        media = _box(b"mdia", _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), _full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"samples\0"), _box(b"minf", _full(b"smhd", 0, bytes(4)), data, tables))
        track = _box(b"trak", _full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), UNITY, bytes(8)), media)
        return _box(b"moov", _full(b"mvhd", 0, struct.pack(">IIII", 0, 0, RATE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2)), track)

    head = len(kind) + len(movie(0)) + 8
    return kind + movie(head) + _box(b"mdat", payload)


def boxes(data: bytes, begin: int = 0, end: int | None = None, path: tuple = ()):
    """Yield (path, first byte, end) of each box's body, nested ones included. A box that overruns its parent is an error."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError("truncated box")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("truncated box")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = begin + size if size else end
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} overruns its parent")
        yield (*path, kind), body, stop
        if kind in NESTS:
            yield from boxes(data, body, stop, (*path, kind))
        begin = stop


def _optional(data: bytes, at: int, flags: int, fields) -> tuple[dict, int]:
    """The fields that the flags announce, and where they end."""
    out = {}
    for flag, name, kind in fields:
        if flags & flag:
            out[name] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return out, at


class _Fragments:
    """Samples of the fragments by track number: arrays of offsets, sizes and keyframes, and the time they last to."""

    def __init__(self):
        self.defaults: dict[int, dict] = {}
        self.runs: dict[int, list] = {}
        self.ends: dict[int, int] = {}
        self.start = self.next = self.track = 0
        self.now: dict = {}

    def see(self, data: bytes, kind: bytes, begin: int, start: int) -> None:
        """One box of a movie's fragments, in the order of the file; ``start`` is that of the last fragment's box."""
        if kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, begin + 4)
            self.defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            self.start = self.next = start
        elif kind == b"tfhd":
            flags, self.track = struct.unpack_from(">II", data, begin)
            own, _ = _optional(data, begin + 8, flags, FRAGMENT_FIELDS)
            # Without a base of its own a track goes on where the one before it in the fragment ends.
            base = own.pop("base", self.start if flags & BASE_IS_FRAGMENT else self.next)
            self.now = {"duration": 0, "size": 0, "flags": 0, **self.defaults.get(self.track, {}), **own, "base": base}
            self.next = base
        elif kind == b"tfdt":
            self.ends[self.track] = struct.unpack_from(">Q" if data[begin] else ">I", data, begin + 4)[0]
        elif kind == b"trun":
            self._run(data, begin)

    def _run(self, data: bytes, begin: int) -> None:
        flags, n = struct.unpack_from(">II", data, begin)
        own, at = _optional(data, begin + 8, flags, RUN_FIELDS)
        names = [name for flag, name in SAMPLE_FIELDS if flags & flag]
        if at + 4 * n * len(names) > len(data):
            raise ValueError("run overruns the file")
        table = np.frombuffer(data, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names))
        column = lambda name: table[:, names.index(name)] if name in names else np.full(n, self.now[name], np.int64)
        sizes, says = column("size"), column("flags")
        if n and "first" in own:
            says = np.append(own["first"], says[1:])
        start = self.now["base"] + own["offset"] if "offset" in own else self.next
        offsets = start + np.cumsum(sizes) - sizes
        self.next = int(start + sizes.sum())
        self.ends[self.track] = self.ends.get(self.track, 0) + int(column("duration").sum())
        self.runs.setdefault(self.track, []).append((offsets, sizes, says & NO_KEYFRAME == 0))


def probe(data: bytes) -> dict:
    """Codec, duration, sample offsets and sizes, and keyframes of the first track, and ``tracks``, the same of each track.

    Samples of fragments follow those of the track's own tables. ValueError if a track is malformed.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    fragments, end_before = _Fragments(), 0
    try:
        for path, begin, end in boxes(data):
            if path[-1] == b"trak":
                tracks.append({})
            elif b"trak" in path:
                tracks[-1].setdefault(path[-1], (begin, end))
            else:
                fragments.see(data, path[-1], begin, end_before)
            if len(path) == 1:
                end_before = end
    except struct.error as problem:
        raise ValueError(f"short fragment: {problem}") from None
    if not tracks:
        raise ValueError("no track")
    made = [_track(data, found, fragments) for found in tracks]
    return {**made[0], "tracks": made}


def _track(data: bytes, found: dict[bytes, tuple[int, int]], fragments: _Fragments) -> dict:
    try:
        begin, _ = found.get(b"tkhd", (None, None))
        number = 0 if begin is None else struct.unpack_from(">I", data, begin + (20 if data[begin] else 12))[0]
        begin, end = found[b"stsd"]
        codec = data[begin + 12 : begin + 16].decode("latin-1")
        begin, _ = found[b"mdhd"]
        scale, length = struct.unpack_from(">II", data, begin + 12) if data[begin] == 0 else struct.unpack_from(">IQ", data, begin + 20)
        begin, _ = found[b"stsz"]
        size, n = struct.unpack_from(">II", data, begin + 4)
        sizes = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, begin + 12).astype(np.int64)
        wide = b"co64" in found
        begin, _ = found[b"co64" if wide else b"stco"]
        chunks = np.frombuffer(data, ">u8" if wide else ">u4", struct.unpack_from(">I", data, begin + 4)[0], begin + 8).astype(np.int64)
        begin, _ = found[b"stsc"]
        runs = np.frombuffer(data, ">u4", 3 * struct.unpack_from(">I", data, begin + 4)[0], begin + 8).astype(np.int64).reshape(-1, 3)
        keys = np.arange(n)
        if b"stss" in found:
            begin, _ = found[b"stss"]
            keys = np.frombuffer(data, ">u4", struct.unpack_from(">I", data, begin + 4)[0], begin + 8).astype(np.int64) - 1
    except (KeyError, struct.error) as problem:
        raise ValueError(f"missing or short table: {problem}") from None
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    if len(chunk) != n or (len(keys) and (keys.min() < 0 or keys.max() >= n)):
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    offsets = chunks[chunk] + before - before[first][chunk] if n else before
    for own_offsets, own_sizes, own_keys in fragments.runs.get(number, []):
        keys = np.append(keys, len(sizes) + np.flatnonzero(own_keys))
        offsets, sizes = np.append(offsets, own_offsets), np.append(sizes, own_sizes)
    n, length = len(sizes), max(length, fragments.ends.get(number, 0))
    if n and ((offsets + sizes).max() > len(data) or offsets.min() < 0):
        raise ValueError("samples lie outside the file")
    return {"codec": codec, "duration": length / scale if scale else 0.0, "offsets": offsets, "sizes": sizes, "keys": keys}


def read(data: bytes) -> tuple[dict, bytes]:
    """The probe and the samples' bytes in order, track after track."""
    info = probe(data)
    return info, b"".join(_samples(data, x["offsets"], x["sizes"]) for x in info["tracks"])


def _samples(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> bytes:
    if not len(sizes):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, stops = np.append(0, breaks), np.append(breaks, len(sizes)) - 1
    return b"".join(data[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(starts, stops))


COLUMNS = {
    "n_bytes": (T.LongType(), pa.int64()), "payload_bytes": (T.LongType(), pa.int64()), "payload_sha256": (T.StringType(), pa.string()), "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()), "media_sha256": (T.StringType(), pa.string()), "codec": (T.StringType(), pa.string()), "duration": (T.DoubleType(), pa.float64()),
    "keyframes": (T.LongType(), pa.int64()), "key_offsets": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "key_sizes": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "feature": (T.StringType(), pa.string()), "media": (T.BinaryType(), pa.binary()),
}


def describe(data: bytes | None, keep: bool = True) -> tuple:
    text = data or b""
    media = encode(padded(text))
    info, back = read(media)
    keys = info["keys"]
    offsets, sizes = info["offsets"][keys], info["sizes"][keys]
    ranges = hashlib.sha256(np.stack([offsets, sizes]).astype("<i8").tobytes()).hexdigest()[:16]
    feature = f"codec={info['codec'].strip()};duration={info['duration']:.6f};samples={len(info['sizes'])};keyframes={len(keys)};ranges={ranges}"
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), info["codec"], info["duration"],
        len(keys), offsets.tolist() if keep else None, sizes.tolist() if keep else None, feature, media if keep else None,
    )


def media_columns(docs: DataFrame, text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Replace the text by the COLUMNS of its stored form; with ``keep_media`` also the file and its keyframe ranges.

    Null and empty texts are one frame of zero bytes. Equal texts give equal values; repeated rows get a row each. Other
    columns stay, but for those that bear a name of COLUMNS.
    """
    docs = docs.select(text_col, *[c for c in docs.columns if c != text_col and c.lower() not in COLUMNS])
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def scan(batches):
        for batch in batches:
            names, others = [f.name for f in kept], [batch.column(f.name) for f in kept]
            texts = raw(batch.column(text_col))
            for i in range(0, len(texts), 64):  # files are as long as texts: a few at a time
                columns = zip(*[describe(x, keep_media) for x in texts[i : i + 64]])
                arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, COLUMNS.values())]
                yield pa.RecordBatch.from_arrays([c.slice(i, 64) for c in others] + arrays, names=names + list(COLUMNS))

    return docs.mapInArrow(scan, T.StructType(kept + [T.StructField(n, kind) for n, (kind, _) in COLUMNS.items()]))

"""Media columns: ISO base media files.

box() and movie() write a file with one track of 8-bit samples; walk() goes through nested boxes of any file of this
family, and tracks() decodes the sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and, in fragmented files, the
runs of each fragment (trex, tfhd, trun) into codec, duration, and the byte range of each sample and keyframe.  Neither
reads the media payload; only read_back() cuts it out.  Numbers of a file are checked against its size before anything of
that size is made.

Cases: null bytes count as empty; the payload is padded with bytes 255 to a positive multiple of UNIT; an empty table
gives no rows; equal texts give equal files and features; a file that ends early or whose tables disagree raises
ValueError in tracks(), and gives a row with null features in describe() and digests(); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_or_empty

UNIT = 576
#: Samples in a chunk; a keyframe begins every KEY samples; ticks a second.
CHUNK, KEY, SCALE = 32, 12, 48_000
#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"))

#: Files of this family nest a dozen levels; deeper ones are damaged.
DEPTH = 64

DESCRIBED = "doc_id long, codec string, duration double, n_samples long, n_keyframes long, keyframe_starts array<long>, keyframe_ends array<long>, boxes string, payload binary"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def numbers(values, width: str = ">u4") -> bytes:
    return np.asarray(values, dtype=width).tobytes()


def movie(payload: bytes) -> bytes:
    """A file whose one track holds payload (a positive multiple of UNIT) in samples of UNIT bytes of 8 bits."""
    n = len(payload) // UNIT
    ticks = n * UNIT
    long = ticks >= 1 << 32
    matrix = numbers((0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000))
    times = struct.pack(">QQIQ", 0, 0, SCALE, ticks) if long else struct.pack(">IIII", 0, 0, SCALE, ticks)
    version = int(long)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, SCALE << 16))
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, n, 1)] if n < CHUNK else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]
    keys = np.arange(1, n + 1, KEY)
    wide = len(payload) + 16 * chunks + 4 * n + 4096 >= 1 << 32

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), numbers(keys)),
            full(b"stsc", struct.pack(">I", len(runs)), numbers(runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), numbers(offsets, ">u8" if wide else ">u4")),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=version), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        lasts = struct.pack(">QQIIQ", 0, 0, 1, 0, ticks) if long else struct.pack(">IIIII", 0, 0, 1, 0, ticks)
        tkhd = full(b"tkhd", lasts, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=version, flags=3)
        mvhd = full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=version)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    before = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(before) + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of each box, outer ones first."""
    end = len(data) if end is None else end
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box ends early")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box ends early")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop
    if start != end and not path:
        raise ValueError("a box ends early")


@dataclass
class Track:
    codec: str
    seconds: float
    starts: np.ndarray
    sizes: np.ndarray
    ticks: np.ndarray
    sync: np.ndarray
    scale: int = 1
    length: int = 0

    def extended(self, parts: list) -> Track:
        """The track with the samples of its fragments added; the time is theirs as well where its header gives none."""
        if not parts:
            return self
        starts, sizes, ticks, sync = (np.concatenate([mine, *(p[i] for p in parts)]) for i, mine in enumerate((self.starts, self.sizes, self.ticks, self.sync)))
        seconds = (self.length or int(ticks.sum())) / max(self.scale, 1)
        return Track(self.codec, seconds, starts, sizes, ticks, sync.astype(bool), self.scale, self.length)

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[self.sync], (self.starts + self.sizes)[self.sync]


def _table(data, at: int, end: int, columns: int = 1, width: str = ">u4") -> np.ndarray:
    """The rows of a table that begins with their number."""
    (n,) = struct.unpack_from(">I", data, at)
    if at + 4 + n * columns * np.dtype(width).itemsize > end:
        raise ValueError("a table ends early")
    return np.frombuffer(data, width, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _sizes(data, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        if not same:
            return _table(data, at + 8, end)[:, 0]
        if same * n > len(data):
            raise ValueError("samples are larger than the file")
        return np.full(n, same, np.int64)
    if b"stz2" not in boxes:
        raise ValueError("no stsz")
    at, end = boxes[b"stz2"]
    bits, (n,) = data[at + 7], struct.unpack_from(">I", data, at + 8)
    if bits not in (4, 8, 16) or at + 12 + -(-n * bits // 8) > end:
        raise ValueError("a table ends early")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)


def _track(data, boxes: dict[bytes, tuple[int, int]]) -> Track:
    need = [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsc") if k not in boxes]
    if need:
        raise ValueError(f"no {', '.join(need)}")
    at, _ = boxes[b"mdhd"]
    scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
    sizes = _sizes(data, boxes)
    n = len(sizes)
    key = b"co64" if b"co64" in boxes else b"stco"
    if key not in boxes:
        raise ValueError("no stco")
    chunks = _table(data, boxes[key][0] + 4, boxes[key][1], 1, ">u8" if key == b"co64" else ">u4")[:, 0]
    runs = _table(data, boxes[b"stsc"][0] + 4, boxes[b"stsc"][1], 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise ValueError("chunks are out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    if len(per) != len(chunks) or per.sum() != n:
        raise ValueError("chunks and samples disagree")
    ends = np.cumsum(sizes)
    first = np.cumsum(per) - per  # a chunk's first sample
    base = np.concatenate(([0], ends))[first] if n else np.zeros(len(chunks), np.int64)
    starts = np.repeat(chunks - base, per) + ends - sizes
    times = _table(data, boxes[b"stts"][0] + 4, boxes[b"stts"][1], 2)
    if times[:, 0].sum() != n:
        raise ValueError("times and samples disagree")
    ticks = np.repeat(times[:, 1], times[:, 0])
    sync = np.ones(n, bool)
    if b"stss" in boxes:
        numbers_ = _table(data, boxes[b"stss"][0] + 4, boxes[b"stss"][1])[:, 0]
        if len(numbers_) and (numbers_.min() < 1 or numbers_.max() > n):
            raise ValueError("a keyframe is no sample")
        sync = np.zeros(n, bool)
        sync[numbers_ - 1] = True
    return Track(codec, (length or int(ticks.sum())) / max(scale, 1), starts, sizes, ticks, sync, scale, length)


#: Which fields a fragment's header and its runs have, and the mark of a sample that is no keyframe.
_BASE, _DESCRIPTION, _DURATION, _SIZE, _FLAGS, _NONE, _OWN = 0x1, 0x2, 0x8, 0x10, 0x20, 0x10000, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_FIELDS, _NOT_SYNC = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800), 0x10000


def _began(data, body: int) -> int:
    """Where the box whose body begins there begins: 16 bytes before if it has a long size, else 8."""
    long = body >= 16 and struct.unpack_from(">I", data, body - 16)[0] == 1 and bytes(data[body - 12 : body - 8]) == b"moof"
    return body - (16 if long else 8)


def _fields(data, at: int, end: int, flags: int, kinds) -> tuple[dict[int, int], int]:
    """The optional fields (flag, format) that flags name, and where they end."""
    out = {}
    for flag, kind in kinds:
        if flags & flag:
            out[flag] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    if at > end:
        raise ValueError("a box ends early")
    return out, at


def _fragment(data, moof: int, header: tuple[int, int], runs: list[tuple[int, int]], usual: dict[int, tuple[int, int, int]], at_data: int) -> tuple[int, list[np.ndarray], int]:
    """(track, [starts, sizes, ticks, sync], end of its data) of a track's runs in the fragment that begins at ``moof``."""
    at, end = header
    flags, track = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    own, _ = _fields(data, at + 8, end, flags, ((_BASE, ">Q"), (_DESCRIPTION, ">I"), (_DURATION, ">I"), (_SIZE, ">I"), (_FLAGS, ">I")))
    defaults = [own.get(f, d) for f, d in zip((_DURATION, _SIZE, _FLAGS), usual.get(track, (0, 0, 0)), strict=True)]
    base = own[_BASE] if _BASE in own else moof if flags & _OWN or not at_data else at_data
    place, parts = base, []
    for at, end in runs:
        run_flags, n = struct.unpack_from(">II", data, at)
        run_flags &= 0xFFFFFF
        head, at = _fields(data, at + 8, end, run_flags, ((_RUN_OFFSET, ">i"), (_RUN_FIRST, ">I")))
        named = [f for f in _RUN_FIELDS if run_flags & f]
        if at + 4 * len(named) * n > end or (not named and n * max(defaults[1], 1) > len(data)):
            raise ValueError("a run ends early")
        table = np.frombuffer(data, ">u4", len(named) * n, at).astype(np.int64).reshape(n, len(named))
        ticks, sizes, marks = (table[:, named.index(f)] if f in named else np.full(n, d, np.int64) for f, d in zip(_RUN_FIELDS, defaults, strict=False))
        if _RUN_FIRST in head and n:
            marks = marks.copy()
            marks[0] = head[_RUN_FIRST]
        place = base + head[_RUN_OFFSET] if _RUN_OFFSET in head else place
        ends = place + np.cumsum(sizes)
        parts.append(np.stack([ends - sizes, sizes, ticks, (marks & _NOT_SYNC) == 0]))
        place = int(ends[-1]) if n else place
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    return track, list(whole), place


def tracks(data) -> list[Track]:
    """The tracks of a file; ValueError where it ends early or its tables disagree."""
    out: list[dict] = []
    usual: dict[int, tuple[int, int, int]] = {}
    parts: dict[int, list] = {}
    moof, at_data, header, runs = 0, 0, None, []

    def fragment() -> None:
        nonlocal header, runs, at_data
        if header:
            track, columns, at_data = _fragment(data, moof, header, runs, usual, at_data)
            parts.setdefault(track, []).append(columns)
        header, runs = None, []

    try:
        for path, at, end in walk(data):
            if path == (b"moov", b"trak"):
                out.append({})
            elif path[:2] == (b"moov", b"trak"):
                out[-1][path[-1]] = (at, end)
            elif path == (b"moov", b"mvex", b"trex"):
                track, _, *values = struct.unpack_from(">IIIII", data, at + 4)
                usual[track] = tuple(values)
            elif path in ((b"moof",), (b"moof", b"traf")):
                fragment()
                if path == (b"moof",):
                    moof, at_data = _began(data, at), 0
            elif path == (b"moof", b"traf", b"tfhd"):
                header = (at, end)
            elif path == (b"moof", b"traf", b"trun"):
                runs.append((at, end))
        fragment()
        found = []
        for boxes in out:
            track = _track(data, boxes)
            at = boxes[b"tkhd"][0] if b"tkhd" in boxes else None
            number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0] if at is not None else 0
            found.append(track.extended(parts.get(number, [])))
        return found
    except (struct.error, IndexError) as e:
        raise ValueError("a box ends early") from e


def read_back(data, track: Track) -> bytes:
    """The track's samples, cut out of the file in order; neighbours are cut in one piece."""
    if not len(track.starts):
        return b""
    ends = track.starts + track.sizes
    if ends.max() > len(data) or track.starts.min() < 0:
        raise ValueError("a sample lies beyond the file")
    new = np.flatnonzero(np.concatenate(([True], track.starts[1:] != ends[:-1])))
    last = np.append(new[1:], len(ends)) - 1
    return b"".join(bytes(data[a:b]) for a, b in zip(track.starts[new].tolist(), ends[last].tolist(), strict=True))


def _store(batches):
    for batch in slices(batches):
        data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        files = pa.array([movie(padded(d)) for d in data], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, data)), pa.int64()), files], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a file of its own, and its unpadded size."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _described(batch, keep: bool):
    """DESCRIBED of the whole of one batch of doc_id, media."""
    rows = []
    for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        try:
            (track, *_), kinds = tracks(data or b"") or [None], "/".join(p[-1].decode("latin-1") for p, _, _ in walk(data or b""))
            payload = read_back(data, track) if keep and track else None
        except ValueError:
            track = None
        if track is None:
            rows.append((doc, *[None] * 8))
            continue
        starts, ends = track.keyframes()
        rows.append((doc, track.codec, track.seconds, len(track.starts), len(starts), starts, ends, kinds, payload))
    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
    names = ["doc_id", "codec", "duration", "n_samples", "n_keyframes", "keyframe_starts", "keyframe_ends", "boxes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _describe(keep: bool):
    return lambda batches: (_described(b, keep) for b in slices(batches))


def describe(media: DataFrame, keep_payload: bool = False) -> DataFrame:
    """DESCRIBED of the first track of each file; payload, the samples read back, only if asked for."""
    ship(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_describe(keep_payload), DESCRIBED)


def _digest(batches):
    """Digests of a file and its payload beside what its walk tells, so that large binaries need not go back to the JVM."""
    for batch in slices(batches):
        inner = _described(batch.select(["doc_id", "media"]), True)
        payloads, files = inner.column("payload").to_pylist(), batch.column("media").to_pylist()
        digests = [
            batch.column("n_bytes"),
            pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
            pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
            pa.array([None if p is None else p[-32:] for p in payloads], pa.binary()),
            pa.array([None if f is None else len(f) for f in files], pa.int64()),
            pa.array([None if f is None else hashlib.sha256(f).hexdigest() for f in files], pa.string()),
        ]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail", "media_bytes", "media_sha256"]
        yield pa.RecordBatch.from_arrays([*inner.columns[:8], *digests], names=[*inner.schema.names[:8], *names])


def digests(stored: DataFrame) -> DataFrame:
    """For store()'s rows: DESCRIBED without the payload, and digests of file and payload, all from the stored bytes; null
    where a file is null or damaged (the file's own digest is there then)."""
    ship(stored.sparkSession)
    kept = DESCRIBED.rpartition(", ")[0]
    added = ", n_bytes long, payload_bytes long, payload_sha256 string, tail binary, media_bytes long, media_sha256 string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_digest, kept + added)

"""ISO media containers: walk nested boxes, decode sample tables, store codec, duration and keyframe byte ranges.

`describe` reads a column of containers without decoding a payload: only box headers, the sample tables in `moov` and
those of movie fragments are looked at. `store` writes a payload losslessly as 8-bit mono samples in such a container, and `payload` reads the
stored bytes back by the byte ranges of the sample tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import error as StructError
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A frame of 8-bit samples, frames in a chunk, frames from one keyframe to the next, samples a second.
FRAME, CHUNK, KEY_EVERY, RATE = 192, 32, 16, 8000
#: Boxes that hold boxes, and the bytes that come before these.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
#: Boxes nested deeper than this are an error.
DEEPEST = 64
#: Bits of the flags of a track fragment's header and of its runs, in the order of their fields; the flag of samples that aren't keyframes.
TFHD = {0x1: 8, 0x2: 4, 0x8: 4, 0x10: 4, 0x20: 4}
BASE_IS_MOOF, NOT_KEY = 0x20000, 0x10000


def padded(text: str | None) -> bytes:
    """A text in UTF-8 with spaces up to a positive multiple of FRAME bytes."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def _box(kind: bytes, *parts: bytes) -> bytes:
    return pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """A container with one track of unsigned 8-bit samples. The tables come first, so a reader needs no seek."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    keys = range(1, frames + 1, KEY_EVERY)
    matrix = pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    runs = [(1, CHUNK, 1)] if frames % CHUNK == 0 else [(chunks, frames % CHUNK, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, frames % CHUNK, 1)]

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        tables = _box(
            b"stbl", _full(b"stsd", pack(">I", 1), entry), _full(b"stts", pack(">3I", 1, frames, FRAME)), _full(b"stss", pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", pack(">I", len(runs)), *[pack(">3I", *r) for r in runs]), _full(b"stsz", pack(">2I", FRAME, frames)),
            _full(b"co64" if wide else b"stco", pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        header = _full(b"mdhd", pack(">4IHH", 0, 0, RATE, len(payload), 0x55C4, 0))
        handler = _full(b"hdlr", pack(">I4s12x", 0, b"soun"), b"sound\0")
        inner = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", pack(">I", 1), _full(b"url ", flags=1))), tables)
        track = _full(b"tkhd", pack(">5I8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        movie = _full(b"mvhd", pack(">4IIH10x", 0, 0, RATE, len(payload), 1 << 16, 0x100), matrix, bytes(24), pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, _box(b"mdia", header, handler, inner)))

    kind = _box(b"ftyp", b"isom", pack(">I", 512), b"isomiso2mp41")
    media = pack(">I4s", 8 + len(payload), b"mdat") if len(payload) + 8 < 1 << 32 else pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    first = len(kind) + len(moov(0)) + len(media)
    return b"".join((kind, moov(first), media, payload))


@dataclass
class Track:
    """The tables of one track."""

    number: int = 0
    handler: str = ""
    codecs: list[str] = field(default_factory=list)  #: of each sample description
    timescale: int = 0
    duration: int = 0
    edits: list[tuple[int, int]] = field(default_factory=list)  #: duration, media time
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: list[tuple[int, int]] = field(default_factory=list)
    keys: np.ndarray | None = None  #: numbers from 1; None: every sample
    runs: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.int64))  #: first chunk, samples a chunk, description
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    fragments: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=list)  #: first bytes, sizes, keyframes, duration

    @property
    def codec(self) -> str:
        return self.codecs[0] if self.codecs else ""

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, size and whether it is a keyframe, of each sample."""
        n = len(self.sizes)
        firsts = self.runs[:, 0]
        if n and (not len(firsts) or firsts[0] != 1 or (np.diff(firsts) < 1).any()):
            raise ValueError("the runs of chunks")
        chunk = np.arange(1, len(self.offsets) + 1)
        many = self.runs[np.searchsorted(firsts, chunk, "right") - 1, 1] if n else np.empty(0, np.int64)
        until = np.minimum(np.cumsum(many), n)
        if n and (not len(until) or until[-1] < n):
            raise ValueError("fewer places than samples")
        count = np.diff(until, prepend=0)
        before = np.concatenate(([0], np.cumsum(self.sizes)))
        at = np.repeat(self.offsets[: len(count)] - before[until - count], count) + before[:-1]
        key = np.ones(n, bool)
        if self.keys is not None:
            key[:] = False
            key[self.keys[(self.keys > 0) & (self.keys <= n)] - 1] = True
        parts = [(at, self.sizes, key), *(f[:3] for f in self.fragments)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def key_ranges(self) -> list[tuple[int, int]]:
        """First byte and size of each keyframe."""
        at, size, key = self.samples()
        return list(zip(at[key].tolist(), size[key].tolist(), strict=True))

    @property
    def n_samples(self) -> int:
        return len(self.sizes) + sum(len(f[1]) for f in self.fragments)

    @property
    def length(self) -> int:
        """The duration of the header, or where it has none, that of the fragments."""
        return self.duration or sum(f[3] for f in self.fragments)


def _walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Path, first byte, first byte of the content and end of each box, outer before inner."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            if at != end:
                raise ValueError(f"{end - at} bytes after the last box")
            continue
        size, kind = unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"the size of {kind.decode('latin-1')!r} at {at}")
        if len(path) >= DEEPEST:
            raise ValueError(f"boxes nested deeper than {DEEPEST}")
        yield (*path, kind), at, at + head, at + size
        todo.append((at + size, end, path))
        if kind in NESTED:
            todo.append((at + head + NESTED[kind], at + size, (*path, kind)))


def boxes(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first byte and end of the content of each box, outer before inner."""
    return ((path, at, end) for path, _, at, end in _walk(data))


def _table(data: bytes, kind: bytes, at: int, end: int, width: int, of: str = ">u4") -> np.ndarray:
    """The entries of a table: how many they are, and then `width` bytes each."""
    n = unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width > end:
        raise ValueError(f"{n} entries in {kind.decode('latin-1')}")
    return np.frombuffer(data, of, n * width // np.dtype(of).itemsize, at + 8).astype(np.int64)


def _sizes(data: bytes, kind: bytes, at: int, end: int) -> np.ndarray:
    one, n = unpack_from(">II", data, at + 4)
    if kind == b"stsz" and one:
        if n * one > len(data):
            raise ValueError(f"{n} samples of {one} bytes")
        return np.full(n, one, np.int64)
    bits = 32 if kind == b"stsz" else one & 0xFF
    if bits not in (4, 8, 16, 32) or at + 12 + -(-n * bits // 8) > end:
        raise ValueError(f"{n} entries in {kind.decode()}")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-n // 2), at + 12)
        return np.stack((pairs >> 4, pairs & 15), axis=1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)


def _described(t: Track, data: bytes, kind: bytes, at: int, end: int) -> None:
    """What a box in a track says of it."""
    if kind == b"tkhd":
        t.number = unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    elif kind == b"hdlr":
        t.handler = data[at + 8 : at + 12].decode("latin-1")
    elif kind == b"mdhd":
        t.timescale, t.duration = unpack_from(">IQ", data, at + 20) if data[at] == 1 else unpack_from(">II", data, at + 12)
        t.duration = 0 if t.duration in (2**32 - 1, 2**64 - 1) else t.duration  # all ones: not known
    elif kind == b"stsd":
        entry = at + 8
        for _ in range(unpack_from(">I", data, at + 4)[0]):
            size, codec = unpack_from(">I4s", data, entry)
            if size < 8 or entry + size > end:
                raise ValueError("a sample description")
            t.codecs.append(codec.decode("latin-1"))
            entry += size
    elif kind == b"elst":
        wide = data[at] == 1
        n = unpack_from(">I", data, at + 4)[0]
        if at + 8 + n * (20 if wide else 12) > end:
            raise ValueError(f"{n} entries in elst")
        t.edits = [unpack_from(">Qq" if wide else ">Ii", data, at + 8 + i * (20 if wide else 12)) for i in range(n)]
    elif kind == b"stts":
        t.times = list(map(tuple, _table(data, kind, at, end, 8).reshape(-1, 2).tolist()))
    elif kind == b"stsc":
        t.runs = _table(data, kind, at, end, 12).reshape(-1, 3)
    elif kind == b"stss":
        t.keys = _table(data, kind, at, end, 4)
    elif kind in (b"stco", b"co64"):
        t.offsets = _table(data, kind, at, end, *((8, ">u8") if kind == b"co64" else (4,)))
    elif kind in (b"stsz", b"stz2"):
        t.sizes = _sizes(data, kind, at, end)


def _run(t: Track, given: dict[str, int], data: bytes, at: int, end: int, base: int, follow: int) -> int:
    """Adds a fragment's run of samples to its track; where its data ends. base: where its offset counts from; follow: where it starts without one."""
    flags, n = unpack_from(">II", data, at)
    at += 8
    start, first = follow, None
    if flags & 0x1:
        start, at = base + unpack_from(">i", data, at)[0], at + 4
    if flags & 0x4:
        first, at = unpack_from(">I", data, at)[0], at + 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + n * 4 * len(fields) > end or not fields and n * max(1, given.get("size", 0)) > len(data):
        raise ValueError(f"{n} samples in a run")
    each = dict(zip(fields, np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, -1).T, strict=True)) if fields else {}
    of = lambda name: each[name] if name in each else np.full(n, given.get(name, 0), np.int64)
    size, key = of("size"), of("flags") & NOT_KEY == 0
    if first is not None and n and "flags" not in each:
        key[0] = first & NOT_KEY == 0
    places = start + np.concatenate(([0], np.cumsum(size)))
    t.fragments.append((places[:-1], size, key, int(of("duration").sum())))
    return int(places[-1])


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, with the samples of its fragments. ValueError if boxes or tables don't fit together."""
    found: list[Track] = []
    fragment, given, moof, base, follow = None, {}, 0, 0, 0
    defaults: dict[int, dict[str, int]] = {}  # by track: duration, size and flags of a fragment's samples
    try:
        for path, start, at, end in _walk(data):
            kind = path[-1]
            if kind == b"trak":
                found.append(Track())
            elif kind == b"moof":
                moof = base = follow = start
            elif kind == b"trex":
                number, _, *values = unpack_from(">5I", data, at + 4)
                defaults[number] = dict(zip(("duration", "size", "flags"), values, strict=True))
            elif kind == b"tfhd":
                flags, number = unpack_from(">II", data, at)
                flags &= 0xFFFFFF
                fragment = next((t for t in found if t.number == number), None)
                if fragment is None:
                    raise ValueError(f"a fragment of track {number}")
                values, to = {}, at + 8
                for bit, width in TFHD.items():
                    if flags & bit:
                        values[bit] = unpack_from(">Q" if width == 8 else ">I", data, to)[0]
                        to += width
                base = values[0x1] if 0x1 in values else moof if flags & BASE_IS_MOOF else follow
                follow = base
                given = defaults.get(number, {}) | {name: values[bit] for bit, name in ((0x8, "duration"), (0x10, "size"), (0x20, "flags")) if bit in values}
            elif kind == b"trun" and b"traf" in path and fragment is not None:
                follow = _run(fragment, given, data, at, end, base, follow)
            elif b"trak" in path[:-1]:
                _described(found[-1], data, kind, at, end)
        for t in found:
            at, size, _ = t.samples()
            if len(at) and (int((at + size).max()) > len(data) or int(at.min()) < 0):
                raise ValueError("a sample beyond the end")
    except (StructError, IndexError) as e:
        raise ValueError(f"cut short: {e}") from None
    return found


def _copied(data: bytes, found: list[Track]) -> bytes:
    out = []
    for t in found:
        at, size, _ = t.samples()
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + size[:-1])))
            last = np.append(first[1:], len(at)) - 1
            out += [data[lo:hi] for lo, hi in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)]
    return b"".join(out)


def payload(data: bytes) -> bytes:
    """The samples of all tracks, in the order of their tables; samples that touch are copied in one piece."""
    return _copied(data, tracks(data))


DESCRIBED = "tracks array<struct<handler string, codec string, codecs array<string>, timescale long, duration long, seconds double, edits array<struct<duration long, media_time long>>, n_samples long, keyframes array<struct<first_byte long, n_bytes long>>>>, error string"


def describe(media: str | Column) -> Column:
    """A struct for a column of containers: tracks (handler, codecs, duration, edits, keyframe byte ranges), error.

    Null, empty and broken containers have no tracks; error says what is wrong, and is null for sound and empty ones.
    Fragments' samples come after those of the movie's own tables. Equal containers have equal values.
    """

    @F.arrow_udf(DESCRIBED)
    def read(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            found, error = [], None
            try:
                for t in tracks(r.as_py() or b""):
                    keys = [{"first_byte": a, "n_bytes": n} for a, n in t.key_ranges()]
                    edits = [{"duration": d, "media_time": m} for d, m in t.edits]
                    found.append({"handler": t.handler, "codec": t.codec, "codecs": t.codecs, "timescale": t.timescale, "duration": t.length, "seconds": t.length / t.timescale if t.timescale else None, "edits": edits, "n_samples": t.n_samples, "keyframes": keys})
            except ValueError as e:
                error = str(e)
            out.append({"tracks": found, "error": error})
        key = pa.struct([("first_byte", pa.int64()), ("n_bytes", pa.int64())])
        edit = pa.struct([("duration", pa.int64()), ("media_time", pa.int64())])
        track = pa.struct([("handler", pa.string()), ("codec", pa.string()), ("codecs", pa.list_(pa.string())), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("edits", pa.list_(edit)), ("n_samples", pa.int64()), ("keyframes", pa.list_(key))])
        return pa.array(out, pa.struct([("tracks", pa.list_(track)), ("error", pa.string())]))

    return read(media)


def as_media(text: str | Column) -> Column:
    """The container of a text's payload, as binary; null counts as empty."""

    @F.arrow_udf("binary")
    def write(texts: pa.Array) -> pa.Array:
        return pa.array([store(padded(t.as_py())) for t in texts], pa.binary())

    return write(text)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(text: str | Column) -> Column:
    """A struct for a column of texts: each is stored, and what the stored bytes say is read back from them.

    Null counts as the empty text, which has one frame of spaces. Texts are stored whole. Equal texts, equal values.
    """

    @F.arrow_udf(FEATURES)
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py() or ""
            media = store(padded(text))
            found = tracks(media)
            back, track = _copied(media, found), found[0]
            keys = track.key_ranges()
            said = f"codec={track.codec.strip()};handler={track.handler};timescale={track.timescale};duration={track.duration};samples={track.n_samples};chunks={len(track.offsets)};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]}"
            rows.append((len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), said))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    return of(text)

"""Byte-level BPE encoding and decoding.

A piece of text (what the pre-tokenizer's pattern finds) is encoded on a contiguous array of ranks: part boundaries
and, for each adjacent pair of parts, the rank of its merge. The smallest rank is looked for by a scan, its boundary is
deleted, and the ranks of the neighbouring pairs are refreshed, until no pair has a rank. Pieces of many bytes use a
heap over the same arrays, as scans would take time in the square of the length. Most words come again and again, so
each Python worker keeps the encodings of the short pieces it has seen, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of up to so many bytes are scanned and remembered; pieces remembered in a worker, in each of two generations.
SHORT, REMEMBERED = 48, 100_000
NO_RANK = 1 << 60
#: A merge is kept as its rank and id in one integer, under a key of the two ids.
ID_BITS = 20


def latin_pattern() -> bytes:
    """The same pattern for texts in Latin-1, as bytes. Letters come first, being the most; what a piece starts with decides its kind, so order doesn't matter."""
    kind = {k: b"".join(re.escape(bytes([b])) for b in range(256) if regex.match(rf"\p{{{k}}}", chr(b))) for k in ("L", "N", "White_Space")}
    letter, number, space = kind["L"], kind["N"], kind["White_Space"]
    return rb" ?[%b]+|'(?:s|t|re|ve|m|ll|d)| ?[%b]+| ?[^%b]+|[%b]+(?![^%b])|[%b]+" % (letter, number, space + letter + number, space, space, space)


def byte_chars() -> dict[str, int]:
    """The visible character that stands for each byte in vocabulary files: itself if printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file: merges of two ids, with rank and merged id; each id's bytes; special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, ids = byte_chars(), spec["model"]["vocab"]
        self.bytes = {i: bytes(map(chars.__getitem__, s)) for s, i in ids.items()}
        self.of_byte = [0] * 256
        for i, b in self.bytes.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.size = np.array([len(b) for b in table])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.split, self.latin_split = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.known, self.latin_known = Remembered(self, "utf-8"), Remembered(self, "latin-1")

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece."""
        return self._scanned(piece) if len(piece) <= SHORT else self._heaped(piece)

    def _scanned(self, piece: bytes) -> list[int]:
        parts = [self.of_byte[b] for b in piece]
        of, mask = self.merges.get, (1 << ID_BITS) - 1
        ranks = [of(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = new = best & mask
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = of(new << ID_BITS | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = of(parts[i - 1] << ID_BITS | new, NO_RANK)
        return parts

    def _heaped(self, piece: bytes) -> list[int]:
        parts, of = [self.of_byte[b] for b in piece], self.merges.get
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := of(parts[i] << ID_BITS | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            merge, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = merge & ((1 << ID_BITS) - 1), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := of(parts[a] << ID_BITS | parts[b])):
                    heapq.heappush(heap, (m, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as little-endian unsigned 32-bit integers. Special tokens' texts are these tokens."""
        if not any(map(text.__contains__, self.special)):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[part]) if i % 2 else self._plain(part) for i, part in enumerate(self.cut(text)))

    def _plain(self, text: str) -> bytes:
        try:
            return b"".join(map(self.latin_known.__getitem__, self.latin_split(text.encode("latin-1"))))
        except UnicodeEncodeError:
            return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        """The text of packed ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        raw = b"".join(self._bytes_of(ids[at : at + (1 << 18)]) for at in range(0, len(ids), 1 << 18))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


class Remembered(dict):
    """Packed ids by piece. When it is full, what it holds is the older generation, from which pieces come back as they are met."""

    def __init__(self, of: Vocabulary, encoding: str):
        self.of, self.utf8, self.older = of, encoding == "utf-8", {}

    def __missing__(self, piece: str | bytes) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.of.merged(piece.encode() if self.utf8 else piece.decode("latin-1").encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > SHORT:
                return packed
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))]))


def encode(text: str | Column, path: str) -> Column:
    """The ids of a text column as array<int>; null counts as empty and has none."""

    @F.arrow_udf("array<int>")
    def enc(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return _lists([v.encode(t.as_py() or "") for t in texts])

    return enc(text)


def decode(ids: str | Column, path: str) -> Column:
    """The text of a column of ids; null ids decode to null."""

    @F.arrow_udf("string")
    def dec(rows: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([v.decode(r.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).decode() if r.is_valid else None for r in rows], pa.string())

    return dec(ids)


def round_trip(text: str | Column, path: str) -> Column:
    """struct n_tokens, ids_sha256, decoded_sha256: a text encoded and decoded again, without keeping either."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        n, ids, decoded = [], [], []
        for t in texts:
            packed = v.encode(t.as_py() or "")
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(v.decode(packed)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def encoded(text: str | Column, path: str) -> Column:
    """struct ids, decoded_sha256: a text's ids, and what they decode to again."""

    @F.arrow_udf("ids array<int>, decoded_sha256 string")
    def of(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        packed = [v.encode(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([_lists(packed), pa.array([hashlib.sha256(v.decode(p)).hexdigest() for p in packed], pa.string())], ["ids", "decoded_sha256"])

    return of(text)

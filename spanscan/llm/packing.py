"""Best-fit packing of documents into sequences, with bounds that certify how few there are.

Documents are encoded, and longer ones are cut into pieces of a sequence's length. Pieces are dealt to groups of a
bounded size, at random but repeatably. Each group is packed by best-fit decreasing: from the longest piece on, each
goes to the open sequence that it leaves the least room in. No group can do with fewer sequences than its lower bound,
which comes from dual feasible functions: a function that maps lengths to shares such that the shares of whatever fits
a sequence sum to one at most, so that the sum of all shares, rounded up, is a bound. Where a group's sequences are as
many as its bound, its packing is certified.

What certified groups have in sequences with gaps, and all pieces of the other groups, then change groups and are
packed again, as long as the bound of all these pieces together leaves room for fewer sequences. A new packing counts
only if it has fewer. Sequences without a gap in certified groups stay as they are.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH, END_ID = 4096, 1
#: Tokens in a group about, and pieces.
GROUP_TOKENS, GROUP_PIECES = 1 << 22, 1 << 16
ROUNDS = 4
#: A group's number is less than this, and a round's.
GROUPS = 1 << 26
#: Words remembered in a worker, in each of two generations; longer ones are encoded each time.
REMEMBERED, SHORT = 400_000, 64
#: Characters at which Python splits a text and the tokenizer doesn't, and what special tokens begin with, whose case matters.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class Encoder(dict):
    """A tokenizer file of the public library whose pre-tokenizer drops white space, and packed ids by word.

    Such a tokenizer encodes a text as its words one after another, so a word is handed to the library when it is new.
    A word of letters and the punctuation after it are encoded one after the other too. A-Z are put in lower case, as
    the tokenizer does later. When the words are full they are the older generation, from which words come back as
    they are met.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.older = Tokenizer.from_file(path), {}
        self.library.no_truncation()
        self.library.no_padding()

    def by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            core = word.rstrip(punctuation)
            packed = self[core] + self[word[len(core) :]] if len(core) < len(word) and normalize("NFC", core).lower().isalpha() else self.by_library(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return self.by_library(text) if any(x in text for x in _ODD) else b"".join(map(self.__getitem__, text.encode().lower().decode().split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(text: str | Column, path: str, length: int = LENGTH, end_id: int = END_ID) -> Column:
    """array of piece, start, length, ids_crc32: a text's ids and the end, in pieces of `length` ids at most. Null counts as empty, which is an end alone."""
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(texts: pa.Array) -> pa.Array:
        enc, sizes, piece, start, long, crc = encoder(path), [0], [], [], [], []
        for t in texts:
            packed = enc.encode(t.as_py() or "") + end
            n, whole = 0, memoryview(packed)
            for at in range(0, len(packed), 4 * length):
                part = whole[at : at + 4 * length]
                piece.append(n)
                start.append(at // 4)
                long.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                n += 1
            sizes.append(sizes[-1] + n)
        each = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, long, crc))], ["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)

    return cut(text)


def lower_bound(counts: np.ndarray, length: int = LENGTH) -> int:
    """No packing has fewer sequences. counts: how many pieces there are of each length from 0 to `length`.

    The largest of three families of dual feasible functions: lengths over the sequence's length rounded to multiples
    of 1 / k (k up to 32; k = 0 is the plain sum), those that count pieces over half as whole and drop the ones that
    are shorter than a threshold, and those that round down what a number of equal pieces share.
    """
    sizes = np.flatnonzero(counts)
    n, best = counts[sizes].astype(np.int64), 0
    if not len(sizes):
        return 0
    sizes = sizes.astype(np.int64)
    best = -(-int((sizes * n).sum()) // length)
    for k in range(1, 33):  # x (k + 1) whole: stays; else rounded down to a multiple of 1 / k
        scaled, whole = sizes * (k + 1), (sizes * (k + 1)) % length == 0
        share = np.where(whole, sizes * k, scaled // length * length)
        best = max(best, -(-int((share * n).sum()) // (length * k)))
    total, mass = np.cumsum(n), np.cumsum(n * sizes)
    upto = lambda s, of: np.where((i := np.searchsorted(sizes, s, "right")) > 0, of[np.maximum(i, 1) - 1], 0)  # noqa: E731  of pieces of s or less
    t = np.arange(0, length // 2 + 1)  # pieces over length - t are whole ones, those of t to length - t keep their length, shorter ones go
    large = total[-1] - upto(length - t, total)
    middle = upto(length - t, mass) - upto(t - 1, mass)
    best = max(best, int((large + -(-middle // length)).max()))
    for t in np.unique(np.minimum(sizes, length // 2))[::-1][:256]:  # over half: what the others of t leave room for; down to t: how often t goes into it
        t = int(t)
        if t:
            fits, over = length // t, sizes > length // 2
            share = np.where(over, 2 * (fits - (length - sizes) // t), np.where(sizes == length / 2, fits, 2 * (sizes // t)))
            best = max(best, -(-int((np.where(sizes < t, 0, share) * n).sum()) // (2 * fits)))
    return best


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and offset, and the room left in each sequence. Ties: the piece that comes first, the sequence that was opened last."""
    order = np.argsort(-lengths, kind="stable")
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, n, room_of = 0, 0, []  # rooms: bit r is set if a sequence has r tokens of room
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            s = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            s, room, n = n, length, n + 1
            room_of.append(length)
        at[i], offset[i] = s, length - room
        room_of[s] = room = room - size
        if room:
            by_room[room].append(s)
            rooms |= 1 << room
    return at, offset, np.array(room_of, np.int64)


_ADDED = (("sequence_id", "long"), ("offset", "long"), ("gap", "boolean"), ("certified", "boolean"), ("opens", "boolean"))


def _packed(dealt: DataFrame, round_no: int, length: int) -> DataFrame:
    """dealt (grp, and the columns of pieces), packed group by group: with sequence_id, offset, gap (the sequence has room), certified (the group's bound is met), opens (the first of its sequence)."""
    names = [c for c in dealt.columns if c != "grp"]

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["place"].to_numpy()))  # the same whatever order rows come in
        at, offset, room = (x if k == 2 else x[np.argsort(order)] for k, x in enumerate(best_fit(lengths[order], length)))
        certified = len(room) == lower_bound(np.bincount(lengths, minlength=length + 1), length)
        first = (round_no * GROUPS + table["grp"][0].as_py()) << 32
        more = [pa.array(first + at), pa.array(offset), pa.array(room[at] > 0), pa.array(np.full(len(at), certified)), pa.array(offset == 0)]
        return pa.table([*(table[c] for c in names), *more], names=[*names, *(c for c, _ in _ADDED)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "grp")
    return dealt.groupBy("grp").applyInArrow(pack, schema + "".join(f", {c} {kind}" for c, kind in _ADDED))


def _counts(rows: DataFrame, length: int) -> np.ndarray:
    """How many pieces of each length: one row for each length comes to the driver."""
    out = np.zeros(length + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        out[r["length"]] = r["n"]
    return out


def pack(cut: DataFrame, length: int = LENGTH, rounds: int = ROUNDS, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """cut (place, piece, length and whatever else) with sequence_id and offset, and certified: whether the bound says that its group can't do with fewer.

    cut has to be a written table, as it is read several times. Ties go by place and piece.
    """

    def dealt(rows: DataFrame, counts: np.ndarray, round_no: int) -> DataFrame:
        tokens, n = int((counts * np.arange(length + 1)).sum()), int(counts.sum())
        groups = min(GROUPS - 1, max(1, -(-tokens // group_tokens), -(-n // group_pieces)))
        return rows.withColumn("grp", F.pmod(F.xxhash64("place", "piece", F.lit(round_no)), F.lit(groups)))

    names = [*cut.columns]
    now = written(_packed(dealt(cut, _counts(cut, length), 0), 0, length), "packed")
    settled = []
    for round_no in range(1, rounds + 1):
        stays = F.col("certified") & ~F.col("gap")
        pool = now.filter(~stays)
        counts, sequences = _counts(pool, length), pool.filter("opens").count()
        if sequences <= lower_bound(counts, length):
            break
        again = written(_packed(dealt(pool.select(*names), counts, round_no), round_no, length), "packed")
        if again.filter("opens").count() >= sequences:
            break
        settled.append(now.filter(stays))
        now = again
    for part in settled:
        now = now.unionByName(part)
    return now.drop("gap", "opens")


def certificate(packed: DataFrame, length: int = LENGTH) -> tuple[int, int]:
    """How many sequences there are, and how many there are at least in any packing of the same pieces."""
    return packed.filter("offset = 0").count(), lower_bound(_counts(packed, length), length)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", end_id: int = END_ID, **how: int) -> DataFrame:
    """A row for each piece of each document: key, piece (from 0), start, length, ids_crc32, sequence_id, offset, certified.

    A document's ids and the end; only documents longer than `length` are cut. Null and empty texts are an end alone.
    Repeated rows are packed each. Keys may be null and of any type; other columns may have any names. An empty table
    gives no rows. The pieces of one sequence lie without gaps from offset 0 on.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"), pieces(text, path, length, end_id).alias("p"))
    out = pack(written(rows.select("place", "key", F.inline("p")), "pieces"), length, **how)
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")

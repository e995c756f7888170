"""Readings of a text that hide less than the text itself, with where each of their characters comes from.

Spark has no compatibility normalisation, so this is an Arrow function; rows whose text can't differ are not sent to it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import INVISIBLE, LEET, LOOKALIKES

_LIKE = dict(zip(*LOOKALIKES, strict=True))
#: As `text.SPLIT`, with the vertical tab as white space too.
_LETTERS = r"\b[A-Za-z](?:\s[A-Za-z]){3,}"
_SPLIT = re.compile(_LETTERS, re.ASCII)
_CLUSTER = regex.compile(r"\X")
#: Texts that none of the steps can change: ASCII without runs of single letters, and without a digit or sign beside a letter.
ODD = rf"[^\x00-\x7F]|{_LETTERS}|[A-Za-z][{''.join(LEET)}]|[{''.join(LEET)}][A-Za-z]"


@dataclass
class Mapped:
    """Characters, and for each the stretch of the source that it stands for."""

    chars: list[str]
    starts: list[int]
    ends: list[int]

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def kept(self, which: list[int]) -> Mapped:
        return Mapped(*([of[i] for i in which] for of in (self.chars, self.starts, self.ends)))


def normalised(text: str) -> Mapped:
    """Compatibility forms by cluster, look-alikes folded, invisible characters left out, single letters drawn together."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for cluster in text if text.isascii() else _CLUSTER.findall(text):
        for c in unicodedata.normalize("NFKC", cluster):
            chars.append(c)
            starts.append(at)
            ends.append(at + len(cluster))
        at += len(cluster)
    if not text.isascii() and (whole := unicodedata.normalize("NFKC", text)) != "".join(chars):
        chars, starts, ends = list(whole), [0] * len(whole), [len(text)] * len(whole)  # no telling which character is whose
    folded = Mapped([_LIKE.get(c, c) for c in chars], starts, ends)
    shown = folded.kept([i for i, c in enumerate(folded.chars) if c not in INVISIBLE])
    gone = {i for m in _SPLIT.finditer(shown.text) for i in range(*m.span()) if shown.chars[i].isspace()}
    return shown.kept([i for i in range(len(shown.chars)) if i not in gone]) if gone else shown


def unleeted(of: Mapped) -> Mapped:
    """Digits and signs read as letters where an ASCII letter stands beside them."""
    letter = [c.isascii() and c.isalpha() for c in of.chars]
    beside = lambda i: i > 0 and letter[i - 1] or i + 1 < len(letter) and letter[i + 1]
    return Mapped([LEET[c] if c in LEET and beside(i) else c for i, c in enumerate(of.chars)], of.starts, of.ends)


#: Texts of these characters alone have no cluster of more than one: Latin, Greek and Cyrillic letters, signs, and invisible ones that join nothing.
_SINGLE = re.compile("[\\n\\t\\x20-\u02ff\u0370-\u03ff\u0400-\u0482\u048a-\u052f\u200b\u2010-\u2027\u2060\ufeff]*")
_FOLDED, _HIDDEN = str.maketrans(_LIKE), str.maketrans("", "", INVISIBLE)
_NUMBERS = "".join(LEET)
_BESIDE = re.compile(f"(?<=[A-Za-z])[{_NUMBERS}]|[{_NUMBERS}](?=[A-Za-z])")


def _plain(text: str) -> str:
    """The text of `normalised`, without where its characters come from."""
    shown = (text if text.isascii() else unicodedata.normalize("NFKC", text)).translate(_FOLDED).translate(_HIDDEN)
    return _SPLIT.sub(lambda m: "".join(m[0].split()), shown)


def _sources(text: str) -> tuple[np.ndarray | list[int], np.ndarray | list[int]]:
    """Where the characters of `normalised` start and end in the text. Where each character is a cluster and its own normal form, they are found without a step for each."""
    if not _SINGLE.fullmatch(text) or not unicodedata.is_normalized("NFKC", text):
        slow = normalised(text)
        return slow.starts, slow.ends
    at = np.arange(len(text), dtype=np.int32)
    if not text.isascii():
        at = at[~np.isin(np.frombuffer(text.translate(_FOLDED).encode("utf-32-le"), np.uint32), [ord(c) for c in INVISIBLE])]
    shown = text.translate(_FOLDED).translate(_HIDDEN)
    gone = [i for m in _SPLIT.finditer(shown) for i in range(*m.span()) if shown[i].isspace()]
    at = np.delete(at, gone) if gone else at
    return at, at + np.int32(1)


def _readings(text: str, leet: bool) -> dict[str, dict | None]:
    plain = _plain(text)
    other = _BESIDE.sub(lambda m: LEET[m[0]], plain) if leet else plain
    normal, more = plain != text, other not in (plain, text)
    starts, ends = _sources(text) if normal or more else ([], [])
    row = lambda t: {"text": t, "starts": starts, "ends": ends}
    return {"normal": row(plain) if normal else None, "leet": row(other) if more else None}


READING = "struct<text:string,starts:array<int>,ends:array<int>>"


def readings(text: Column, leet: bool = True) -> Column:
    """A struct normal, leet: readings (text, starts, ends) where they differ from the text and from each other; null where not."""

    @F.arrow_udf(f"normal {READING}, leet {READING}")
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
        return pa.array([_readings(t.as_py(), leet) if t.is_valid else {"normal": None, "leet": None} for t in texts], pa.struct([("normal", kind), ("leet", kind)]))

    return of(F.when(text.rlike(ODD), text))

"""What a text must hold for a pattern to match in it, worked out from the patterns once, on the driver.

A pattern's matches are described by forms: strings in which ANY stands for any text and SIGNS for one or more
characters that aren't ASCII letters or digits. The forms may describe more than the pattern matches, never less. From
them come groups of marks, of each of which a text with a match has one, and literals. A mark is a whole word ("=word",
between spaces), a word's first or last EDGE characters ("^begi", "$ends") or a run of signs ("!signs"), so a text's
marks come from splitting it once, whatever the number of patterns. A pattern that can't be told by forms has neither
marks nor literals, and is run on every text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

ANY, SIGNS = "\0", "\1"
#: How many forms a pattern may have, how many characters of a class are told one by one, how many groups of marks are asked for, the shortest literal, and a word's edge.
MOST, FEW, GROUPS, SHORTEST, EDGE = 3000, 5, 3, 2, 4

_SIGNS = r"[^a-z0-9\s]{2,}"
_LONG = re.compile("[a-z0-9]{4,}")


class _Unknown(Exception):
    """The pattern can't be told by forms."""


def _sign(c: str) -> bool:
    return not (c.isascii() and c.isalnum())


def _product(a: list[str], b: list[str]) -> list[str]:
    if len(a) * len(b) > MOST:
        raise _Unknown
    return list(dict.fromkeys(x + y for x in a for y in b))


def _member(items: list) -> list[str]:
    """Forms of one character of a class."""
    if items[0][0] is K.NEGATE:
        return [ANY]
    chars, signs = set(), False
    for kind, value in items:
        if kind is K.LITERAL:
            chars.add(chr(value))
        elif kind is K.RANGE and value[1] - value[0] < FEW:
            chars |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif kind is K.CATEGORY and value is K.CATEGORY_SPACE:
            signs = True
        else:
            return [ANY]
    if any(ord(c) < 2 for c in chars) or len(chars) > FEW or any(not c.isascii() and c.isalpha() for c in chars):
        return [ANY]
    if all(map(_sign, chars)) and (signs or len(chars) > 2):
        return [SIGNS]
    return [ANY] if signs else sorted({c.lower() for c in chars})


def _repeated(forms: list[str], least: int, most: int) -> list[str]:
    if (least, most) == (1, 1):
        return forms
    if forms == [ANY]:
        return forms
    once = forms
    if most > 1:  # any text that ends as one of the forms; runs of signs stay runs of signs
        once = [SIGNS] if all(f and ANY not in f and all(map(_sign, f)) for f in forms) else _product([ANY], forms)
    return once if least else ["", *once]


def _of(tree) -> list[str]:
    forms = [""]
    for kind, value in tree:
        if kind is K.LITERAL:
            c = chr(value)
            one = [c.lower()] if c.isascii() and value > 1 else [ANY]  # the case of other letters is folded by more than one rule
        elif kind is K.IN:
            one = _member(value)
        elif kind in (K.ANY, K.NOT_LITERAL):
            one = [ANY]
        elif kind is K.BRANCH:
            one = list(dict.fromkeys(f for branch in value[1] for f in _of(branch)))
        elif kind is K.SUBPATTERN:
            if value[1] & re.VERBOSE:
                raise _Unknown
            one = _of(value[3])
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            one = _repeated(_of(value[2]), value[0], value[1])
        elif kind is K.ATOMIC_GROUP:
            one = _of(value)
        elif kind in (K.AT, K.ASSERT, K.ASSERT_NOT):
            one = [ANY]  # holds no text; as any text it asks for nothing of what is beside it
        else:
            raise _Unknown
        forms = _product(forms, one)
    return forms


def forms(pattern: str) -> list[str] | None:
    """The forms of a pattern that Java runs, lower-case; None where they can't be told."""
    plain = re.sub(r"\\.", "x", pattern)
    if re.search(r"\(\?[a-zA-Z]*[ux]", pattern) or "&&" in plain or r"\Q" in pattern or re.search(r"\[[^\]]*\[", plain) or re.search(r"\\[^nrt\W\dsSwWdDbB]", re.sub(r"\\\\", "", pattern)):
        return None  # other letters that fold to ASCII, classes inside classes, quoting and escapes that Python's parser reads otherwise, or not at all
    try:
        tree = _parser.parse(pattern)
        return None if tree.state.flags & re.VERBOSE else _of(tree)
    except (_Unknown, re.error, OverflowError, RecursionError):
        return None


def _marks(form: str) -> set[str]:
    known = r"[^ \0\1]"
    return (
        {f"={w}" for w in re.findall(f"(?<= ){known}+(?= )", form)} | {f"^{w}" for w in re.findall(f"(?<= ){known}{{{EDGE}}}", form)}
        | {f"${w}" for w in re.findall(f"{known}{{{EDGE}}}(?= )", form)} | {f"!{w}" for w in re.findall(_SIGNS.replace("\\s", "\\s\0\1"), form)}
    )


def _rare(left: list[set[str]], cost: dict[str, float]) -> set[str]:
    """Pieces of which each form has one, chosen one after another by how many forms they do for and their cost."""
    chosen = set()
    while left:
        held = Counter(p for f in left for p in f)
        best = max(held, key=lambda p: (held[p] / cost[p], p))
        chosen.add(best)
        left = [f for f in left if best not in f]
    return chosen


@lru_cache(4096)
def needs(pattern: str) -> tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]:
    """Groups of marks, and literals: each text with a match has a mark of every group and, if there are any, one of the literals."""
    told = forms(pattern) or []
    left, groups = [_marks(f) for f in told], []
    signs = {m for f in left for m in f if m[0] == "!"}
    left = [f | {m for m in signs if m[1:] in form} for f, form in zip(left, told, strict=True)]  # a run holds what is in it
    cost = {m: 3.0 ** -(7 if m[0] == "!" else 4 if m[0] != "=" else min(len(m), 9)) + 0.002 for f in left for m in f}
    while left and all(left) and len(groups) < GROUPS:
        group = _rare(left, cost)
        groups.append(tuple(sorted(group)))
        left = [f - group for f in left]
    pieces = [[x for x in re.split(r"[\0\1]+", f) if len(x) >= SHORTEST] for f in told]
    every = {p for f in pieces for x in f for p in (x, *_LONG.findall(x))}
    literals = _rare([{p for p in every if any(p in x for x in f)} for f in pieces], {p: 3.0 ** -min(len(p), 9) + 0.002 for p in every}) if pieces and all(pieces) else ()
    return tuple(groups), tuple(sorted(literals))


#: What a text can be asked for by one plain test: a digit, a run of RUN characters of keys, or a sign.
RUN, _DIGITS, _KEYS = 20, set("0123456789"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-")


def _class(items: list) -> set[str] | None:
    """The characters of a class; None where it has others than ASCII ranges and characters."""
    out: set[str] = set()
    for kind, value in items:
        if kind is K.LITERAL and value < 128:
            out.add(chr(value))
        elif kind is K.RANGE and value[1] < 128:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _asked(tree) -> set[str]:
    """What every match of a sequence holds: "0" for a digit, "run" for a run of characters of keys, and signs."""
    out: set[str] = set()
    for kind, value in tree:
        if kind is K.LITERAL and value < 128 and _sign(chr(value)) and chr(value) != " ":
            out.add(chr(value))
        elif kind is K.LITERAL and chr(value) in _DIGITS or kind is K.IN and (chars := _class(value)) and chars <= _DIGITS:
            out.add("0")
        elif kind is K.SUBPATTERN:
            out |= _asked(value[3])
        elif kind is K.BRANCH:
            out |= set.intersection(*[_asked(branch) for branch in value[1]])
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            out |= _asked(value[2])
            if value[0] >= RUN and len(value[2]) == 1 and value[2][0][0] is K.IN and (chars := _class(value[2][0][1])) and chars <= _KEYS:
                out.add("run")
    return out


@lru_cache(4096)
def asks(pattern: str) -> tuple[str, ...]:
    """What each text with a match of the pattern holds, of digits ("0"), runs of characters of keys ("run") and single signs. None where `forms` doesn't trust Python's parser, or where the case of letters is folded, which may widen a class."""
    if forms(pattern) is None and re.search(r"\(\?|\\[^nrtWdsSwDbB.+?*()\[\]{}|/^$-]|&&", pattern.replace("(?:", "(")):
        return ()
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ()
    return () if tree.state.flags & (re.VERBOSE | re.IGNORECASE) else tuple(sorted(_asked(tree)))


def held(text: Column, patterns: tuple[str, ...]) -> Column:
    """Those of the things that any of the patterns asks for that a text holds."""
    test = {"0": "[0-9]", "run": f"[A-Za-z0-9_/+-]{{{RUN}}}"}
    asked = sorted({a for p in patterns for a in asks(p)})
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(test[a])) if a in test else F.contains(text, F.lit(a)), F.lit(a)) for a in asked])) if asked else F.array().cast("array<string>")


def marks(low: Column, patterns: tuple[str, ...]) -> Column:
    """Those marks of a text, in lower case, that any of the patterns asks for."""
    asked = sorted({m for p in patterns for g in needs(p)[0] for m in g})
    of = lambda kind: F.lit([m[1:] for m in asked if m[0] == kind]) if any(m[0] == kind for m in asked) else F.array().cast("array<string>")
    named = lambda kind, found: F.transform(found, lambda w: F.concat(F.lit(kind), w))

    def each(words: Column) -> Column:
        first, last = F.transform(words, lambda w: F.substring(w, 1, EDGE)), F.transform(words, lambda w: F.right(w, F.lit(EDGE)))
        return F.concat(named("=", F.array_intersect(words, of("="))), named("^", F.array_intersect(first, of("^"))), named("$", F.array_intersect(last, of("$"))))

    return F.concat(let(F.array_distinct(F.split(low, " ")), each), named("!", F.filter(of("!"), lambda s: F.contains(low, s))))

"""Regular expressions of askers, in Python's syntax: checked, put into the engine's syntax, and read for what a match must hold.

Case is ignored: texts are lower-cased, ASCII letters of a pattern match both cases and its other letters are lower-cased.
The reading is done by the standard library's own parser; where an interpreter hasn't got it, nothing is known of a
pattern and texts are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

try:
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # not part of the library's promised surface
    K = parser = None

#: What isn't part of a word, the same in every engine; and how the standard library says it.
EDGE = r"[^\p{L}\p{N}_]"
_EDGE = r"[^\w]"
#: Alternatives that a reading keeps; what would make more is left out of it, which only lets more texts through.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Piece:
    """A text that a word must equal (whole), begin with, end with or hold."""

    text: str
    begins: bool = False  # the word begins with it
    ends: bool = False

    @property
    def whole(self) -> bool:
        return self.begins and self.ends


@dataclass(frozen=True)
class Reading:
    """Alternatives, of each of which a match holds every piece. None: nothing is known. exact: a text matches if, and only if, it holds them."""

    alternatives: tuple[frozenset[Piece], ...] | None
    exact: bool = False


def _flags(pattern: str) -> tuple[str, str]:
    """The inline flags in front of a pattern, and the rest."""
    found = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return (found[1], pattern[found.end() :]) if found else ("", pattern)


def translate(pattern: str) -> str:
    """A pattern of Python's as the engine takes it, case ignored. ValueError for what one of both doesn't know."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(f"no pattern: {e}") from e
    flags, rest = _flags(pattern)
    if set(flags) - set("imsu"):
        raise ValueError(f"flags {flags} aren't taken, only i, m, s and u")
    out, i, inside = [], 0, False
    while i < len(rest):
        two, char = rest[i : i + 2], rest[i]
        named = None if inside else re.match(r"\(\?P(<\w+>|=\w+\))", rest[i:])
        if char == "\\":
            if two in (r"\N", r"\g") or (inside and two == r"\b"):
                raise ValueError(f"{two} isn't taken here")
            out.append(r"\z" if two == r"\Z" else two)
            i += 2
            continue
        if named:
            out.append(rf"\k<{named[1][1:-1]}>" if named[1][0] == "=" else "(?" + named[1])
            i += named.end()
            continue
        if not inside and (two == "(?" and rest[i : i + 3] in ("(?(", "(?#")):
            raise ValueError("conditions and comments aren't taken")
        if not inside and (ranged := re.match(r"\{,(\d+)\}", rest[i:])):
            out.append(f"{{0,{ranged[1]}}}")
            i += ranged.end()
            continue
        if not inside and char in "{}" and not re.match(r"\{\d+(,\d*)?\}", rest[i:]) and not (char == "}" and re.search(r"\{\d+(,\d*)?$", rest[:i])):
            out.append("\\" + char)  # a brace that repeats nothing stands for itself
        elif inside and char in "[&":
            out.append("\\" + char)  # classes neither nest nor meet
        else:
            out.append(char if char.isascii() else char.lower())
        if not inside and char == "[":
            inside = True
            if rest[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if rest[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif inside and char == "]":
            inside = False
        i += 1
    words = "U" if re.search(r"\\[bBwWdDsS]", rest) else ""  # words and digits of all scripts
    made = f"(?id{''.join(sorted(set(flags) & set('ms')))}{words})" + "".join(out)
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(made)
        except Exception as e:
            raise ValueError(f"the engine doesn't take the pattern {pattern}") from e
    return made


def from_terms(terms: Sequence[str] | str, whole_word: bool = True) -> str:
    """Any of the terms, each as it is, alone between what isn't part of a word if wanted."""
    given = terms.split(",") if isinstance(terms, str) else terms
    kept = [re.escape(t.strip().lower()) for t in given if t.strip()]
    if not kept:
        raise ValueError("no term is left")
    return "|".join(f"(^|{EDGE}){t}({EDGE}|$)" if whole_word else t for t in kept)


def _parsed(pattern: str):
    """The parser's tree of an engine's pattern, None where there is none."""
    if parser is None:
        return None
    flags, rest = _flags(pattern)
    # What the engine writes in another way is turned back.
    rest = rest.replace(EDGE, _EDGE).replace(r"\z", r"\Z")
    rest = re.sub(r"\(\?<(\w+)>", r"(?P<\1>", re.sub(r"\\k<(\w+)>", r"(?P=\1)", rest))
    try:
        return parser.parse(rest, re.MULTILINE if "m" in flags else 0)
    except (re.error, OverflowError, RecursionError):
        return None


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _flat(items) -> list:
    """A sequence with plain groups opened."""
    out = []
    for kind, value in items:
        if kind is K.SUBPATTERN and not value[1] and not value[2]:
            out += _flat(value[3])
        elif kind is K.ATOMIC_GROUP:
            out += _flat(value)
        else:
            out.append((kind, value))
    return out


def _parts(item, left: bool) -> bool:
    """Whether an item sure parts words: what it matches has no letter, digit or underscore at the side (left: its left end) that meets a word."""
    kind, value = item
    if kind is K.AT:
        return value not in (K.AT_NON_BOUNDARY,)
    if kind is K.LITERAL:
        return not _is_word(chr(value))
    if kind is K.IN:
        negated = value[0][0] is K.NEGATE
        if negated:
            return (K.CATEGORY, K.CATEGORY_WORD) in value
        return all((k is K.LITERAL and not _is_word(chr(v))) or (k is K.CATEGORY and v in (K.CATEGORY_SPACE, K.CATEGORY_NOT_WORD)) for k, v in value)
    if kind is K.CATEGORY:
        return value in (K.CATEGORY_SPACE, K.CATEGORY_NOT_WORD)
    if kind is K.BRANCH:
        return all(branch and _parts(_flat(branch)[0 if left else -1], left) for branch in value[1])
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        inner = _flat(value[2])
        return value[0] >= 1 and bool(inner) and _parts(inner[0 if left else -1], left)
    return False


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    """Alternatives of two things that must both hold; a thing that would make too many is left out, the one with fewer pieces."""
    made = list(dict.fromkeys(x | y for x in a for y in b))
    if len(made) <= MOST_ALTERNATIVES:
        return made
    return max(a, b, key=lambda x: min(map(len, x)))


def _needs(items: list, before: bool, after: bool) -> list[frozenset]:
    """Alternatives of pieces of a flat sequence. before, after: whether what stands around it parts words."""
    out = [frozenset()]
    i = 0
    while i < len(items):
        kind, value = items[i]
        parted_before = _parts(items[i - 1], False) if i else before
        if kind is K.LITERAL and _is_word(chr(value)):
            j = i
            while j < len(items) and items[j][0] is K.LITERAL and _is_word(chr(items[j][1])):
                j += 1
            text = "".join(chr(v) for _, v in items[i:j]).lower()
            parted_after = _parts(items[j], True) if j < len(items) else after
            out = _both(out, [frozenset([Piece(text, parted_before, parted_after)])])
            i = j
            continue
        parted_after = _parts(items[i + 1], True) if i + 1 < len(items) else after
        if kind is K.BRANCH:
            either = [x for branch in value[1] for x in _needs(_flat(branch), parted_before, parted_after)]
            out = _both(out, list(dict.fromkeys(either))) if len(either) <= MOST_ALTERNATIVES else out
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            once = value[0] == value[1] == 1
            out = _both(out, _needs(_flat(value[2]), parted_before and once, parted_after and once))
        i += 1
    return out


def _only_pieces(items: list) -> bool:
    """Whether a sequence is one piece of a word, with or without edges, and nothing else, or alternatives of such; the parser takes what alternatives share out of them."""
    for n, (kind, value) in enumerate(items):
        if kind is K.BRANCH and not _is_edge(items[n]):
            return all(_only_pieces([*items[:n], *_flat(branch), *items[n + 1 :]]) for branch in value[1])
    inner = items[bool(items) and _is_edge(items[0]) :]
    inner = inner[: len(inner) - (len(inner) > 1 and _is_edge(inner[-1]))]
    return bool(inner) and all(k is K.LITERAL and _is_word(chr(v)) for k, v in inner)


def _is_edge(item) -> bool:
    kind, value = item
    return (kind is K.AT and value is K.AT_BOUNDARY) or (kind is K.BRANCH and sorted(map(_edge_kind, value[1])) == ["end", "word"])


def _edge_kind(branch) -> str:
    flat = _flat(branch)
    if len(flat) == 1 and flat[0][0] is K.AT and flat[0][1] in (K.AT_BEGINNING, K.AT_END):
        return "end"
    if len(flat) == 1 and flat[0] in ((K.IN, [(K.NEGATE, None), (K.CATEGORY, K.CATEGORY_WORD)]), (K.IN, [(K.CATEGORY, K.CATEGORY_NOT_WORD)])):
        return "word"
    return "other"


def read(pattern: str) -> Reading:
    """What a match of an engine's pattern must hold, as words of letters, digits and underscores."""
    tree = _parsed(pattern)
    if tree is None:
        return Reading(None)
    items = _flat(tree)
    found = _needs(items, False, False)
    if not all(found):
        return Reading(None)
    # An alternative that holds all of another's pieces adds nothing.
    least = tuple(a for a in found if not any(b < a for b in found))
    return Reading(least, _only_pieces(items))


def literals(pattern: str) -> list[str] | None:
    """Texts of which every match holds one (in lower case); None where that can't be told."""
    tree = _parsed(pattern)
    if tree is None:
        return None

    def longest(items) -> str:
        """The longest run of plain characters among the items of a sequence."""
        runs = [""]
        for kind, value in items:
            runs = [*runs[:-1], runs[-1] + chr(value).lower()] if kind is K.LITERAL else [*runs, ""]
        return max(runs, key=len)

    flat = _flat(tree)
    if whole := longest(flat):
        return [whole]
    for kind, value in flat:
        if kind is K.BRANCH:
            found = [longest(_flat(branch)) for branch in value[1]]
            if all(found):
                return found
    return None

r"""Patterns of the RE2 dialect as Java patterns.

A pattern is parsed into a tree, and the tree is written out in forms that mean the same to Java whatever flags are
on: letters that ignore case become their fold sets, anchors and word boundaries become look-around, classes become
ranges of code points. What has no equal, or is not RE2, raises `PatternError` before any job starts.
"""
from __future__ import annotations

import re
import sys
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache

LAST = sys.maxunicode
MOST_REPEATS = 1000
MOST_DEPTH = 150

# POSIX classes of the dialect, which are ASCII only.
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09",
    "graph": "!~", "lower": "az", "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZaz__", "xdigit": "09AFaf",
}
# Perl classes of the dialect, ASCII too; white space lacks the vertical tab.
PERL = {"d": "09", "s": "\t\n\f\r  ", "w": "09AZaz__"}
# General categories.
CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
# Scripts that both dialects know by the same name.
SCRIPTS = frozenset(
    "Arabic Armenian Balinese Bengali Bopomofo Braille Buginese Canadian_Aboriginal Cherokee Common Coptic Cuneiform Cypriot Cyrillic Deseret "
    "Devanagari Ethiopic Georgian Glagolitic Gothic Greek Gujarati Gurmukhi Han Hangul Hanunoo Hebrew Hiragana Inherited Kannada Katakana "
    "Kayah_Li Kharoshthi Khmer Lao Latin Lepcha Limbu Linear_B Lycian Lydian Malayalam Mongolian Myanmar New_Tai_Lue Nko Ogham Ol_Chiki "
    "Old_Italic Old_Persian Oriya Osmanya Phags_Pa Phoenician Rejang Runic Saurashtra Shavian Sinhala Sundanese Syloti_Nagri Syriac Tagalog "
    "Tagbanwa Tai_Le Tamil Telugu Thaana Thai Tibetan Tifinagh Ugaritic Vai Yi".split())
# Escapes of single characters.
ESCAPES = {"a": "\a", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
WORD_CHAR = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
REPEAT = re.compile(r"\{(\d+)(,?)(\d*)\}")
FLAGS = re.compile(r"\(\?([imsU]*)(-[imsU]+)?([:)])")

Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """A pattern that is not RE2, or that has no equal among Java's."""


# The tree. Each node says whether it can match nothing, and writes itself as an atom: safe to repeat or to stand in a row.
@dataclass(frozen=True)
class Node:
    nullable = False

    def java(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Chars(Node):
    """One character of a set."""

    ranges: Ranges
    properties: tuple[str, ...] = ()
    negated: bool = False

    def java(self) -> str:
        inner = "".join(_point(a) if a == b else f"{_point(a)}-{_point(b)}" for a, b in self.ranges) + "".join(self.properties)
        if not inner:
            return "(?s:.)" if self.negated else "(?!)"
        if not self.negated and not self.properties and len(self.ranges) == 1 and self.ranges[0][0] == self.ranges[0][1]:
            return _point(self.ranges[0][0])
        return f"[{'^' * self.negated}{inner}]"


@dataclass(frozen=True)
class Place(Node):
    """A condition on the place: takes up nothing."""

    text: str
    nullable = True

    def java(self) -> str:
        return self.text


@dataclass(frozen=True)
class Row(Node):
    parts: tuple[Node, ...]

    @property
    def nullable(self) -> bool:
        return all(p.nullable for p in self.parts)

    def java(self) -> str:
        return "(?:" + "".join(p.java() for p in self.parts) + ")"


@dataclass(frozen=True)
class Choice(Node):
    options: tuple[Node, ...]

    @property
    def nullable(self) -> bool:
        return any(o.nullable for o in self.options)

    def java(self) -> str:
        return "(?:" + "|".join(o.java() for o in self.options) + ")"


@dataclass(frozen=True)
class Group(Node):
    body: Node
    name: str | None = None

    @property
    def nullable(self) -> bool:
        return self.body.nullable

    def java(self) -> str:
        return f"({self.body.java()})"


@dataclass(frozen=True)
class Repeat(Node):
    body: Node
    least: int
    most: int | None
    greedy: bool

    @property
    def nullable(self) -> bool:
        return self.least == 0 or self.body.nullable

    def java(self) -> str:
        times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((self.least, self.most))
        if times is None:
            times = f"{{{self.least}}}" if self.least == self.most else f"{{{self.least},{'' if self.most is None else self.most}}}"
        return f"(?:{self.body.java()}{times}{'' if self.greedy else '?'})"


def _point(code: int) -> str:
    text = chr(code)
    return text if text.isascii() and text.isalnum() else f"\\x{{{code:X}}}"


@cache
def _folds() -> dict[int, tuple[int, ...]]:
    """Characters that differ in case only (simple folding), of each that has such."""
    same = defaultdict(list)
    for code in range(LAST + 1):
        text = chr(code)
        folded = text.casefold()
        folded = folded if len(folded) == 1 else text.lower()
        if len(folded) == 1:
            same[folded].append(code)
    return {c: tuple(group) for group in same.values() if len(group) > 1 for c in group}


def _merged(ranges: list[tuple[int, int]]) -> Ranges:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return tuple(out)


def _pairs(text: str) -> list[tuple[int, int]]:
    return [(ord(a), ord(b)) for a, b in zip(text[::2], text[1::2], strict=True)]


def _complement(ranges: Ranges) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in ranges:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, LAST)] if at <= LAST else out


def _with_case(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    folds = _folds()
    inside = lambda c: any(a <= c <= b for a, b in ranges)
    return [*ranges, *((other, other) for c, same in folds.items() if inside(c) for other in same)]


@dataclass
class Flags:
    fold: bool = False
    lines: bool = False
    dot_all: bool = False
    ungreedy: bool = False

    def changed(self, on: str, off: str) -> Flags:
        names = {"i": "fold", "m": "lines", "s": "dot_all", "U": "ungreedy"}
        return Flags(**{**vars(self), **{names[c]: True for c in on}, **{names[c]: False for c in off}})


@dataclass
class Parser:
    text: str
    at: int = 0
    groups: int = 0
    names: set[str] = field(default_factory=set)

    def ahead(self, text: str) -> bool:
        return self.text.startswith(text, self.at)

    def take(self) -> str:
        if self.at >= len(self.text):
            raise PatternError("the pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def choice(self, flags: Flags, depth: int = 0) -> Node:
        """Up to a closing bracket or the end. Flags that are set inside stay for all that follows, later options included."""
        if depth > MOST_DEPTH:
            raise PatternError("groups are nested too deeply")
        options: list[Node] = []
        parts: list[Node] = []
        repeated = False  # the last part is a repetition
        while self.at < len(self.text) and not self.ahead(")"):
            if self.ahead("|"):
                self.at += 1
                options.append(_row(parts))
                parts, repeated = [], False
                continue
            if (found := self.repetition(flags)) is not None:
                if not parts:
                    raise PatternError("nothing to repeat")
                if repeated:
                    raise PatternError("a repetition of a repetition")
                parts[-1] = _repeat(parts[-1], *found)
                repeated = True
                continue
            if self.ahead("(?") and (m := FLAGS.match(self.text, self.at)) and m[3] == ")":
                self.at = m.end()
                flags = flags.changed(m[1], (m[2] or "")[1:])
                if not m[1] and not m[2]:
                    raise PatternError("no flags")
                continue
            if self.ahead(r"\Q"):
                end = self.text.find(r"\E", self.at)
                literal = self.text[self.at + 2 : end if end >= 0 else None]
                self.at = len(self.text) if end < 0 else end + 2
                parts += [_literal(ord(c), flags) for c in literal]
                repeated = repeated and not literal
                continue
            parts.append(self.atom(flags, depth))
            repeated = False
        options.append(_row(parts))
        return options[0] if len(options) == 1 else Choice(tuple(options))

    def repetition(self, flags: Flags) -> tuple[int, int | None, bool] | None:
        """Least, most, greedy. Braces that are no repetition are characters."""
        simple = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(self.text[self.at])
        if simple is not None:
            self.at += 1
            least, most = simple
        elif m := REPEAT.match(self.text, self.at):
            if m[3] and not m[2]:
                return None
            self.at = m.end()
            least, most = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
            if max(least, most or 0) > MOST_REPEATS or most is not None and most < least:
                raise PatternError(f"repetition {m[0]}")
        else:
            return None
        lazy = self.ahead("?")
        self.at += lazy
        return least, most, lazy == flags.ungreedy

    def atom(self, flags: Flags, depth: int) -> Node:
        if self.ahead("("):
            return self.group(flags, depth)
        if self.ahead("["):
            return self.char_class(flags)
        if self.ahead("\\"):
            return self.escape(flags)
        char = self.take()
        if char == ".":
            return Chars((), negated=True) if flags.dot_all else Chars(((10, 10),), negated=True)
        if char == "^":
            return Place(r"(?:\A|(?<=\x{A}))" if flags.lines else r"\A")
        if char == "$":
            return Place(r"(?:\z|(?=\x{A}))" if flags.lines else r"\z")
        return _literal(ord(char), flags)

    def group(self, flags: Flags, depth: int) -> Node:
        name, capture = None, True
        if m := FLAGS.match(self.text, self.at):
            self.at, capture = m.end(), False
            flags = flags.changed(m[1], (m[2] or "")[1:])
        elif m := re.compile(r"\(\?P?<([A-Za-z0-9_]+)>").match(self.text, self.at):
            self.at, name = m.end(), m[1]
            if name in self.names:
                raise PatternError(f"two groups called {name}")
            self.names.add(name)
        elif self.ahead("(?"):
            raise PatternError(f"group {self.text[self.at : self.at + 4]}")
        else:
            self.at += 1
        self.groups += capture
        body = self.choice(flags, depth + 1)
        if not self.ahead(")"):
            raise PatternError("a group without an end")
        self.at += 1
        return Group(body, name) if capture else body

    def escape(self, flags: Flags) -> Node:
        here = self.text[self.at + 1 : self.at + 2]
        if here in ("A", "z", "b"):
            self.at += 2
            return Place({"A": r"\A", "z": r"\z", "b": BOUNDARY}[here])
        if here in ("B", "C"):
            raise PatternError(f"escape \\{here}, which works on bytes")
        if here and here.lower() in PERL:
            self.at += 2
            return _chars(_pairs(PERL[here.lower()]), here.isupper(), flags)
        if here in ("p", "P"):
            return Chars((), (self.property(flags),))
        return _literal(self.escaped(), flags)

    def escaped(self) -> int:
        """The code of an escaped character."""
        self.at += 1
        char = self.take()
        if char in ESCAPES:
            return ord(ESCAPES[char])
        if char == "x":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.text, self.at)
            code = int(m[1] or m[2], 16) if m else LAST + 1
            if code > LAST or 0xD800 <= code < 0xE000:
                raise PatternError("escape \\x")
            self.at = m.end()
            return code
        if char in "01234567":
            m = re.compile(r"[0-7]{0,2}").match(self.text, self.at)
            if char != "0" and not m[0]:
                raise PatternError(f"back reference \\{char}")
            self.at = m.end()
            return int(char + m[0], 8)
        if not char.isascii() or char.isalnum():
            raise PatternError(f"escape \\{char}")
        return ord(char)

    def property(self, flags: Flags) -> str:
        m = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))").match(self.text, self.at)
        if m is None:
            raise PatternError("escape \\p")
        self.at = m.end()
        name, turned = m[3] or m[4], (m[1] == "P") != bool(m[2])
        if flags.fold:
            raise PatternError(f"{m[0]} without regard to case")
        if name == "Any":
            return "" if turned else r"\x{0}-\x{10FFFF}"
        if name not in CATEGORIES and name not in SCRIPTS:
            raise PatternError(f"property {name}")
        return f"\\{'P' if turned else 'p'}{{{'' if name in CATEGORIES else 'Is'}{name}}}"

    def char_class(self, flags: Flags) -> Node:
        self.at += 1
        negated = self.ahead("^")
        self.at += negated
        ranges: list[tuple[int, int]] = []
        properties: list[str] = []
        first = True
        while first or not self.ahead("]"):
            if self.at >= len(self.text):
                raise PatternError("a class without an end")
            here = self.text[self.at + 1 : self.at + 2]
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if m[2] not in POSIX:
                    raise PatternError(f"class {m[0]}")
                self.at = m.end()
                found = _chars(_pairs(POSIX[m[2]]), False, flags).ranges
                ranges += _complement(found) if m[1] else found
            elif self.ahead("\\") and here and here.lower() in PERL:
                self.at += 2
                found = _chars(_pairs(PERL[here.lower()]), False, flags).ranges
                ranges += _complement(found) if here.isupper() else found
            elif self.ahead("\\") and here in ("p", "P"):
                properties.append(self.property(flags))
            else:
                low = self.escaped() if self.ahead("\\") else ord(self.take())
                high = low
                if self.ahead("-") and not self.text.startswith("-]", self.at):
                    self.at += 1
                    high = self.escaped() if self.ahead("\\") else ord(self.take())
                    if high < low:
                        raise PatternError("a range from high to low")
                ranges += _with_case([(low, high)]) if flags.fold else [(low, high)]
            first = False
        self.at += 1
        return Chars(_merged(ranges), tuple(properties), negated)


def _chars(ranges: list[tuple[int, int]], negated: bool, flags: Flags) -> Chars:
    return Chars(_merged(_with_case(ranges) if flags.fold else ranges), negated=negated)


def _literal(code: int, flags: Flags) -> Chars:
    same = _folds().get(code, (code,)) if flags.fold else (code,)
    return Chars(_merged([(c, c) for c in same]))


def _row(parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else Row(tuple(parts))


def _children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, Row):
        return node.parts
    if isinstance(node, Choice):
        return node.options
    return (node.body,) if isinstance(node, Group | Repeat) else ()


def _weight(node: Node) -> int:
    """How often bounded repetitions multiply what is inside."""
    below = max(map(_weight, _children(node)), default=1)
    return below * max(1, node.most if node.most is not None else node.least) if isinstance(node, Repeat) else below


def _takes_halves(node: Node) -> bool:
    if isinstance(node, Chars):
        return node.negated or bool(node.properties) or any(a <= 0xDFFF and b >= 0xDC00 for a, b in node.ranges)
    return any(map(_takes_halves, _children(node)))


def _repeat(body: Node, least: int, most: int | None, greedy: bool) -> Node:
    if isinstance(body, Place):  # once is as good as often
        least, most = min(least, 1), min(1 if most is None else most, 1)
    if body.nullable and most != 0 and most != 1:
        if not (isinstance(body, Repeat) and body.greedy and greedy and not body.body.nullable and most is None and body.most in (None, 1)):
            raise PatternError("a repetition of what can match nothing")
        body, least = body.body, 0  # (a*)* and (a?)+ are a*
    found = Repeat(body, least, most, greedy)
    if _weight(found) > MOST_REPEATS:
        raise PatternError("too many repetitions")
    return found


def parse(pattern: str) -> tuple[Node, int]:
    """The tree and the number of its groups."""
    parser = Parser(pattern)
    tree = parser.choice(Flags())
    if parser.at < len(pattern):
        raise PatternError("a closing bracket too many")
    return tree, parser.groups


def java_pattern(pattern: str) -> str:
    """The Java pattern that matches, and replaces, what the RE2 one does."""
    tree, _ = parse(pattern)
    # Java also looks for matches between the two halves of a character outside the basic plane.
    start = r"(?![\x{DC00}-\x{DFFF}])" if tree.nullable or _takes_halves(tree) else ""
    if not tree.nullable:
        return start + tree.java()
    # A match of nothing right behind the last match does not count, and nothing else is tried at that place.
    return rf"{start}(?>{tree.java()})(?:(?!\G)|\A)"


def java_replacement(replacement: str, groups: int) -> str:
    r"""``\1`` is a group, ``\0`` the match, ``\\`` a backslash; all else stands for itself."""
    out, at = [], 0
    while at < len(replacement):
        char = replacement[at]
        following = replacement[at + 1 : at + 2]
        if char == "\\" and following and following in "0123456789":
            if int(following) > groups:
                raise PatternError(f"the pattern has no group {following}")
            out.append(f"${following}")
            at += 2
            if at < len(replacement) and replacement[at] in "0123456789":
                out.append("\\")  # else Java would read a longer group number
        elif char == "\\":
            if following != "\\":
                raise PatternError("a single backslash in the replacement")
            out.append("\\\\")
            at += 2
        else:
            out.append("\\$" if char == "$" else char)
            at += 1
    return "".join(out)

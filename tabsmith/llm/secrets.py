r"""Secrets by their assignments: names and literals are read from source and configuration syntax.

A lexer cuts a text into strings, bare words and punctuation. Assignments of all usual forms are read from the
tokens: ``name = "literal"``, ``name: literal`` up to the line's end, ``name := ...``, ``"name" => ...``, typed
declarations, keyword arguments, subscripts, flags, ``<name>literal</name>`` and ``key="name" value="literal"``. A
value may be a concatenation, a call or another name: literals are followed from name to name, to the assignment
that stands before the use (or, without one, the first after it). A literal that reaches a sensitive name is scored
by that name's words and by the literal itself. Three fixed patterns apply beside that, whatever the syntax.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import require

# The base patterns by kind, in the order of spans, and the least length of what counts in them.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a shorter run has no match and hides none
}
NAMED = "named"
KINDS = [*PATTERNS, NAMED]
#: A text has an assign match only if it holds one of these (lower-cased), an access key only with the other.
STEMS, ACCESS_STEM = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), b"AKIA"

#: Weights of the words of a target's name; those of a pair count together.
SENSITIVE = {
    "password": 10, "passwd": 10, "passphrase": 10, "passcode": 9, "pwd": 9, "secret": 9, "credential": 9, "credentials": 9,
    "apikey": 9, "token": 8, "bearer": 8, "auth": 6, "authorization": 6, "dsn": 5, "key": 4, "salt": 4, "signature": 4,
}
PAIRED = {"key": {"api", "access", "private", "secret", "signing", "encryption", "account", "auth", "client", "master", "service", "shared"}}
PAIR_WEIGHT = 9
#: Last words of a name that holds something about a secret, not the secret.
ABOUT = frozenset(
    "count limit max min len length size name id ids type field label file path dir url uri endpoint header prefix suffix regex pattern "
    "policy expiry expires ttl timeout age hint prompt placeholder index mode algorithm version enabled required reset help class column "
    "budget usage rate per error message text title".split())
#: What every sensitive name contains.
NAME_STEMS = (b"pass", b"pwd", b"secret", b"credential", b"token", b"bearer", b"auth", b"dsn", b"key", b"salt", b"signature")
LEAST_LITERAL = 6
#: Least sum of a name's weight and a literal's points.
LEAST_SCORE = 11
NOT_SECRET = re.compile(r"(?i)<.*>|\$\{.*|\{\{.*|%\(.*|\$[A-Z_]+|x{4,}|\*{3,}|\.{3,}|(?:your|my|the|some|insert|enter|replace)[\W_].*|(?:none|null|true|false|undefined|required|optional|example|placeholder|redacted|string|changeme)")
LOOKUP = re.compile(r"(?i)env|getpass|input|prompt|lookup|read|fetch|argv|get$")

# The lexer. Quoted text ends on its line; a quote inside a word is an apostrophe.
LEXER = re.compile(r"""
    (?P<newline>\n)
  | (?P<string>"{3}(?:[^"\\]|\\.|"(?!""))*"{3} | '{3}(?:[^'\\]|\\.|'(?!''))*'{3}
      | "(?:[^"\\\n]|\\.)*" | (?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*' | `(?:[^`\\\n]|\\.)*`)
  | (?P<bare>--?[A-Za-z][\w.-]* | [\w$@%/+][\w$@%/+.~!^*&?#-]*)
  | (?P<op>\\.|:=|\?=|\+=|=>|->|==+|!=|<=|>=|&&|\|\||::|[^\s\w])
""", re.VERBOSE)
ASSIGN = frozenset([":=", "?=", "=>", "=", ":", "+="])
SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(r"(?:\$|--?)?[A-Za-z_][\w.-]*")
OPENING, CLOSING = frozenset("([{"), frozenset(")]}")


class Token(NamedTuple):
    kind: str
    text: str  # of a string: what stands between its quotes
    start: int
    end: int


class Assignment(NamedTuple):
    name: str
    at: int  # number of its token
    literals: list[Token]
    names: list[Token]


def lex(text: str) -> list[Token]:
    found = []
    for m in LEXER.finditer(text):
        start, end = m.span()
        if m.lastgroup == "string":
            width = 3 if m[0][:3] in ('"""', "'''") and end - start >= 6 else 1
            start, end = start + width, end - width
        found.append(Token(m.lastgroup, text[start:end], start, end))
    return found


def _is_op(tokens: list[Token], at: int, *texts: str) -> bool:
    return 0 <= at < len(tokens) and tokens[at].kind == "op" and tokens[at].text in texts


def _is(tokens: list[Token], at: int, *kinds: str) -> bool:
    return 0 <= at < len(tokens) and tokens[at].kind in kinds


def _target(tokens: list[Token], at: int) -> Token | None:
    """What the operator at ``at`` assigns to."""
    before = at - 1
    if _is_op(tokens, before, "]") and _is(tokens, before - 1, "string", "bare") and _is_op(tokens, before - 2, "["):
        return tokens[before - 1]
    if tokens[at].text == "=" and _is(tokens, before, "bare") and _is_op(tokens, before - 1, ":") and _is(tokens, before - 2, "bare"):
        return tokens[before - 2]  # name: type = value
    if _is(tokens, before, "bare", "string") and IDENTIFIER.fullmatch(tokens[before].text):
        return tokens[before]
    return None


def _value(tokens: list[Token], at: int, separator: str) -> tuple[list[Token], list[Token]]:
    """Literals and names of the expression that starts at ``at``."""
    literals, names, bare, depth = [], [], [], 0
    skipped = None  # the depth of a call that looks something up by name
    k = at
    while k < len(tokens):
        token = tokens[k]
        if token.kind == "newline":
            if depth <= 0 and k > at:
                break
            if depth <= 0 and separator != "=":
                break
        elif token.kind == "op":
            if token.text in OPENING:
                if token.text == "{" or token.text == "[" and k == at:
                    return literals, names  # an object or list: its own entries are read by themselves
                called = _is(tokens, k - 1, "bare") and (token.text == "[" or LOOKUP.search(tokens[k - 1].text))
                if called and skipped is None:  # what stands inside is a name
                    skipped = depth
                depth += 1
            elif token.text in CLOSING:
                depth -= 1
                if depth < 0:
                    break
                if skipped is not None and depth <= skipped:
                    skipped = None
            elif token.text in ",;" and depth <= 0 or token.text in ("<", ">") or token.text in ASSIGN:
                break
        elif token.kind == "string" and skipped is None:
            literals.append(token)
        elif token.kind == "bare" and skipped is None:
            bare.append((k, token))
        k += 1
    ended = k >= len(tokens) or tokens[k].kind == "newline" or _is_op(tokens, k, ",", ";", "}", "<")
    if len(bare) == 1 and not literals and bare[0][0] == at == k - 1 and ended:
        names.append(bare[0][1])  # a name, or an unquoted literal: what is assigned nowhere is one
        literals.append(bare[0][1])
    else:
        names += [t for j, t in bare if not _is_op(tokens, j + 1, "(")]
        if len(bare) > 2 and not literals:
            names = []  # prose behind a colon
    return literals, names


def assignments(tokens: list[Token]) -> list[Assignment]:
    found = []
    for at, token in enumerate(tokens):
        if token.kind == "op" and token.text in ASSIGN:
            target = _target(tokens, at)
            if target is not None and (token.text != ":" or not _is_op(tokens, at + 2, "=")):
                found.append(Assignment(target.text, at, *_value(tokens, at + 1, token.text)))
                if target.text.lower() in ("key", "name") and _is(tokens, at + 1, "string") and _is(tokens, at + 2, "bare") \
                        and tokens[at + 2].text.lower() == "value" and _is_op(tokens, at + 3, "=", ":") and _is(tokens, at + 4, "string"):
                    found.append(Assignment(tokens[at + 1].text, at, [tokens[at + 4]], []))  # key="name" value="literal"
        elif token.kind == "bare" and token.text.startswith("--") and _is(tokens, at + 1, "bare", "string") and not tokens[at + 1].text.startswith("-"):
            found.append(Assignment(token.text, at, [tokens[at + 1]], []))
        elif token.kind == "op" and token.text == ">" and _is(tokens, at - 1, "bare") and _is_op(tokens, at - 2, "<") \
                and _is(tokens, at + 1, "bare") and _is_op(tokens, at + 2, "<") and _is(tokens, at + 3, "bare") \
                and tokens[at + 3].text.lstrip("/") == tokens[at - 1].text:
            found.append(Assignment(tokens[at - 1].text, at, [tokens[at + 1]], []))
    return found


def name_weight(name: str) -> int:
    words = [w.lower() for w in SUBWORD.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0
    best = max((SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0)) for w in words), default=0)
    pairs = any(two in PAIRED and one in PAIRED[two] for one, two in zip(words, words[1:], strict=False))
    return max(best, PAIR_WEIGHT if pairs else 0)


def literal_points(text: str, quoted: bool) -> int:
    """How much a literal looks like a secret; below zero if it can't be one."""
    if len(text) < LEAST_LITERAL or NOT_SECRET.fullmatch(text) or len(text.split()) > 1 and len(text) < 20:
        return -LEAST_SCORE
    classes = sum(bool(re.search(c, text)) for c in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    bits = -sum(n * math.log2(n / len(text)) for n in Counter(text).values())
    return (2 if quoted else -1) + classes - 1 + (bits >= 30) + 2 * (bits >= 60) - 3 * (len(text.split()) > 1) - 3 * (classes == 1 and not quoted)


def reaching(found: list[Assignment]) -> Iterator[tuple[Token, int, str]]:
    """Literal, weight and name: each literal with the most sensitive name that it reaches, directly or through others.

    From the most sensitive assignment on, each assignment is visited once.
    """
    places = defaultdict(list)
    for k, a in enumerate(found):
        places[a.name.lstrip("$-")].append(k)

    def source(name: str, of: int) -> int | None:
        known = places.get(name.lstrip("$-"), ())
        at = bisect_left(known, of)
        after = at + (at < len(known) and known[at] == of)
        return known[at - 1] if at else known[after] if after < len(known) else None

    weights = {name: name_weight(name) for name in {a.name for a in found}}
    seen: set[int] = set()
    for first in sorted((k for k, a in enumerate(found) if weights[a.name]), key=lambda k: -weights[found[k].name]):
        todo = [first]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            known = {t.start: source(t.text, at) for t in found[at].names}
            for t in found[at].literals:
                if known.get(t.start) is None:
                    yield t, weights[found[first].name], found[first].name
            todo += [k for k in known.values() if k is not None]


def named_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """start, end, score, name: literals that reach a sensitive name."""
    folded = text.encode().lower()
    if not any(s in folded for s in NAME_STEMS):
        return []
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for t, weight, name in reaching(assignments(lex(text))):
        score = weight + literal_points(t.text, t.kind == "string")
        if score >= LEAST_SCORE and score > best.get((t.start, t.end), (0, ""))[0]:
            best[t.start, t.end] = score, name
    return [(s, e, *best[s, e]) for s, e in sorted(best)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind: matches of the base patterns, by start and then kind."""
    folded, found = text.encode(), []
    lowered = folded.lower()
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "assign" and not any(s in lowered for s in STEMS) or kind == "access" and ACCESS_STEM not in folded:
            continue
        found += [(*m.span(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def spans(text: str | None) -> list[tuple[int, int, str, str | None, int | None]]:
    """start, end, kind, name, score: the base spans, and named literals that no assign span holds already."""
    text = text or ""
    base = base_spans(text)
    held = [(s, e) for s, e, kind in base if kind == "assign"]
    more = [(s, e, NAMED, name, score) for s, e, score, name in named_secrets(text) if not any(a <= s and e <= b for a, b in held)]
    return sorted([(*b, None, None) for b in base] + more, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found (kind, start, end, name, score; code points, end exclusive): of every row's whole text.

    A null or empty text has none; ids may be null, and repeated rows are searched alike. An empty table gives an
    empty one. Columns but ``doc_id`` and ``text`` are ignored.
    """
    require(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "name": n, "score": p} for s, e, k, n, p in spans(text)]
                     for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "found": pa.array(found, pa.list_(item))})

    schema = f"doc_id {kind}, found array<struct<kind: string, start: long, end: long, name: string, score: int>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, all spans as text."""

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("found", lambda f: f["kind"] != NAMED)
    kinds = F.col("found.kind")
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))



"""RE2 patterns against DuckDB, which has RE2 itself."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.patterns import MOST_REPEATS, PatternError, java_pattern, java_replacement, parse
from tabsmith.functions.text import regex_replace_all

SUBJECTS = [
    "", "a", "baac", "É é x", "a\n", "a\nb\n\nc", "ſkK S", "Straße ẞ", "aXb_1 2", "x-y]z", "日本 go", "ΑΒΓ αβγ ς", "tab\tv\x0bend\r\n", "a.b*c", "aaaa", "abab", "\U0001d400\U0001f600a", "İı",
]
ATOMS = ["a", "b", "c", "é", "É", "k", "s", "S", "ß", "σ", "x", "日", " ", ".", r"\.", r"\d", r"\w", r"\W", r"\s", r"\S", r"\D", "[ab]", "[^a]", "[a-c]", "[^a-c\\s]", "[[:alpha:]]",
         "[[:^space:]x]", "[[:punct:]]", "[k-s]", "[^k]", r"[\w-]", "[]a]", "[^]]", r"\x41", r"\x{e9}", r"\101", r"\Qa.b\E", "^", "$", r"\b", r"\A", r"\z", r"[\d_]", "[é-ü]", "{", "}", "a{", "_",
         r"\_", r"[\n]", r"\t", r"\v", "[-a]", "[a-]"]
PROPERTIES = [r"\pL", r"\p{Lu}", r"\P{L}", r"\p{Greek}", r"\p{^Han}", r"[\p{Nd}a]", r"[^\pL]", r"\pZ", r"\p{Any}"]
REPEATS = ["*", "+", "?", "*?", "+?", "??", "{2}", "{1,2}", "{0,}", "{2,}?", "{,2}", "{0}"]


def made(rng, depth=0):
    """A random pattern; not all are valid."""
    parts = []
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3]) if depth else rng.choice([1, 2, 3])):
        kind = rng.random()
        if kind < 0.55 or depth > 2:
            part = rng.choice(ATOMS if rng.random() < 0.9 else PROPERTIES)
        elif kind < 0.75:
            part = rng.choice(["(", "(?:", "(?i:", "(?s:", "(?U:", "(?P<n>", "(?m:", "(?-i:"]) + made(rng, depth + 1) + ")"
        elif kind < 0.9:
            part = "(?:" + made(rng, depth + 1) + "|" + made(rng, depth + 1) + ")"
        else:
            part = rng.choice(["(?i)", "(?m)", "(?s)", "(?U)", "(?i-s)", "|", "(?im)"])
        parts.append(part + (rng.choice(REPEATS) if rng.random() < 0.35 else ""))
    return "".join(parts)


def by_duckdb(con, pattern, replacement):
    try:
        return [con.execute("SELECT regexp_replace(?, ?, ?, 'g')", [s, pattern, replacement]).fetchone()[0] for s in SUBJECTS]
    except duckdb.Error:
        return None


def by_spark(spark, jobs):
    """Results of many replacements from one pass."""
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(SUBJECTS)], "k int, s string")
    found = rows.select("k", *[regex_replace_all(F.col("s"), p, r).alias(f"r{i}") for i, (p, r) in enumerate(jobs)]).orderBy("k").collect()
    return [[row[f"r{i}"] for row in found] for i in range(len(jobs))]


@pytest.mark.parametrize("seed", range(6))
def test_random_patterns(spark, seed):
    rng, con = random.Random(seed), duckdb.connect()
    jobs, wants, refused, both = [], [], 0, 0
    for _ in range(120):
        pattern = made(rng)
        replacement = rng.choice(["x", "", "<\\0>", "$1-", "\\\\"])
        want = by_duckdb(con, pattern, replacement)
        try:
            java_pattern(pattern)
        except PatternError:
            refused += want is not None
            both += want is None
            continue
        assert want is not None, f"{pattern!r} is not RE2"
        jobs.append((pattern, replacement))
        wants.append(want)
    for job, got, want in zip(jobs, by_spark(spark, jobs), wants, strict=True):
        assert got == want, job
    assert refused <= len(jobs) / 4  # repetitions of what can match nothing, most of them


@pytest.mark.parametrize("pattern, subject, want", [
    ("a*", "baac", "xbxcx"), ("(?i)é", "É", "x"), ("(?i)s", "ſk", "xk"), ("(?m)^", "a\n", "xa\nx"), (r"\b", "é x", "é xxx"), (r"\p{Greek}+", "ab αβ", "ab x"),
    ("(?i)k", "Kk", "xx"), ("(?i)[^k]", "Kka", "Kkx"), ("|a", "ab", "xaxbx"), ("(?U)a+", "aa", "xx"), ("a$", "a\n", "a\n"), (r"\s", "\x0b", "\x0b"),
])
def test_known_differences(spark, pattern, subject, want):
    rows = spark.createDataFrame([(subject,)], "s string")
    assert rows.select(regex_replace_all(F.col("s"), pattern, "x")).first()[0] == want
    assert duckdb.execute("SELECT regexp_replace(?, ?, 'x', 'g')", [subject, pattern]).fetchone()[0] == want


@pytest.mark.parametrize("pattern", [
    "(?=a)", "(?<!a)b", "(?>a)", "a++", "a**", "a{2}{3}", r"(a)\1", r"\Z", r"\C", r"\B", r"\G", "[a", "[z-a]", "(a", "a)", "*a", "(?P<n>a)(?P<n>b)", "(?P=n)", "[[:no:]]", r"\p{No_Such}",
    r"\p{IsGreek}", f"a{{{MOST_REPEATS + 1}}}", "(?:a{200}){200}", "(?x)a", "\\", r"\x{110000}", "(?i)\\p{Lu}", "(?)", r"\8", "(" * 500 + ")" * 500,
])
def test_what_is_refused(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_replacements():
    assert parse("(a)(?:b)(?P<x>c)")[1] == 2
    assert java_replacement(r"\10\\$", 1) == "$1\\0\\\\\\$"
    for wrong in (r"\2", "\\", r"\q"):
        with pytest.raises(PatternError):
            java_replacement(wrong, 1)

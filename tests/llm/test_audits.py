"""Secrets, phrases and divergence of sources against plain versions."""
import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsmith.llm import divergence, phrases, secrets
from tabsmith.llm.oracles import ORACLES

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", "  \n ", "x", ".;:!?", "ÉCOLE école Ecole", "\x00\x01 a\tb", "word " * 5000, "A. b. A. b"]


def table(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS)


def by_duckdb(df, name):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return sorted(map(repr, con.execute(ORACLES[name]).fetchall()))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


# secrets ------------------------------------------------------------------------------------------------------------
def held(text):
    return [(kind, text[s:e], name) for s, e, kind, name, _ in secrets.spans(text)]


@pytest.mark.parametrize("text, want", [
    ('const A = "s3cr3t-Val";\nconst dbPassword = A + "9x";', "s3cr3t-Val"),
    ('"apiKey" => "Zx81kk29aa",', "Zx81kk29aa"),
    ("config['client_secret'] = 'aB3dE5fG7h'", "aB3dE5fG7h"),
    ("connect(user, pwd='p4ssw0rd!')", "p4ssw0rd!"),
    ("run --password Sup3rS3cret", "Sup3rS3cret"),
    ("<dbPassword>q1w2e3r4t5</dbPassword>", "q1w2e3r4t5"),
    ('<add key="AuthToken" value="tok3n-value-9"/>', "tok3n-value-9"),
    ('x: str = "abcDEF123!"\nprivate_key: str = x', "abcDEF123!"),
    ('a = b\nb = c\nc = "Zz99xx88yy"\nsecret_key = a', "Zz99xx88yy"),
    ("export DB_PASS=abc123DEF\nPASSWORD=$DB_PASS", "abc123DEF"),
    ("pwd := `ab12cd34`", "ab12cd34"),
    ('signing_key = wrap("ab12" + "cd34EF!")', "cd34EF!"),
])
def test_literals_reach_their_names(text, want):
    assert want in [t for kind, t, _ in held(text) if kind == "named"]


@pytest.mark.parametrize("text", [
    "max_tokens = 4096\ntoken_count: \"abcdef12\"", 'api_key = ${API_KEY}', 'pwd = os.environ["DB_PWD_X1"]', 'pwd = getenv("DB_PWD_X1")',
    "a key: to the door of it", "title = 'Quarterly1 report!'", "don't say it's the key 'cause", "pwd = pwd\npwd = pwd", "auth: none", 'key = "<your key here>"',
    "", "=", "pwd =", "= 'abc123!x'",
])
def test_clean_text_has_no_named_literal(text):
    assert [t for kind, t, _ in held(text) if kind == "named"] == []


def plain_base(text):
    found = []
    for at, kind in enumerate(("assign", "access", "hex")):
        pattern = {"assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                   "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}[kind]
        least = {"assign": 6, "access": 20, "hex": 24}[kind]
        found += [(m.start(), at, kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


PIECES = st.sampled_from(["token = ", "PassWord:", "secret", "api_key='", "apikey", "ſecret = abcdefg", "toKen=x ", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "ab12",
                          " ", "\n", '"', "'", "=", ":", "é日", "(", ")", "{", "x", "\\", "--pwd ", "<key>", "</key>", '"""', "`", ",", "Zx81kk29aa"])


@given(st.lists(PIECES, max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(text):
    found = secrets.spans(text)
    assert [f"{k}:{s}:{e}" for s, e, k, *_ in found if k != "named"] == plain_base(text)
    assert all(text[s:e] and 0 <= s < e <= len(text) for s, e, *_ in found)


def plain_reach(found):
    """Literal starts by the best weight: the closure of each sensitive assignment, one by one."""
    best = {}
    for k, a in enumerate(found):
        weight = secrets.name_weight(a.name)
        todo, seen = [k], set()
        while todo and weight:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for t in [*found[at].names, *found[at].literals]:
                other = [j for j, b in enumerate(found) if j != at and b.name.lstrip("$-") == t.text.lstrip("$-")] if t in found[at].names else []
                before = [j for j in other if j < at]
                if other:
                    todo.append(before[-1] if before else other[0])
                elif t in found[at].literals:
                    best[t.start] = max(best.get(t.start, 0), weight)
    return best


NAMES = st.sampled_from(["a", "b", "c", "password", "token", "salt"])
VALUES = st.one_of(NAMES, st.sampled_from(['"lit1"', "'lit2'", '"z" + a', "b + c"]))


@given(st.lists(st.tuples(NAMES, VALUES), max_size=10))
@settings(max_examples=200, deadline=None)
def test_propagation_against_the_closure(lines):
    found = secrets.assignments(secrets.lex("\n".join(f"{n} = {v}" for n, v in lines)))
    got = collections.defaultdict(int)
    for t, weight, _ in secrets.reaching(found):
        got[t.start] = max(got[t.start], weight)
    assert dict(got) == plain_reach(found)


def test_long_texts_take_linear_time():
    for part in ("token = token\n", 'x = ("', '\\"', "a = (", "'''", "pwd: {[", "token="):
        secrets.spans(part * 40_000)


def test_secret_query_rows(spark):
    texts = [*ODD, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é', 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é', 'é k = "Ab1!xyz"\npwd = k']
    docs = table(spark, [(t, None, None) for t in texts]).withColumns({"found": F.lit(1), "spans": F.lit("s")})
    docs = docs.unionByName(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["doc_id"]: r for r in secrets.report(secrets.find_secrets(docs)).collect()}
    assert len(got) == len(texts) + 1
    assert got[9]["spans"] == got[None]["spans"] == "assign:0:49,hex:9:49"
    assert (got[9]["n_assign"], got[9]["n_access"], got[9]["n_hex"]) == (1, 0, 1)
    assert got[9]["base_sha256"] == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest()
    assert got[11]["spans"] == "named:7:14" and got[11]["base_sha256"] == got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.report(secrets.find_secrets(docs.limit(0))).count() == 0


# phrases ------------------------------------------------------------------------------------------------------------
def plain_phrases(rows, max_words, least, covered, top):
    n, f = collections.Counter(), collections.Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in range(1, max_words + 1):
                f.update(("und" if lang is None else lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = [b for (other, q), b in f.items() if other == lang and b >= least and len(q) > len(p)
                  and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= covered * a for b in longer):
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(repr((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)) for lang, rest in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rest)[:top]))


def babble(seed, n):
    rng = np.random.default_rng(seed)
    words = rng.choice(["the", "The", "of", "sea", "é", "日本", "zz", "a.b", "x,", "end.\n", "\t"], n, p=[.2, .1, .2, .1, .1, .05, .05, .05, .05, .05, .05])
    return " ".join(words)


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_phrases_against_a_plain_version(spark, max_words, monkeypatch):
    monkeypatch.setattr(phrases, "COMMON", 20)  # some words with a code, some hot, some spelled
    monkeypatch.setattr(phrases, "HOT", 8)
    rows = [(t, lang, None) for lang in ("en", None, "de", "") for t in ODD] + [(babble(k, 60), "en" if k % 3 else "de", "s") for k in range(40)]
    rows += [rows[-1]] * 12
    for least, covered, top in ((3, 50, 2000), (5, 80, 7)):
        got = phrases.collocations(table(spark, rows).withColumn("n", F.lit(1)), max_words=max_words, least=least, covered=covered, top=top)
        assert rows_of(got) == plain_phrases(rows, max_words, least, covered, top)


def test_phrases_of_flushed_streams(spark, monkeypatch):
    rows = [(babble(k, 200), "en", None) for k in range(8)]
    want = plain_phrases(rows, 3, 2, 50, 100)
    got = phrases.windows(table(spark, rows).coalesce(1), "lang", spark.sparkContext.broadcast({}))

    def sums(rows):
        return sorted(map(repr, rows.groupBy("lang", "w1", "w2", "last").agg(F.sum("n")).collect()))

    whole = sums(got)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 37)
    split = phrases.windows(table(spark, rows).coalesce(1), "lang", spark.sparkContext.broadcast({}))
    assert sums(split) == whole
    assert rows_of(phrases.collocations(table(spark, rows), least=2, top=100)) == want


def test_phrases_of_rare_words_are_not_dealt(spark):
    rows = [(f"the sea of the sea a{k} b{k} of the c{k}", "en", None) for k in range(50)] + [("the sea x x", "de", None)]
    docs = table(spark, rows)
    single = phrases.word_counts(docs, "lang").filter("n >= 10")
    common = spark.sparkContext.broadcast(phrases.numbered(single, 2))
    assert common.value == {b"the": 1}  # two words have 100 occurrences or more but fewer than 128, one has more
    kept = spark.sparkContext.broadcast(phrases.marks(single))
    few = phrases.windows(docs.coalesce(1), "lang", common, kept=kept)
    every = phrases.windows(docs.coalesce(1), "lang", common)
    assert every.count() > 400
    assert sorted(map(repr, map(tuple, few.collect()))) == sorted(map(repr, {
        ("en", None, "the", "sea", None, 100), ("en", None, "sea", "of", None, 50), ("en", None, "of", "the", None, 100),
        ("en", None, "the", "sea", "of", 50), ("en", None, "sea", "of", "the", 50), ("en", None, "of", "the", "sea", 50),
    }))
    assert rows_of(phrases.frequent(few, common)) == rows_of(phrases.frequent(every, common))


def test_phrases_of_numbered_words_are_numbers(spark):
    docs = table(spark, [(babble(k, 200), "en", None) for k in range(8)])
    spelled, numbers = spark.sparkContext.broadcast({}), phrases.numbered(phrases.word_counts(docs, "lang"), 1000)
    assert list(numbers.values()) == list(range(1, len(numbers) + 1)) and b"the" in list(numbers)[:2]
    numbers = spark.sparkContext.broadcast(numbers)
    by_number, by_word = phrases.windows(docs, "lang", numbers), phrases.windows(docs, "lang", spelled)
    assert by_number.filter("number is null or w1 is not null or last is not null").count() == 0
    assert by_word.filter("number is not null or w1 is null").count() == 0
    got = rows_of(phrases.frequent(by_number, numbers, least=2))
    assert got and got == rows_of(phrases.frequent(by_word, spelled, least=2))


@pytest.mark.parametrize("most", [0, 1, 3, 6, 7, 100])
def test_numbered_words_are_bounded(spark, most):
    counts = spark.createDataFrame([("en", w, n) for w, n in (("a", 5), ("b", 4), ("c", 9), ("d", 1), ("e", 2), ("f", 3))] + [("de", "a", 3)], "lang string, word string, n long")
    got = phrases.numbered(counts, most)
    assert len(got) <= most and list(got) == [b"c", b"a", b"b", b"f", b"e", b"d"][: {0: 0, 1: 0, 3: 3, 6: 6, 7: 6, 100: 6}[most]]


def test_windows_too_many_for_one_number():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 6, 500)
    packed = phrases.distinct_windows(ids, 480, 6, 3)
    wide = phrases.distinct_windows(ids, 480, 1 << 22, 3)
    assert all((x == y).all() for x, y in zip(packed, wide)) and packed[1].sum() == (ids[:480] != 0).sum()
    for size in (2, 3):
        want = collections.Counter()
        for row, n in zip(packed[0].tolist(), packed[1].tolist()):
            if row[size - 1]:
                want[tuple(row[:size])] += n
        rows, n = phrases.leading(*packed, size)
        assert {tuple(r[:size]): c for r, c in zip(rows.tolist(), n.tolist())} == want and not rows[:, size:].any()


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, [("a b", "en", None)]).limit(0)).count() == 0
    assert phrases.collocations(table(spark, [(None, None, None)] * 12)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(table(spark, [("a b", "en", None)]), max_words=1)


def test_phrases_by_sql(spark):
    docs = table(spark, [(babble(k, 300), "en" if k % 3 else None, "s") for k in range(30)])
    assert rows_of(phrases.collocations(docs)) == by_duckdb(docs, "op12_phrases")


# divergence of sources ----------------------------------------------------------------------------------------------
@given(st.integers(1, 5), st.integers(1, 40), st.integers(0, 3), st.data())
@settings(max_examples=60, deadline=None)
def test_trees_price_like_the_plain_sum(n, terms, most, data):
    counts = np.array([[data.draw(st.integers(0, most)) for _ in range(terms)] for _ in range(n)])
    wholes = [int(c.sum()) + 2 * terms for c in counts]
    every = np.arange(n)
    got = {(i, int(j)): int(v) for i, others, total in divergence.block_prices(counts, wholes, every, every) for j, v in zip(others, total)}
    p = [[1 + 10**9 * (int(c) + 2) // w for c in row] for row, w in zip(counts, wholes)]
    want = {(i, j): sum((x - y) ** 2 // (x + y) for x, y in zip(p[i], p[j])) for i in range(n) for j in range(i + 1, n)}
    assert got == want


def test_equal_subtrees_are_one_node():
    leaves = np.array([[0, 1, 0, 1, 0, 0, 0, 0], [0, 1, 0, 1, 0, 1, 0, 1]])
    roots, levels = divergence.consed(leaves)
    assert [len(left) for left, _ in levels] == [2, 2, 2] and len(set(roots.tolist())) == 2
    _, a, b, times = divergence.met_leaves(int(roots[0]), roots[1:], levels)
    assert times.sum() == 8 and len(a) == 3  # (0, 0), (1, 1) and, twice, (0, 1): each pair of leaves once


@pytest.mark.parametrize("block, tile", [(divergence.BLOCK, divergence.TILE), (3, 2)])
def test_divergence_against_sql(spark, block, tile):
    rows = [(t, lang, s) for t in ODD for lang, s in (("en", "a"), (None, None), ("", "b"))]
    rows += [(babble(k, 40), "en" if k % 4 else "de", "abcdefg"[k % 7]) for k in range(80)] + [("é only here", "fr", "x"), ("", "fr", "y")]
    rows += [("big big big", "en", "a")] * 15
    docs = table(spark, rows).withColumns({"term": F.lit(1), "n": F.lit("n"), "block": F.lit(0)})
    got = divergence.divergence(docs, block=block, tile=tile)
    assert rows_of(got) == by_duckdb(docs.select("doc_id", "text", "lang", "source"), "op13_divergence")
    assert {r["value"] for r in got.filter("lang = 'fr'").collect()} == {0}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(table(spark, [("a", "en", "x")]).limit(0)).count() == 0
    assert divergence.divergence(table(spark, [(None, None, None)] * 3)).count() == 0

"""Token counts, lattice scores, packing, SimHash, line dedup, decontamination and rules against plain versions."""
import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsmith.llm import decontaminate, lattice, lines, packing, rules, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone cloud amber quiet market window seven garden north music paper light glass".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) if n else ""


def table(spark, texts, **more):
    rows = [(k, t, "en", "a" if k % 3 else "b", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


ODD = [None, "", "   ", "x", "a  b\n\n c \t", "Größe ß é 日本語 <|endoftext|> end", "word " * 3000, prose(1, 40), prose(1, 40)]


# tokens -------------------------------------------------------------------------------------------------------------
def test_ids_are_those_of_the_tokenizer_file():
    bpe = tokens.encoder(tokens.vocabulary_path())
    for text in ODD:
        want = bpe.whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bpe.ids(text), np.uint32).tolist() == want


@given(st.lists(st.integers(1, 6), min_size=1, max_size=12), st.data())
@settings(max_examples=60, deadline=None)
def test_attribution_by_every_rule(sizes, data):
    ends = np.cumsum(sizes)
    cuts = sorted(data.draw(st.sets(st.integers(1, int(ends[-1])), max_size=5)) | {int(ends[-1])})
    spans = np.array(list(zip([0, *cuts[:-1]], cuts)))
    starts = np.append(0, ends[:-1])
    for rule in tokens.RULES:
        counts, crosses, share = tokens.attribute(ends, spans, rule)
        want = np.zeros(len(spans), int)
        parts = np.zeros(len(spans))
        for a, b in zip(starts, ends):
            over = [max(0, min(b, y) - max(a, x)) for x, y in spans]
            parts += np.array(over) / (b - a)
            want[int(np.argmax(over)) if rule == "majority" else next(i for i, o in enumerate(over) if o)] += 1
        assert counts.tolist() == want.tolist()
        assert np.allclose(share, parts)


def test_section_counts(spark):
    rows = tokens.section_tokens(table(spark, ODD, section="clash")).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(range(len(ODD)))
    for k, text in enumerate(ODD):
        own = sorted(by_doc[k], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]
        assert [(text or "")[r["start"]:r["end"]] for r in own] == ((text or "").splitlines(keepends=True) or [""])
    assert tokens.section_tokens(table(spark, [])).count() == 0
    assert tokens.section_tokens(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()["doc_id"] is None


# packing ------------------------------------------------------------------------------------------------------------
@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=60, deadline=None)
def test_local_search_keeps_pieces_and_never_adds_bins(sizes):
    lengths = np.array(sorted(sizes, reverse=True), int)
    first = packing.best_fit(lengths, 30)
    n = len(first)
    bins = packing.local_search(first, lengths, 30)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes)))
    assert all(lengths[b].sum() <= 30 for b in bins) and -(-lengths.sum() // 30) <= len(bins) <= n


def test_local_search_uses_each_kind_of_trade():
    for sizes, start, most in (
        ([6, 5, 4, 3, 2], [[0, 2], [1, 3, 4]], 2), ([7, 6, 4, 3], [[0], [1, 3], [2]], 2), ([6, 5, 5, 2, 2], [[0, 3], [1, 4], [2]], 2),
    ):
        lengths = np.array(sizes)
        assert len(packing.local_search([list(b) for b in start], lengths, 10)) <= most


def test_packed_documents(spark):
    docs = table(spark, ODD + [prose(k, 900) for k in range(30)], offset="clash", sequence_id=1)
    pieces = packing.token_pieces(docs, with_ids=True)
    packed = packing.pack(pieces, block_pieces=8)
    rows = packed.collect()
    bpe = tokens.encoder(tokens.vocabulary_path())
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for k, text in enumerate(t["text"] for t in docs.orderBy("doc_id").collect()):
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        ids = np.frombuffer(bpe.ids(text), np.uint32).tolist() + [0]
        assert list(itertools.chain(*(r["ids"] for r in own))) == ids
        assert all(r["length"] == 2048 for r in own[1:]) and own[0]["start"] == 0
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(spans[-1]) <= 2048
    assert {len(r["ids"]) for r in packing.sequences(packed).collect()} <= set(range(1, 2049))
    assert packing.pack(packing.token_pieces(table(spark, []))).count() == 0


# lattice ------------------------------------------------------------------------------------------------------------
def spellings(index, word):
    """Every segmentation of a word, by brute force."""
    if not word:
        yield []
    for m in range(1, len(word) + 1):
        if (k := index.get(word[:m])) is not None:
            yield from ([k, *rest] for rest in spellings(index, word[m:]))


def test_word_scores_sum_over_all_segmentations():
    pieces = lattice.pieces_of(tokens.vocabulary_path())
    rng = np.random.default_rng(0)
    scores = pieces.scores(dict(enumerate(rng.random(len(pieces.ids)) * 9)), 50)
    assert math.isclose(np.exp(scores).sum(), 1)
    words = [b"a", b"the", b"stone", "größe".encode(), b"x" * 7, b"."]
    got = lattice.word_scores(pieces, scores[None, :], words)[0]
    for w, value in zip(words, got):
        want = sum(math.exp(sum(scores[k] for k in s)) for s in spellings(pieces.index, b" " + w)) * math.exp(scores[-1])
        assert math.isclose(value, math.log(want), rel_tol=1e-9)
        assert math.isclose(value, lattice.long_word(pieces, scores, w), rel_tol=1e-9)
    uses = lattice.expected_counts(pieces, scores, [b"stone"])
    want = collections.Counter()
    total = sum(math.exp(sum(scores[k] for k in s)) for s in spellings(pieces.index, b" stone"))
    for s in spellings(pieces.index, b" stone"):
        for k in s:
            want[k] += math.exp(sum(scores[k] for k in s)) / total
    assert all(math.isclose(uses[k], n, rel_tol=1e-9) for k, n in want.items()) and math.isclose(uses.sum(), sum(want.values()))


def test_long_words_take_part_in_expected_counts(monkeypatch):
    pieces = lattice.pieces_of(tokens.vocabulary_path())
    scores = pieces.scores(dict(enumerate(np.random.default_rng(1).random(len(pieces.ids)) * 9)), 50)
    words = ["日本語と文章の".encode() * 9, b"stonecloudmarket" * 12, b"stone"]
    assert sum(len(w) >= lattice.LONG for w in words) == 2
    got = lattice.expected_counts(pieces, scores, words)
    monkeypatch.setattr(lattice, "LONG", 1000)  # all in the batch form
    assert np.allclose(got, lattice.expected_counts(pieces, scores, words), rtol=1e-9, atol=1e-12)
    spelled = sum(n * len(pieces.by_id[i]) for n, i in zip(got, pieces.ids))
    assert math.isclose(spelled, sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_base_scores_and_counts(spark):
    texts = ODD + [prose(k, 30) for k in range(40)] + ["unseen-word and river"]
    docs = table(spark, texts, score=1, row="clash").withColumn("held_out", (F.col("doc_id") % 5 == 2) | (F.col("doc_id") == len(texts) - 1))
    for common in (1 << 17, 1):  # all words common, and none
        rows = lattice.score_documents(docs, component="source", em_rounds=1, common=common).collect()
        words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in enumerate(texts)}
        held = {r["doc_id"]: r["held_out"] for r in rows}
        counts = collections.Counter(w for k in words if not held[k] for w in [*words[k], None])
        n, v = sum(counts.values()), len(counts)
        assert len(rows) == len(texts)
        for r in rows:
            own = [*words[r["doc_id"]], None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
            assert r["score"] < 0
    assert lattice.score_documents(docs.limit(0)).count() == 0
    alone = lattice.score_documents(docs.limit(3).withColumn("held_out", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


# simhash ------------------------------------------------------------------------------------------------------------
def plain_print(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ODD + [prose(5, 200), "A b", "a B c"]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_print(text)


@pytest.mark.parametrize("bucket", [2048, 6])
def test_links_connect_all_that_are_close(spark, bucket):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(-2**63, 2**63, 60).tolist())
    for seed in list(fps)[:6]:  # chains and clusters around some of them
        for _ in range(14):
            flips = sum(1 << int(b) for b in rng.choice(64, 3))
            fps.add(int(np.array([(seed % 2**64) ^ flips], np.uint64).view(np.int64)[0]))
            seed = seed if rng.random() < 0.5 else list(fps)[-1]
    fps = sorted(fps)
    unsigned = np.array(fps, np.int64).view(np.uint64)
    group = {f: f for f in fps}
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3
    for i, j in np.argwhere(near):
        a, b = group[fps[i]], group[fps[j]]
        group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {f: roots.get(f, f) for f in fps} == group


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k + 1, k) for k in range(40)] + [(k, 100) for k in range(101, 140)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}


def test_near_duplicates_and_one_of_each_group(spark):
    texts = [prose(1, 300), prose(2, 300), prose(1, 300) + " tail", None, "", prose(2, 300).upper()]
    docs = table(spark, texts, _print="x", fp=5)
    docs = docs.unionByName(docs.filter("doc_id = 0"))
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    close = bin(plain_print(texts[0]) ^ plain_print(texts[2])).count("1") <= 3
    assert found == {(0, 0), (1, 1), (2, 0 if close else 2), (3, 3), (4, 3), (5, 1)}
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1] + [2] * (not close) + [3]
    assert simhash.one_per_group(docs.limit(0)).count() == 0


# lines --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_site_lines_against_plain_counts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    texts = [f"{prose(k, 6)}\nFooter of all\n\n{prose(k % 2, 3)}\n Footer of all " for k in range(12)] + [None, "", "Footer of all"]
    docs = table(spark, texts, n_lines=9, _host="h").withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    rows = {r["doc_id"]: r for r in docs.collect()}
    pages = collections.defaultdict(collections.Counter)
    totals = collections.Counter(r["source"] for r in rows.values())
    for r in rows.values():
        pages[r["source"]].update({x.strip() for x in (r["text"] or "").split("\n")} - {""})
    found = lines.drop_boilerplate(docs, ratio=0.3, least_pages=2).collect()
    assert len(found) == len(texts)
    for r in found:
        host = rows[r["doc_id"]]["source"]
        text = texts[r["doc_id"]]
        drop = {x for x, n in pages[host].items() if n >= 2 and n > 0.3 * totals[host]}
        want = None if text is None else "\n".join(x for x in text.split("\n") if x.strip() not in drop)
        assert r["text"] == want and (want is None or r["n_chars"] == len(want))
    assert lines.without_boilerplate(docs).columns == docs.columns
    assert {r["_host"] for r in lines.without_boilerplate(docs).collect()} == {"h"}
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


# decontamination ----------------------------------------------------------------------------------------------------
def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, window=10):
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        own = fold(body)
        size = min(window, len(own))
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@given(st.lists(st.text("abc ", max_size=30), max_size=5), st.text("abcd ,.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_automaton_against_all_windows(items, text):
    named = [(str(k), t) for k, t in enumerate(items)]
    hit, found = decontaminate.SuffixAutomaton(named, 3).scan(decontaminate.words(text))
    assert (len(hit), int(hit.sum()), sorted(found)) == plain_hits(text, named, 3)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_contamination(spark, block_words):
    items = [(1, prose(100, 25)), (22, prose(101, 4)), (3, None), (4, "--"), (1, prose(100, 25)), (5, prose(100, 25).title())]
    texts = ODD + [prose(9, 20) + ". " + prose(100, 25)[:90].upper() + "; " + prose(8, 90), "é " + prose(101, 4), prose(7, 200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts, item_ids="clash")
    rows = {r["doc_id"]: r for r in decontaminate.report(decontaminate.find_contamination(docs, bench, block_words=block_words)).collect()}
    plain = [i for i in items if i[1] is not None]
    for k, text in enumerate(texts):
        n, hit, found = plain_hits(text, plain)
        r = rows[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = decontaminate.decontaminate(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    kept = {r["doc_id"]: r for r in kept.collect()}
    for k, text in enumerate(texts):
        n, hit, _ = plain_hits(text, plain)
        assert (k in kept) == (hit <= n * decontaminate.COVERAGE)
        if k in kept:
            assert plain_hits(kept[k]["text"], plain)[1] == 0 and (hit or kept[k]["text"] == text)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("size(hit_ranges) > 0").count() == 0


def test_items_of_several_blocks_cut_like_those_of_one(spark):
    """Items that overlap in a document, and one that comes about by cutting the others, dealt to blocks by hash."""
    w = [f"q{i}" for i in range(60)]
    items = [(k, " ".join(w[a:b])) for k, (a, b) in enumerate([(0, 20), (9, 29), (18, 38)])]
    items += [(50 + k, " ".join(f"z{k}x{i}" for i in range(12))) for k in range(12)]
    spliced = [f"l{i}" for i in range(6)] + [f"r{i}" for i in range(6)]
    items.append((90, " ".join(spliced)))
    text = " ".join(["start", *[f"a{i}" for i in range(60)], *spliced[:6], *w[:38], *spliced[6:], "end"])
    docs, bench = table(spark, [text, prose(1, 50), None]), spark.createDataFrame(items, "item_id long, text string")
    found = [
        {r["doc_id"]: r.asDict(recursive=True) for r in decontaminate.find_contamination(docs, bench, block_words=n).collect()}
        for n in (200_000, 140)
    ]
    blocks = list(decontaminate.item_blocks(bench, "item_id", 140))
    assert len(blocks) > 2 and not any({"0", "1", "2"} <= {i for i, _ in b} for b in blocks)
    assert found[0] == found[1]
    assert found[0][0]["hit_ranges"] == [{"start": 67, "end": 105}]
    assert fold(found[0][0]["clean_text"]) == ["start", *[f"a{i}" for i in range(60)], "end"]


# rules --------------------------------------------------------------------------------------------------------------
def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(hit)


def test_measures_against_plain_ones(spark):
    texts = ODD + ["a b c a b c", "a a a a a", "x\nx\n\n \n\ny\nx", "#%& $ 日本 <b>", prose(3, 120), "a b c d a b c"]
    rows = rules.judge(table(spark, texts, kept="clash", N_WORDS=1)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_measures(texts[r["doc_id"]])
        assert tuple(r[m] for m in rules.MEASURES[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_rules_keep_usual_texts_and_drop_odd_ones(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_GROUPS", broadcast)
    usual = [" ".join(f"w{k}x{i}" for i in range(60 + k % 7)) for k in range(300)]
    odd = [" ".join(f"w{i}###" for i in range(80)), " ".join(f"w{i}" + "y" * 40 for i in range(80))]
    docs = table(spark, usual + odd)
    kept = rules.passing(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(300))
    assert rules.passing(docs.limit(0)).count() == 0
    nulls = rules.judge(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    assert nulls.filter("kept").count() == 300


def test_limits_follow_their_group_and_each_rule_rejects(spark):
    """Source b's documents repeat lines as a habit, source a's don't: the same document passes in b and goes in a."""
    def lines(k, n, again):
        own = [" ".join(f"w{k}x{i}y{j}" for j in range(9)) for i in range(n - again)]
        return "\n".join(own + [" ".join(f"short{k}" for _ in range(1))] * (again + 1))

    clean = [(f"{k}", lines(k, 12, 0), "a") for k in range(300)] + [(f"{k}", lines(k, 12, k % 4), "b") for k in range(300, 600)]
    words = [f"w{i}q" for i in range(100)]
    planted = {
        "symbols": (" ".join(w + "#|" for w in words), "a"), "word_length": (" ".join(w + "z" * 30 for w in words), "a"),
        "dup_lines": (lines(900, 16, 5), "a"), "repeats": (" ".join(words + words[:22]), "a"),
    }
    rows = clean + [(r, *x) for r, x in planted.items()] + [("passes", lines(901, 16, 5), "b")]
    docs = spark.createDataFrame([(k, name, "en", source, text) for k, (name, text, source) in enumerate(rows)],
                                 "doc_id long, name string, lang string, source string, text string")
    judged = {r["name"]: r["failed_rules"] for r in rules.judge(docs).collect()}
    assert {n for n, failed in judged.items() if failed} == set(planted)
    assert all(r in judged[r] for r in planted)
    limits = {r["_source"]: r["limits"] for r in rules.thresholds(
        rules.measure(docs.select(F.lit("=en").alias("_lang"), F.concat(F.lit("="), "source").alias("_source"), "text"))).collect()}
    assert limits["=a"]["dup_lines"]["high"] < 300 < limits["=b"]["dup_lines"]["high"] <= 480


def test_sketches_merge_to_the_same(spark):
    docs = table(spark, [prose(k, 60 + k) for k in range(40)])
    whole = rules.sketch(rules.measure(docs), "lang")
    parts = [rules.sketch(rules.measure(docs.filter(F.col("doc_id") % 2 == k)), "lang") for k in (0, 1)]
    both = rules.merged(parts[0].unionByName(parts[1]), "lang")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, rules.merged(whole, "lang").collect()))


def test_scaled_lattice_equals_the_logarithms(monkeypatch):
    """Probabilities scaled by length give what the word-by-word form in logarithms gives; tiny ones fall back to it."""
    pieces = lattice.pieces_of(tokens.vocabulary_path())
    rng = np.random.default_rng(5)
    words = [w.encode() for w in WORDS] + ["größe".encode(), b"x", b"q" * 95, "\U0001f600".encode() * 23, b"=" * 64]
    for total in (1e3, 1e9):
        scores = pieces.scores({k: float(v) for k, v in enumerate(rng.random(len(pieces.ids)) * total)}, total)
        want = [lattice.long_word(pieces, scores, w) for w in words]
        assert np.allclose(lattice.word_scores(pieces, scores[None, :], words)[0], want, rtol=1e-12)
        uses = np.zeros(len(pieces.ids))
        for w in words:
            lattice.long_counts(pieces, scores, w, uses)
        assert np.allclose(lattice.expected_counts(pieces, scores, words), uses, rtol=1e-9, atol=1e-12)
        with monkeypatch.context() as patch:
            patch.setattr(lattice, "TINY", 1e-10)  # most words are below it
            assert np.allclose(lattice.expected_counts(pieces, scores, words), uses, rtol=1e-9, atol=1e-12)
            assert np.allclose(lattice.word_scores(pieces, scores[None, :], words)[0], want, rtol=1e-12)

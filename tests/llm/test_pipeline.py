"""The pipeline stage by stage: each keeps its contract on small tables, odd rows and clashing columns."""
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import common, near_copies, simhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 clean documents, junk, copies, a passage of the benchmark, odd rows; and what is which."""
    text = lambda k, n=80: " ".join(f"w{(k * 37 + i * i) % 9973}" for i in range(n))
    passage = text(5000, 24)
    texts = {k: text(k) + ("\nFooter line of the site" if k % 2 else "") for k in range(300)}
    texts |= {400: "### " * 90, 401: text(401, 10), 500: text(7777), 501: text(7777), 502: text(7777), 600: f"{text(600)}. {passage}. {text(601)}"}
    rows = [(k, t, "en", "a", len(t)) for k, t in texts.items()] + [(None, None, None, None, None), (700, "", "en", "a", 0), (700, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    roles = {"clean": set(range(300)) | {600}, "junk": {400, 401, 700}, "copies": {500, 501, 502}, "passage": passage}
    return docs, folder, roles


def test_stages_keep_columns_and_clean_documents(spark, corpus):
    docs, folder, roles = corpus
    wide = docs.withColumns({c: F.lit(c) for c in ("kept", "n_lines", "hit_ranges", "_print", "row_number")})
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, folder).persist()
        assert wide.columns == [*docs.columns, "kept", "n_lines", "hit_ranges", "_print", "row_number"]
        assert wide.filter("kept != 'kept' or n_lines != 'n_lines'").count() == 0
        seen[name] = {r["doc_id"]: r["text"] for r in wide.collect()}
    clean = roles["clean"]
    assert all(clean <= seen[name].keys() for name in seen)
    assert not roles["junk"] & seen["quality_rules"].keys()
    assert all("Footer line" not in (t or "") for t in seen["line_dedup"].values())
    assert len(roles["copies"] & seen["simhash_dedup"].keys()) == 1
    assert all(roles["passage"] not in (t or "") for t in seen["decontamination"].values())


def test_run_places_every_piece(spark, corpus):
    _, folder, _ = corpus
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and all(r["offset"] + r["length"] <= 2048 for r in packed)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, corpus, name, stage):
    docs, folder, _ = corpus
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies_leave_one(spark, corpus):
    """Word changes that move a 3-word, 3-bit fingerprint, but leave four fifths of the five-word shingles."""
    _, folder, _ = corpus
    word = lambda k, i: f"v{(k * 7919 + i * i * 31) % 99991}"
    texts, similar = [], set()
    for k in range(40):
        own = [word(k, i) for i in range(200)]
        near, far = own[:], own[:]
        for at in (20, 90, 150):  # 15 of 196 shingles: J = 181 / 211
            near[at] = "changed"
        for at in range(10, 200, 20):  # 50 of 196: J = 146 / 246
            far[at] = "other"
        texts += [(10 * k, own), (10 * k + 1, near), (10 * k + 2, far)]
        similar.add(10 * k + 1)
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bits = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    assert any(((bits[i] ^ bits[i - 1]) & (2**64 - 1)).bit_count() > simhash.MAX_BITS for i in similar)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert kept == {i for i, _ in texts} - similar


def test_crowded_bucket_keeps_every_link(spark, corpus):
    """A chain of copies, each similar to the next only, in one group; a stranger stays."""
    _, folder, _ = corpus
    start = [f"u{i * i % 99991}" for i in range(300)]
    chain = [[f"n{i}" if i < 5 * k else w for i, w in enumerate(start)] for k in range(0, 30)]
    rows = [(k, " ".join(t), "en", "a", 1) for k, t in enumerate([*chain, [f"s{i}" for i in range(300)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()} == {0, 30}


def test_copies_of_a_page_keep_their_lines(spark, corpus):
    """A third of a host's rows are one document: its lines stay, the footer of all pages goes."""
    _, folder, _ = corpus
    copy = "first line of the copy\nsecond line of the copy"
    texts = [copy + "\nfooter"] * 20 + [f"line {k} of a page\nfooter" for k in range(40)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()}
    assert kept == {k: t.removesuffix("\nfooter") for k, t in enumerate(texts)}


def plain_groups(texts, similar=80):
    """Smallest number of each group, by comparing all pairs."""
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both * 100 >= similar * (len(sets[x]) + len(sets[y]) - both):
                x_root, y_root = find(x), find(y)
                root[max(x_root, y_root)] = min(x_root, y_root)
    return {find(x) for x in range(len(texts))}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    """Edited copies, a template below the limit, empty and repeated rows, dealt over small tiles."""
    monkeypatch.setattr(near_copies, "BUCKET", 4)
    monkeypatch.setattr(near_copies, "TILE", 3)
    rng = np.random.default_rng(3)
    bases = [[f"w{rng.integers(5000)}" for _ in range(120)] for _ in range(4)]
    template = [f"t{k}" for k in range(130)]
    texts = [None, "", " ", "one two", "One two"]
    for base in bases:
        for _ in range(12):
            own = base[:]
            for at in rng.choice(120, rng.integers(0, 5), replace=False):
                own[at] = f"e{rng.integers(10**9)}"
            texts.append(" ".join(own))
    texts += [" ".join(template + [f"x{k}_{i}" for i in range(20)]) for k in range(14)]  # 126 of 166 shingles shared: J 0.76
    texts.append(texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    again = docs.unionByName(docs.limit(20)).withColumns({"tile": F.lit(1), "key": F.lit("k"), "name": F.lit("n")})
    got = near_copies.one_per_group(again)
    assert got.columns == again.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(plain_groups(texts))
    nameless = again.withColumn("doc_id", F.when(F.col("doc_id") > 30, F.col("doc_id")))
    assert near_copies.one_per_group(nameless).count() == len(plain_groups(texts))


def test_each_pair_is_met_once(spark):
    """A bucket of 50 members in tiles of 8: every pair of members shares exactly one task's pairs."""
    rows = spark.range(50).select(F.lit(7).cast("long").alias("group"), F.md5(F.col("id").cast("string")).alias("key"), F.lit(50).alias("n"))
    met = near_copies.tiled(rows, F.col("n"), 8).collect()
    groups = collections.defaultdict(list)
    for r in met:
        groups[r["one"], r["two"]].append((r["key"], r["tile"]))
    pairs = collections.Counter(
        tuple(sorted((x, y))) for (one, two), own in groups.items() for i, (x, s) in enumerate(own) for y, t in own[:i] if one == two or s != t)
    assert len(pairs) == 50 * 49 // 2 and set(pairs.values()) == {1}


def test_scratch_folders_go(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path / "scratch"))
    with common.Scratch(spark) as scratch:
        assert scratch.saved(spark.range(3)).count() == 3 and (tmp_path / "scratch").exists()
    assert not (tmp_path / "scratch").exists()

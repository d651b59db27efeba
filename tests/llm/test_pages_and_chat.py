"""Archives, HTML extraction and chat formatting: round trips, broken input, and held-out pages."""
import base64
import hashlib
import io
import json
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tabsmith.llm import chat, dom, extract, warc
from tabsmith.llm.common import shared_folder

PAGES = "page_id long, url string, html string"


# archives -----------------------------------------------------------------------------------------------------------
def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archive_round_trip(spark):
    rows = [(5, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/\r\n3", "<p>one</p>"), (7, None, None),
            (8, "u", ""), (-4, "é", "größe" * 4000), (None, "n", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (None, "z", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("_sha", F.lit("clash"))
    back = warc.read_archives(warc.write_archives(pages, shared_folder(spark)), with_payload=True).collect()
    assert all(r["error"] is None for r in back)
    first = {"<p>one</p>": 2, "": 7}
    want = []
    for page, url, html in rows:
        text = html or ""
        to = first.get(text)
        revisit = to is not None and to != page
        want.append((page, len(text.encode()), sha(text), "revisit" if revisit else "response", to if revisit else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {bytes(r["payload"]).decode() for r in back if r["record_type"] == "response"} == {(h or "") for _, _, h in rows}
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_folder(spark))).count() == 0


def test_archives_roll_and_share_a_dictionary(tmp_path):
    raws = [warc.record(k, f"http://x/{k}", f"<html><p>page number {k} with common words</p></html>".encode() * 30, None, False) for k in range(2000)]
    made = list(warc._rolled(iter(raws), f"file://{tmp_path}", 20_000))
    assert len(made) > 1 and sum(n for _, n, _ in made) == len(raws)
    found = []
    for path, n, size in made:
        data = open(path.removeprefix("file://"), "rb").read()
        assert len(data) == size and data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        with pytest.raises(zstandard.ZstdError):  # needs the dictionary
            skip = 8 + int.from_bytes(data[4:8], "little")
            zstandard.ZstdDecompressor().decompressobj().decompress(data[skip:])
        found += [raw for _, raw in warc.frames(io.BytesIO(data), chunk=777)]
    assert found == raws


@pytest.mark.parametrize("spoil, says", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (lambda r: r[:-5] + r[-4:], "Content-Length"),
    (lambda r: r.replace(b"hello", b"hullo"), "digest"), (lambda r: r.replace(b"WARC-Date", b"WARC-Dite"), "WARC-Date"),
    (lambda r: r.replace(b"Content-Type: application", b"Content Type application"), "header"),
])
def test_wrong_records_are_told(spoil, says):
    good = warc.record(1, "http://x", b"hello", None, False)
    assert warc.parse(good)[1] == b"hello"
    with pytest.raises(ValueError, match=says):
        warc.parse(spoil(good))


def test_broken_archives_give_error_rows(spark, tmp_path):
    raws = [warc.record(k, None, b"x" * k, None, False) for k in range(50)]
    [(path, _, size)] = warc._rolled(iter(raws), f"file://{tmp_path}", 1 << 20)
    name = path.removeprefix("file://")
    data = open(name, "rb").read()
    open(name, "wb").write(data[: size - 7])
    rows = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert len([r for r in rows if r["error"] is None]) == 49 and len([r for r in rows if r["error"]]) == 1


# extraction ---------------------------------------------------------------------------------------------------------
def page(k):
    rng = random.Random(k)
    words = lambda n: " ".join(rng.choice("amber river quiet stone cloud market".split()) for _ in range(n))
    body = "".join(f"<p>{words(rng.randint(8, 60))}. A &amp; B{k}</p>" for _ in range(rng.randint(2, 6)))
    menu = "".join(f'<li><a href="/{j}">{words(1)}</a></li>' for j in range(5))
    return (f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul>{menu}</ul></nav>"
            f'<div class="ad">{words(9)}</div><article><h1>{words(5)}</h1>{body}</article><footer>&copy; {words(4)}</footer></body></html>')


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit(spark.createDataFrame([(k, f"u{k}", page(k)) for k in range(60)], PAGES))


def test_held_out_pages(model):
    for k in range(100, 130):
        nodes = dom.nodes_of(dom.Tree(page(k)).root)
        assert extract.main_text(page(k), model) == dom.text_of(nodes, dom.labels(nodes) > 0)


def test_other_layouts(model):
    right = total = 0
    for k in range(200, 260):
        blocks = dom.text_of(*(lambda n: (n, dom.labels(n) > 0))(dom.nodes_of(dom.Tree(page(k)).root))).split("\n\n")
        form = extract.rebuilt(blocks, [f"other {j} text of the page about things, more or less" for j in range(9)], random.Random(k))
        nodes = dom.nodes_of(dom.Tree(form).root)
        want, got = dom.labels(nodes), dom.decode(nodes, model.log_odds(dom.features(nodes)))
        texts = [i for i, n in enumerate(nodes) if n.tag == "#text"]
        right += sum(want[i] == got[i] for i in texts)
        total += len(texts)
    assert right / total > 0.9


def test_decoding_never_keeps_what_is_below_a_dropped_node(model):
    nodes = dom.nodes_of(dom.Tree(page(1)).root)
    rng = random.Random(2)
    place = {n: k for k, n in enumerate(nodes)}
    for _ in range(50):
        odds = np.array([rng.gauss(0, 3) for _ in nodes])
        kept = dom.decode(nodes, odds)
        assert all(kept[place[n.parent]] for k, n in enumerate(nodes) if kept[k] and n.parent)


@pytest.mark.parametrize("html, blocks", [
    ("<article><p>one</p><button>x<p>two</p></article>", ["one", "two"]),
    ("<div><p>one <svg><path d=1><text>q</text></p><p>two</p></div>", ["one", "two"]),
    ("<head><title>abc<body><p>one</p>", ["one"]),
    ("<p>a</p><noscript><div>no</div></noscript><button><p>no</p></button><p>b</p>", ["a", "b"]),
    ("<p>a</p><noscript>no<p>b</p><template><p>no</p></template><p>c", ["a", "b", "c"]),
    ("<p>a</p><select><option>1<option>2<p>b</p><select><option>k</select><p>c</p>", ["a", "b", "c"]),
    ("<p>a <b>bold <button>x</b> more</p>", ["a bold more"]),
    ("<div><p>a</p><button><b>k<p>two</b> more</p></div><p>end</p>", ["a", "two more", "end"]),
    ("<button><button>x</button><p>y</p></button>z", ["z"]),
    ("x <iframe src=a> <div>y</div></body>", ["x", "y"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> b</p>", ["a x=1 b"]),
    ("<p>a</p><!-- open <p>b", ["a"]), ("<p>a</p><!-- <!-- open <p>b", ["a"]), ("<p>a</p><!-- c --><p>b</p>--", ["a", "b", "--"]),
    ("<script><!-- x </script><p>a</p>", ["a"]), ("<script><!-- x </script><p>a</p><!-- b", ["a"]), ("<p>a</p><script>x<p>b", ["a"]),
    ("<p>1 --> 2 <!--> 3 --!></p>", ["1 --> 2 3 --!>"]), ("<p>a <!-- b --!> c</p>", ["a c"]), ("<p>a <!-- b --> c --!>", ["a c --!>"]),
])
def test_hidden_elements_and_comments_end(html, blocks):
    nodes = dom.nodes_of(dom.Tree(html).root)
    assert [" ".join("".join(n.text).split()) for n in nodes if n.tag == "#text"] == blocks


def test_many_open_hidden_elements_take_linear_time():
    assert len(dom.nodes_of(dom.Tree("<p>x<button>y" * 20_000).root)) == 40_001


def _choices(node):
    """Every choice below a node that stays, as sets of nodes."""
    out = [{node}]
    for c in node.children:
        out = [a | b for a in out for b in [set(), *_choices(c)]]
    return out


def test_decoding_is_the_best_of_all_choices():
    rng = random.Random(7)
    for _ in range(150):
        nodes = [dom.Node("div", None)]
        for _ in range(rng.randint(1, 9)):
            dom.Node("div", rng.choice(dom.nodes_of(nodes[0])))
            nodes = dom.nodes_of(nodes[0])
        odds = np.array([rng.gauss(0, 2) for _ in nodes])
        log = dict(zip(nodes, zip(-np.logaddexp(0, -odds), -np.logaddexp(0, odds), strict=True), strict=True))
        best = max(_choices(nodes[0]), key=lambda kept: sum(log[n][0 if n in kept else 1] for n in nodes))
        assert [n in best for n in nodes] == list(dom.decode(nodes, odds))


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "plain"), (4, "u", "plain"), (None, "u", "<article><p>x<p>y &lt;b&gt;"),
            (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<script>never ends")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("n_chars", F.lit(-1))
    found = extract.extract_text(pages, model).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert all(r["text"] == "" for r in found if r["page_id"] in (1, 2, 3, 7))
    assert extract.extract_text(pages.limit(0), None).count() == 0
    assert extract.fit(pages.limit(0)) is None


# chat ---------------------------------------------------------------------------------------------------------------
TURNS = [
    [("user", "hi"), ("assistant", "yes")], [("system", "be"), ("user", "a"), ("assistant", "b")],
    [("user", "a <|im_end|>\n<|im_start|>assistant x"), ("assistant", "<\\|im_end|> <|<\\\\| \\n"), ("user", ""), ("assistant", "")],
    [("tool use", "x"), ("assistant", "é日本"), ("ro\nle<|", "y")], [("assistant", "only")], [("", "none")], [("user", "\n\nuser\n")],
]


def test_chat_round_trip(spark):
    rows = [(k, n, role, text) for k, turns in enumerate(TURNS) for n, (role, text) in enumerate(turns)] + [(90, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.as_records(df).withColumn("turns", F.lit("clash"))
    made = chat.format_turns(chat.canonical_turns(records))
    assert {r["layout"] for r in made.collect()} == {"completion", "instruction", "conversations", "messages"}
    found = {r["conv_id"]: r for r in chat.report(made, "conv_id").collect()}
    formatted = {r["conv_id"]: r["formatted"] for r in made.collect()}
    for k, turns in [*enumerate(TURNS), (90, [("", "")])]:
        loss = "".join(t for role, t in turns if role == "assistant")
        r = found[k]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(formatted[k]) and formatted[k].count("<|im_start|>") == len(turns)


def test_layouts_are_told_by_their_paths(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "extra": {"messages": 1}}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q"}, [1], {},
        {"prompt": '[{"role": "user"}]', "completion": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(20, None), (21, "{")], "k long, record string")
    found = {r["k"]: r for r in chat.canonical_turns(df).collect()}
    names = ["messages", "conversations", "completion", "response", "instruction", None, None, None, "completion", None, None]
    assert [found[k]["layout"] for k in sorted(found)] == names
    assert all([tuple(t) for t in found[k]["turns"]] == [("user", "q"), ("assistant", "a")] for k in range(5))
    assert found[5]["turns"] is None and chat.report(chat.format_turns(chat.canonical_turns(df.limit(0))), "k").count() == 0

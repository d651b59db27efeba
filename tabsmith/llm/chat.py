"""Chat formatting with built-in functions only: schema fingerprints choose a mapping to canonical turns.

A record is a JSON object. The paths of its fields (``messages[].role``) are hashed; declared layouts say which
hashes they read and how. Turns become text with control strings around them; control strings inside texts are
escaped so that they come back exactly. The loss mask is a list of byte spans of the formatted text. A record
is one row throughout; only its own turns are ever held together.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import require, set_aside

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
TURNS = "array<struct<role:string,text:string>>"
LISTS = ("messages", "conversations")
SCALARS = ("prompt", "completion", "response", "system", "instruction", "input", "output")
SCHEMA = ", ".join([f"{n} array<map<string,string>>" for n in LISTS] + [f"{n} string" for n in SCALARS])
JSON = {"maxStringLen": str(2**31 - 1), "maxNestingDepth": "1000"}
#: Names of roles in the conversations layout, and what they are called here.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "system": "system"}


@dataclass(frozen=True)
class Layout:
    """Which field paths a layout has, and its turns as an expression over the parsed record."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[Column], Column]

    def shapes(self) -> list[tuple[str, ...]]:
        subsets = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [tuple(sorted({*self.required, *s})) for s in subsets]


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _if_any(role: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(_turn(role, text))).otherwise(F.array().cast(TURNS))


def _named(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), role)


def _instruction(r: Column) -> Column:
    asked = F.when(F.coalesce(r["input"], F.lit("")) == "", r["instruction"]).otherwise(F.concat_ws("\n", r["instruction"], r["input"]))
    return F.concat(_if_any("system", r["system"]), F.array(_turn("user", asked), _turn("assistant", r["output"])))


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (),
           lambda r: F.transform(r["messages"], lambda m: _turn(m["role"], m["content"]))),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (),
           lambda r: F.transform(r["conversations"], lambda m: _turn(_named(m["from"]), m["value"]))),
    Layout("completion", ("prompt", "completion"), ("system",),
           lambda r: F.concat(_if_any("system", r["system"]), F.array(_turn("user", r["prompt"]), _turn("assistant", r["completion"])))),
    Layout("response", ("prompt", "response"), ("system",),
           lambda r: F.concat(_if_any("system", r["system"]), F.array(_turn("user", r["prompt"]), _turn("assistant", r["response"])))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), _instruction),
)


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _nested_paths(messages: Column, name: str) -> Column:
    none = F.array().cast("array<map<string,string>>")
    keys = F.array_distinct(F.flatten(F.transform(F.coalesce(messages, none), lambda m: F.map_keys(m))))
    return F.transform(keys, lambda key: F.concat(F.lit(f"{name}[]."), key))


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (role, text) to rows with a JSON object in ``column``.

    Fields that no layout reads are ignored. A record that fits no layout, is no object or is null keeps its
    row: layout and turns are null. Null roles and texts are empty; an empty list of messages has no fields
    below it and so fits no layout. Columns called like the added ones give way to them.
    """
    require(records, column)
    records, moved = set_aside(records, *({"fingerprint", "layout", "turns", "_parsed", "_paths"} - {column}))
    records = records.drop(*moved.values())
    vocabulary = F.array(*[F.lit(p) for p in sorted({p for lay in LAYOUTS for p in lay.required + lay.optional})])
    parsed = records.withColumn("_parsed", F.from_json(column, SCHEMA, JSON))
    nested = [_nested_paths(F.col("_parsed")[n], n) for n in LISTS]
    top = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    parsed = parsed.withColumn("_paths", F.array_intersect(F.concat(top, *nested), vocabulary))
    parsed = parsed.withColumn("fingerprint", _hash(F.col("_paths")))
    name = turns = None
    for layout in LAYOUTS:
        fits = F.col("fingerprint").isin([_hash(F.array(*map(F.lit, shape))) for shape in layout.shapes()])
        name = F.when(fits, layout.name) if name is None else name.when(fits, layout.name)
        found = layout.turns(F.col("_parsed")).cast(TURNS)
        turns = F.when(fits, found) if turns is None else turns.when(fits, found)
    return parsed.withColumns({"layout": name, "turns": turns}).drop("_parsed", "_paths")


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes in, also where some stand already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.when(role.rlike(r"^[A-Za-z0-9_ .-]*$"), role).otherwise(F.concat(F.lit("="), F.base64(F.encode(role, "UTF-8"))))


def _role_in(role: Column) -> Column:
    plain = F.decode(F.unbase64(role.substr(F.lit(2), F.char_length(role))), "UTF-8")
    return F.when(role.startswith("="), plain).otherwise(role)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start, length in bytes, in order) to rows with ``turns``.

    Under the loss are the texts of assistant turns, without what marks them. Null turns give nulls, no turns an
    empty text. Roles of unusual characters are written in base64 after an equals sign.
    """
    require(turns, "turns")
    turns, moved = set_aside(turns, "formatted", "loss_spans", "_turns")
    turns = turns.drop(*moved.values())
    made = turns.withColumn("_turns", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == LEARNED).alias("loss"),
    )))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    no_spans = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.octet_length(t["head"])
        size = F.octet_length(t["body"]).cast("long")
        span = F.struct(start.cast("long").alias("start"), size.alias("length"))
        return F.struct(
            (start + size + len(END)).cast("long").alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate("_turns", F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("spans")), step)["spans"]
    return made.withColumns({"formatted": whole, "loss_spans": spans}).drop("_turns")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, k: k > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        at = F.char_length(role) + 2
        return F.struct(_role_in(role).alias("role"), unescape(part.substr(at, F.char_length(part) - at + 1 - len(END))).alias("text"))

    return F.transform(parts, turn)


def report(formatted: DataFrame, key: str) -> DataFrame:
    """What is read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and the layout."""
    back = formatted.withColumns({
        "_back": read_turns(F.col("formatted")), "_raw": F.encode("formatted", "UTF-8"),
    }).withColumn("_loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.decode(
        F.substring("_raw", (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))), ""))
    text = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key, F.size("_back").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: conversations given as rows by turn, as JSON in the layout that suits their turns.

    A question and an answer become prompt and completion; with a system text before them, an instruction;
    other conversations of the usual roles name them human and gpt, and the rest are messages. Null roles and
    texts are empty, rows with equal turns follow role and text, a null turn comes first.
    """
    require(rows, "conv_id", "turn", "role", "text")
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("t"))
    grouped = grouped.withColumn("roles", F.array_join("t.role", ","))
    names = F.create_map(*[F.lit(x) for ours, theirs in ROLE_NAMES.items() for x in (theirs, ours)])
    text = lambda k: F.get("t", F.lit(k))["text"]
    completion = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))
    instruction = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    conversations = F.to_json(F.struct(F.transform(
        "t", lambda x: F.struct(names[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations")))
    messages = F.to_json(F.struct(F.transform(
        "t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    usual = F.forall("t", lambda x: x["role"].isin(*ROLE_NAMES.values()))
    return grouped.select("conv_id", F.when(F.col("roles") == "user,assistant", completion)
                          .when(F.col("roles") == "system,user,assistant", instruction)
                          .when(usual, conversations).otherwise(messages).alias("record"))

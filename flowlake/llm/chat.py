"""Chat formatting: layouts told apart by schema fingerprints, canonical turns, one template with a loss mask.

Records come in many layouts: rows of single turns, prompt and completion, instruction, input and
output, lists of messages under different names. A record's nested field paths (names only; the types
of its values do not count) are hashed, and the fingerprint selects one of the declarative ``LAYOUTS``,
which say where roles and texts are. Nothing is guessed: a record whose fingerprint no layout has gets
no turns and no layout, and ``layout_report`` counts such records by their paths.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text,
of this template and of other common ones, get a backslash after their first character; those that
have backslashes there already get one more. So no text can open or close a turn, texts without
control strings stay as they are, and reading back removes exactly what was added. A role is
percent-encoded, which leaves plain names unchanged. The loss mask lists the spans of the trained
roles' texts in code points of the formatted string.

Everything is built-in functions. Record layouts are formatted row by row without a shuffle; single
turns are grouped by conversation, which is one value of the result and so must fit a task.

Defined results for odd input
* A null text is empty, a null role is ''. Null message lists and records that are null, or no JSON
  object, have no layout. A list without messages is a conversation without turns.
* Turns of one conversation are ordered by turn (null first), then role, then text; repeated rows
  are repeated turns. Rows of a null conversation id are one conversation.
* An empty table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import let

TURNS = "array<struct<role: string, text: string>>"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string of common chat templates.
CONTROL = r"/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>"
TRAINED = ("assistant",)


@dataclass(frozen=True)
class One:
    """A turn of a fixed role, or of the role at a path, with the text at a path. ``optional``: no turn where the text is empty."""

    text: str
    role: str | None = None
    role_at: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list. ``part``: the text is a list of parts, joined, whose texts have this name."""

    at: str
    role: str
    text: str
    part: str | None = None


@dataclass(frozen=True)
class Layout:
    """``paths``: nested field paths as a tree of dicts, one-element lists and None; ``turns``: where the turns are; ``roles``: other names of roles."""

    paths: dict
    turns: tuple[One | Each, ...]
    roles: dict[str, str] = field(default_factory=dict)


_SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = {
    "turn": Layout({"role": None, "text": None}, (One("text", role_at="role"),)),
    "prompt_completion": Layout({"prompt": None, "completion": None}, (One("prompt", "user"), One("completion", "assistant"))),
    "prompt_response": Layout({"prompt": None, "response": None}, (One("prompt", "user"), One("response", "assistant"))),
    "system_prompt_response": Layout(
        {"system": None, "prompt": None, "response": None},
        (One("system", "system", optional=True), One("prompt", "user"), One("response", "assistant"))),
    "question_answer": Layout({"question": None, "answer": None}, (One("question", "user"), One("answer", "assistant"))),
    "instruction": Layout({"instruction": None, "output": None}, (One("instruction", "user"), One("output", "assistant"))),
    "instruction_input": Layout(
        {"instruction": None, "input": None, "output": None},
        (One("instruction", "user"), One("input", "user", optional=True), One("output", "assistant"))),
    "messages": Layout({"messages": [{"role": None, "content": None}]}, (Each("messages", "role", "content"),)),
    "no_messages": Layout({"messages": [None]}, (Each("messages", "role", "content"),)),
    "message_parts": Layout(
        {"messages": [{"role": None, "content": [{"type": None, "text": None}]}]}, (Each("messages", "role", "content", "text"),)),
    "conversations": Layout({"conversations": [{"from": None, "value": None}]}, (Each("conversations", "from", "value"),), _SHARED_ROLES),
    "nested_prompt": Layout(
        {"prompt": [{"role": None, "content": None}], "completion": [{"role": None, "content": None}]},
        (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
}


# fingerprints -----------------------------------------------------------------------------------------------
def path_tree(paths: dict | list | None) -> str:
    """The nested field paths in the form that ``schema_of_variant`` gives, without the types of values."""
    if isinstance(paths, dict):
        return "OBJECT<" + ", ".join(k if paths[k] is None else f"{k}: {path_tree(paths[k])}" for k in sorted(paths)) + ">"
    return f"ARRAY<{path_tree(paths[0])}>" if isinstance(paths, list) else ""


def _tree_of_type(kind: T.DataType) -> dict | list | None:
    if isinstance(kind, T.StructType):
        return {f.name: _tree_of_type(f.dataType) for f in kind}
    return [_tree_of_type(kind.elementType)] if isinstance(kind, T.ArrayType) else None


def record_paths(record: Column) -> Column:
    """Path tree of a variant."""
    scalar = r"(VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|VARIANT|DECIMAL\(\d+,\d+\))"
    named = F.regexp_replace(F.schema_of_variant(record), rf": {scalar}(?=[,>])", "")
    return F.regexp_replace(named, rf"ARRAY<{scalar}>", "ARRAY<>")


def fingerprint(paths: Column | str) -> Column:
    return F.xxhash64(F.lit(paths) if isinstance(paths, str) else paths)


# canonical turns --------------------------------------------------------------------------------------------
def _role(name: Column, layout: Layout) -> Column:
    return reduce(lambda other, pair: F.when(name == pair[0], pair[1]).otherwise(other), layout.roles.items(), F.coalesce(name, F.lit("")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, layout: Layout, typed: bool) -> Column:
    """Turns of a record (variant, or struct where ``typed``) by a layout."""
    def get(path: str, kind: str) -> Column:
        return record[path].cast(kind) if typed else F.try_variant_get(record, f"$.{path}", kind)

    def turns(part: One | Each) -> Column:
        if isinstance(part, One):
            role = F.lit(part.role) if part.role is not None else _role(get(part.role_at, "string"), layout)
            text = get(part.text, "string")
            one = F.array(_turn(role, text))
            return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.array().cast(TURNS)).otherwise(one) if part.optional else one
        text_type = "string" if part.part is None else f"array<struct<`{part.part}`: string>>"
        if typed:
            found = record[part.at]
        else:
            found = F.try_variant_get(record, f"$.{part.at}", f"array<struct<`{part.role}`: string, `{part.text}`: {text_type}>>")
        text = lambda m: m[part.text].cast("string") if part.part is None else F.array_join(F.transform(m[part.text], lambda p: p[part.part]), "")
        return F.coalesce(F.transform(found, lambda m: _turn(_role(m[part.role].cast("string"), layout), text(m))), F.array().cast(TURNS))

    return F.concat(*[turns(p).cast(TURNS) for p in layout.turns])


def canonical_turns(records: DataFrame, record: str, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` in place of the column ``record``: JSON, a variant or a struct.

    The layout of a struct is that of its type; other records have their own.
    """
    layouts = LAYOUTS if layouts is None else layouts
    kind = records.schema[record].dataType
    typed = isinstance(kind, T.StructType)
    if typed:
        paths, value = F.when(F.col(record).isNotNull(), F.lit(path_tree(_tree_of_type(kind)))), F.col(record)
        fitting = {name: x for name, x in layouts.items() if path_tree(x.paths) == path_tree(_tree_of_type(kind))}
    else:
        value = F.try_parse_json(record) if isinstance(kind, T.StringType) else F.col(record)
        paths, fitting = record_paths(F.col("__record")), layouts
    found = records.withColumn("__record", value).withColumn("__print", fingerprint(F.coalesce(paths, F.lit(""))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, x in fitting.items():
        same = F.col("__print") == fingerprint(path_tree(x.paths))
        layout, turns = F.when(same, name).otherwise(layout), F.when(same, _turns(F.col("__record"), x, typed)).otherwise(turns)
    return found.withColumns({"layout": layout, "turns": turns}).drop(*{"__record", "__print", record} - {"layout", "turns"})


def layout_report(records: DataFrame, record: str) -> DataFrame:
    """paths, n of JSON records that no layout fits: what a mapping is missing for."""
    value = F.try_parse_json(record)
    known = F.array(*[fingerprint(path_tree(x.paths)) for x in LAYOUTS.values()])
    paths = records.select(F.coalesce(record_paths(value), F.lit("")).alias("paths"))
    return paths.filter(~F.array_contains(known, fingerprint(F.col("paths")))).groupBy("paths").agg(F.count("*").alias("n"))


def gather_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id, turns: the ``turns`` of all rows of a conversation in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("at"), "turns")))
    return rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.flatten(F.transform(ordered, lambda r: r["turns"])).alias("turns"))


# the template -----------------------------------------------------------------------------------------------
def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _starts(pieces: Column) -> Column:
    """Code points before each piece."""
    grown = F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda seen, p: F.concat(seen, F.array(F.element_at(seen, -1) + F.length(p))))
    return F.slice(grown, F.lit(1), F.size(pieces))


def format_turns(convs: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``convs`` with ``formatted`` and ``mask`` in place of ``turns``. A span of the mask has the number of its turn, a start and a length."""
    head = lambda t: F.concat(F.lit(BEGIN), F.url_encode(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained).alias("trained")))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    spans = F.zip_with("parts", _starts(F.transform("parts", whole)), lambda p, start: F.struct(
        p["trained"].alias("trained"), (start + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))
    numbered = F.transform(spans, lambda s, i: F.struct(s["trained"].alias("trained"), i.alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    mask = F.transform(F.filter(numbered, lambda s: s["trained"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    held = convs.withColumn("parts", parts)
    return held.withColumns({"formatted": F.array_join(F.transform("parts", whole), ""), "mask": mask}).drop("parts", "turns")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted string."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>")), lambda p: F.length(p) > 0)

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(name) + 2, F.length(piece) - F.length(name) - 1 - len(END))
        return F.struct(F.url_decode(name).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    pieces = F.filter(F.split(formatted, F.lit(r"(?=<\|im_start\|>)")), lambda p: F.length(p) > 0)
    return let(pieces, lambda p: let(_starts(p), lambda starts: F.transform(mask, lambda m: unescape(F.substring(
        F.element_at(p, m["turn"] + 1), (m["start"] - F.element_at(starts, m["turn"] + 1) + 1).cast("int"), m["length"].cast("int"))))))

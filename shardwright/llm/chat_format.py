"""Chat formatting: heterogeneous records to canonical turns, canonical turns to one training text.

A record's layout is told by a fingerprint, the MD5 of its nested field paths: for JSON payloads from the schema of the
parsed variant, row by row; for typed tables from the DataFrame's schema, once. The fingerprint selects a declarative
mapping from LAYOUTS; a record of unknown layout keeps a row with null role, text and layout.

The template marks a turn as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts every control string gets one
backslash after `<|` (and those that have some get one more), so no marker can be forged and reading back is exact;
roles have `&` and line breaks written as `&a` and `&n`.

All of it is SQL expressions. Defined cases: null texts and roles are empty; turns of a conversation go by turn number
(null first), then role, then text; a null conv_id is a conversation; an empty table gives an empty result; other
columns are ignored; a payload that isn't JSON has no layout.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_turns = "array<struct<role: string, text: string>>"
_chat = "transform(variant_get(v, '$.{0}', 'array<struct<{1}: string, {2}: string>>'), m -> struct({3} AS role, m.{2} AS text))"
_human = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"
_field = "coalesce(variant_get(v, '$.{0}', 'string'), '')"
_pair = "array(struct('user' AS role, {0} AS text), struct('assistant' AS role, {1} AS text))"

#: Layout: name, nested field paths, and the SQL that makes its turns from a variant v.
LAYOUTS: list[tuple[str, str, str]] = [
    ("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _chat.format("messages", "role", "content", "m.role")),
    ("messages_id", "OBJECT<id, messages: ARRAY<OBJECT<content, role>>>", _chat.format("messages", "role", "content", "m.role")),
    ("message_parts", "OBJECT<messages: ARRAY<OBJECT<content: ARRAY<OBJECT<text, type>>, role>>>",
     "transform(variant_get(v, '$.messages', 'array<struct<role: string, content: array<struct<text: string, type: string>>>>'), m -> struct(m.role AS role, array_join(transform(m.content, p -> coalesce(p.text, '')), '\\n') AS text))"),
    ("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _chat.format("conversations", "from", "value", _human)),
    ("instruction", "OBJECT<instruction, output>", _pair.format(_field.format("instruction"), _field.format("output"))),
    ("instruction_input", "OBJECT<input, instruction, output>",
     _pair.format(f"concat({_field.format('instruction')}, CASE WHEN {_field.format('input')} = '' THEN '' ELSE concat('\\n\\n', {_field.format('input')}) END)", _field.format("output"))),
    ("prompt_completion", "OBJECT<completion, prompt>", _pair.format(_field.format("prompt"), _field.format("completion"))),
    ("prompt_response", "OBJECT<prompt, response>", _pair.format(_field.format("prompt"), _field.format("response"))),
    ("question_answer", "OBJECT<answer, question>", _pair.format(_field.format("question"), _field.format("answer"))),
]
#: Layouts of typed tables: paths, and the columns that hold conversation, turn, role and text.
ROW_LAYOUTS: list[tuple[str, str, tuple[str, str, str, str]]] = [
    ("rows", "OBJECT<conv_id, role, text, turn>", ("conv_id", "turn", "role", "text")),
    ("row_content", "OBJECT<content, conversation_id, role, turn>", ("conversation_id", "turn", "role", "content")),
    ("row_speaker", "OBJECT<conversation_id, speaker, utterance, utterance_no>", ("conversation_id", "utterance_no", "speaker", "utterance")),
]


def fingerprint(paths: str) -> str:
    return hashlib.md5(paths.encode()).hexdigest()


def type_paths(kind: T.DataType) -> str:
    """The nested field paths of a type, scalar types left out, names sorted."""
    if isinstance(kind, T.StructType):
        inner = (type_paths(f.dataType) for f in sorted(kind.fields, key=lambda f: f.name))
        return "OBJECT<" + ", ".join(n + (f": {p}" if p else "") for n, p in zip(sorted(kind.names), inner)) + ">"
    if isinstance(kind, T.ArrayType):
        p = type_paths(kind.elementType)
        return f"ARRAY<{p}>" if p else "ARRAY"
    return ""


def variant_paths(v: Column) -> Column:
    """The same for a variant."""
    s = F.schema_of_variant(v)
    scalar = "(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\\(\\d+,\\s*\\d+\\))"
    s = F.regexp_replace(s, f": {scalar}(?=[,>])", "")
    return F.regexp_replace(s, f"ARRAY<{scalar}>", "ARRAY")


def turns_of_payloads(records: DataFrame, conv_id: str = "conv_id", payload: str = "payload") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text, layout) of JSON payloads."""
    df = records.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(payload).alias("v"))
    df = df.withColumn("print", F.md5(variant_paths(F.col("v"))))
    turns, name = F.lit(None).cast(_turns), F.lit(None).cast("string")
    for layout, paths, sql in reversed(LAYOUTS):
        own = F.col("print") == fingerprint(paths)
        turns, name = F.when(own, F.expr(sql).cast(_turns)).otherwise(turns), F.when(own, layout).otherwise(name)
    df = df.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "m"))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text", "layout")


def turns_of_rows(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Canonical turns of a typed table with a row for each turn. columns: those that belong to the record."""
    rows = rows.select(*(columns or rows.columns))
    mine = fingerprint(type_paths(rows.schema))
    for layout, paths, (conv, turn, role, text) in ROW_LAYOUTS:
        if fingerprint(paths) == mine:
            return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(layout).alias("layout"))
    raise ValueError(f"no layout has the fields {type_paths(rows.schema)}")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\\*)(im_start|im_end)\|>", r"<|\\$1$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|\\(\\*)(im_start|im_end)\|>", r"<|$1$2|>")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and mask: for each turn in order the code points of its header, of
    its text as written (the end marker and a line break follow), and whether the loss is taken over that text."""
    role = escape(F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("&"), F.lit("&a")), F.lit("\n"), F.lit("&n")))
    df = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"))
    df = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head"))).alias("t"))
    df = df.select("conv_id", F.transform("t", lambda x: F.struct(x["head"].alias("head"), escape(x["text"]).alias("body"), (x["role"] == LOSS_ROLE).alias("loss"))).alias("t"))
    return df.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["body"]).alias("chars"), x["loss"].alias("loss"))).alias("mask"),
    )


def read_back(text: Column, mask: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text, masked): masked is the text under the loss
    mask, null outside it. Only the text and the mask's lengths and flags are looked at."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x: Column, m: Column) -> Column:
        role = F.substring_index(F.substring(x, len(START) + 1, 2147483647), "\n", 1)
        return F.struct(
            F.replace(F.replace(unescape(role), F.lit("&n"), F.lit("\n")), F.lit("&a"), F.lit("&")).alias("role"),
            unescape(x.substr(F.instr(x, "\n") + 1, F.length(x))).alias("text"),
            F.when(m["loss"], unescape(x.substr(m["head"] + 1, m["chars"]))).alias("masked"),
        )

    return F.zip_with(parts, mask, turn)

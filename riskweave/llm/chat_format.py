"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records arrive as JSON text in whatever layout their source uses. The nested field
paths of a record, hashed, are its fingerprint; the fingerprint selects one declarative
mapping, which says where turns, roles and texts stand. Turns in the canonical form
are then written with one template and can be read back from it exactly.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Inside roles and
texts a backslash is doubled, and every control string (``CONTROL``) gets a backslash
behind its first character, so that no control string of a text survives as one.
``unescape`` drops one backslash before any character: the exact inverse.

A record of over ``WIDE`` characters may be too long for a variant, which holds 128 MB.
Its outline, the record with every string value emptied, goes through the same rule: the
outline's field paths are the record's, so the fingerprint is the same at any length.
Only the strings themselves are then read by a schema; any that a string can hold is
formatted. (The outline must fit a variant: some millions of turns in one record.)

Defined results: null texts and roles count as empty; a record that isn't JSON or whose
fingerprint has no mapping gives no turns and is found by ``unmapped``; rows with equal
turn numbers are ordered by role and text; repeated rows are turns of their own; empty
tables give empty results; other columns are ignored; a null id is an id of its own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mean something to a chat template, ours or another.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"
TURN = "struct<ord:bigint,role:string,text:string>"
#: A record of more characters may not fit a variant; its strings are read by a schema instead.
WIDE = 4 << 20
_LONG = {"maxStringLen": "2147483647"}


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns.

    ``example`` is any record of the layout; only its field paths count. ``turns`` is the
    path of an array of messages with fields ``role`` and ``text``; without it, ``fixed``
    lists (role, path) in the order of the turns, and ``row`` (ord, role, text) the paths
    of a record that is one turn itself.
    """

    name: str
    example: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


MAPPINGS = (
    Mapping("turn_rows", '{"role": "", "text": "", "turn": 0}', row=("turn", "role", "text"), roles=()),
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', "messages", "role", "content"),
    Mapping("from_value", '{"conversations": [{"from": "", "value": ""}]}', "conversations", "from", "value"),
    Mapping("instruction", '{"instruction": "", "output": ""}', fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", '{"instruction": "", "input": "", "output": ""}', fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", '{"prompt": "", "completion": ""}', fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt", '{"system": "", "prompt": "", "response": ""}', fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def field_paths(value: Column) -> Column:
    """The nested field paths of a variant, in the variant's own (sorted) order; leaf types don't count."""
    return F.regexp_replace(F.schema_of_variant(value), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9,]+\))?|<(?!/)[A-Z]+(\([0-9,]+\))?>", "")


def _paths_of(example: str) -> str:
    """What ``field_paths`` gives for a record, worked out in plain Python."""

    def walk(x) -> str:
        if isinstance(x, dict):
            return "OBJECT<" + ", ".join(k + (f": {walk(v)}" if isinstance(v, dict | list) else "") for k, v in sorted(x.items())) + ">"
        return "ARRAY" + (f"<{walk(x[0])}>" if x and isinstance(x[0], dict | list) else "") if isinstance(x, list) else ""

    return walk(json.loads(example))


def fingerprint(value: Column) -> Column:
    return F.sha2(field_paths(value), 256)


def _from_variant(m: Mapping, v: Column) -> Column:
    """The turns that mapping ``m`` finds in a variant."""
    if m.row:
        at, role, text = m.row
        return F.array(F.struct(F.try_variant_get(v, f"$.{at}", "bigint").alias("ord"), F.try_variant_get(v, f"$.{role}", "string").alias("role"), F.try_variant_get(v, f"$.{text}", "string").alias("text")))
    if m.turns:
        return F.transform(F.try_variant_get(v, f"$.{m.turns}", "array<variant>"), _message(m))
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(role).alias("role"), F.try_variant_get(v, f"$.{path}", "string").alias("text")) for i, (role, path) in enumerate(m.fixed)])


def outline(record: Column) -> Column:
    """A JSON text with all string values emptied; field names, numbers and the rest stay as they are."""
    held = F.replace(F.replace(record, F.lit("\\\\"), F.lit("\x01b")), F.lit('\\"'), F.lit("\x01q"))  # so that a quote is an end of a string
    back = lambda t: F.replace(F.replace(t, F.lit("\x01q"), F.lit('\\"')), F.lit("\x01b"), F.lit("\\\\"))
    tokens = F.regexp_extract_all(held, F.lit(r'"[^"]*"(?:\s*:)?|[^"]+'), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"') & ~t.endswith(":"), F.lit('""')).otherwise(back(t))), "")


def _wide_turns(m: Mapping, v: Column, record: Column) -> Column:
    """The turns that mapping ``m`` finds in a record whose outline is ``v``: strings come from the record, all else from the outline."""
    fields = F.from_json(record, "map<string,string>", _LONG)

    def leaf(x: Column, path: str, told: Column) -> Column:
        s = F.try_variant_get(x, f"$.{path}", "string")
        return F.when(s == "", told).otherwise(s)  # no leaf but a string is empty

    if m.row:
        at, role, text = m.row
        return F.array(F.struct(leaf(v, at, fields[at]).try_cast("bigint").alias("ord"), leaf(v, role, fields[role]).alias("role"), leaf(v, text, fields[text]).alias("text")))
    if m.turns:
        items = F.from_json(fields[m.turns], "array<map<string,string>>", _LONG)

        def one(both: Column, i: Column) -> Column:
            x, told = both["x"], both["told"]
            return F.struct(i.cast("bigint").alias("ord"), leaf(x, m.role, told[m.role]).alias("role"), leaf(x, m.text, told[m.text]).alias("text"))

        return F.transform(F.arrays_zip(F.try_variant_get(v, f"$.{m.turns}", "array<variant>").alias("x"), items.alias("told")), one)
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(role).alias("role"), leaf(v, path, fields[path]).alias("text")) for i, (role, path) in enumerate(m.fixed)])


def _parsed(record: Column) -> Column:
    """The variant whose field paths are the record's: the record itself, or its outline where it is wide; null if it isn't JSON."""
    wide = F.length(record) > WIDE
    whole = F.from_json(record, "map<string,string>", _LONG).isNotNull()
    return F.when(wide, F.when(whole, F.try_parse_json(outline(record)))).otherwise(F.try_parse_json(F.when(~wide, record)))


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, ord, sub, role, text) for each turn of ``records`` (id, record: JSON text)."""
    parsed = records.select("id", "record", _parsed(F.col("record")).alias("v")).withColumn("paths", fingerprint(F.col("v")))
    wide = F.length("record") > WIDE
    chosen = F.lit(None).cast(f"array<{TURN}>")
    for m in reversed(mappings):
        turns = F.when(wide, _wide_turns(m, F.col("v"), F.col("record")).cast(f"array<{TURN}>")).otherwise(_from_variant(m, F.col("v")).cast(f"array<{TURN}>"))
        if m.roles:
            turns = F.transform(turns, _renamed(dict(m.roles)))
        chosen = F.when(F.col("paths") == F.sha2(F.lit(_paths_of(m.example)), 256), turns.cast(f"array<{TURN}>")).otherwise(chosen)
    return parsed.select("id", F.inline(chosen.cast(f"array<{TURN}>"))).select("id", "ord", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _message(m: Mapping):
    def one(x: Column, i: Column) -> Column:
        return F.struct(i.cast("bigint").alias("ord"), F.try_variant_get(x, f"$.{m.role}", "string").alias("role"), F.try_variant_get(x, f"$.{m.text}", "string").alias("text"))

    return one


def _renamed(names: dict[str, str]):
    def one(t: Column) -> Column:
        role = t["role"]
        for old, new in names.items():
            role = F.when(t["role"] == old, F.lit(new)).otherwise(role)
        return F.struct(t["ord"].alias("ord"), role.alias("role"), t["text"].alias("text"))

    return one


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records that aren't JSON (null paths) or whose fingerprint selects no mapping."""
    known = [F.sha2(F.lit(_paths_of(m.example)), 256) for m in mappings]
    paths = common.free_name(records.columns, "paths")
    parsed = records.withColumn(paths, field_paths(_parsed(F.col("record"))))
    return parsed.where(F.col(paths).isNull() | ~F.sha2(paths, 256).isin(*known))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, loss) for each id: the templated text and the spans under the loss mask.

    A span is the escaped text of a turn whose role is in ``learn``, in code points.
    """
    pieces = turns.select("id", "ord", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    pieces = pieces.select("id", "ord", "role", "text", F.col("role").isin(*learn).alias("loss"), F.concat(F.lit(START), "r", F.lit(SEP)).alias("head"), "x")
    pieces = pieces.withColumn("size", F.length("head") + F.length("x") + len(END))
    order = Window.partitionBy("id").orderBy("ord", "role", "text")
    placed = pieces.select("id", "head", "x", "loss", "size", F.row_number().over(order).alias("n"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    placed = placed.withColumn("to", F.col("stop") - len(END)).withColumn("from", F.col("to") - F.length("x"))
    whole = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat("head", "x", F.lit(END)).alias("piece"), "loss", "from", "to"))).alias("p"))
    spans = F.transform(F.filter("p", lambda p: p["loss"]), lambda p: F.struct(p["from"].cast("int").alias("start"), p["to"].cast("int").alias("end")))
    return whole.select("id", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The array of struct(role, text) that a formatted text holds."""
    pieces = F.split(formatted, re.escape(START))
    parts = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(p: Column) -> Column:
        halves = F.split(F.left(p, F.length(p) - F.lit(len(END))), re.escape(SEP))
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What op9 returns, read back from ``formatted`` (id, formatted, loss)."""
    read = formatted.select("id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss")).alias("l"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("id").alias("conv_id"), F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each row a record, and conversation -1, a record of messages: formatted and read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    message = lambda role: F.struct(F.lit(role).alias("role"), said.alias("content"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.to_json(F.struct(F.array(message("user"), message("assistant")).alias("messages"))).alias("record"))
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    records = rows.select(F.col("conv_id").alias("id"), F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return digest(format_turns(canonical_turns(records.unionByName(extra))))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT conv_id, turn, role, text,
    length(regexp_replace(replace(role, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', '\0#', 'g')) AS r,
    length(regexp_replace(replace(text, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', '\0#', 'g')) AS x
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + r + 10 + x + 10) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

"""Chat formatting by schema fingerprints, in built-in functions alone.

A record's nested field paths, without scalar types, are hashed; the hash selects a declarative mapping (one SQL
expression) that turns the record's layout into canonical turns, an array of (role, text). Turns are then written with
a template whose control strings are escaped inside roles and texts, reversibly, and read back with built-in functions.

    <s>[INST]role[/INST]text</s>    one turn
    <\\s>  [\\INST]  ...             a control string inside a text: one backslash more than it had
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """name; the nested field paths of a record; a SQL expression over the variant column ``r`` that gives its turns.

    Records that are one turn of a conversation each also say where the conversation's id and the turn's place are.
    """

    name: str
    paths: str
    turns: str
    conversation: str | None = None
    place: str | None = None

    @property
    def fingerprint(self) -> Column:
        return F.sha2(F.lit(self.paths), 256)


def _pair(user: str, assistant: str, system: str | None = None) -> str:
    turn = lambda role, path: f"named_struct('role', '{role}', 'text', variant_get(r, '$.{path}', 'string'))"
    first = [f"filter(array({turn('system', system)}), x -> coalesce(x.text, '') <> '')"] if system else []
    return f"concat({', '.join([*first, f'array({turn('user', user)}, {turn('assistant', assistant)})'])})"


def _messages(path: str, role: str, text: str, roles: str = "x.role") -> str:
    got = f"variant_get(r, '$.{path}', 'array<struct<{role}:string,{text}:string>>')"
    return f"transform({got}, m -> named_struct('role', {roles.replace('x.role', f'm.`{role}`')}, 'text', m.`{text}`))"


_SPEAKERS = "CASE x.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.role END"
#: Known layouts; a record with other paths has no turns and the layout ``unknown``.
LAYOUTS = (
    Layout("prompt and completion", "OBJECT<completion, prompt>", _pair("prompt", "completion")),
    Layout("prompt and response", "OBJECT<prompt, response>", _pair("prompt", "response")),
    Layout("question and answer", "OBJECT<answer, question>", _pair("question", "answer")),
    Layout("system, question, response", "OBJECT<question, response, system_prompt>", _pair("question", "response", "system_prompt")),
    Layout("instruction and output", "OBJECT<instruction, output>", _pair("instruction", "output")),
    Layout(
        "instruction, input, output",
        "OBJECT<input, instruction, output>",
        "array(named_struct('role', 'user', 'text', concat_ws('\\n', variant_get(r, '$.instruction', 'string'), nullif(variant_get(r, '$.input', 'string'), ''))), named_struct('role', 'assistant', 'text', variant_get(r, '$.output', 'string')))",
    ),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _messages("messages", "role", "content")),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _messages("conversations", "from", "value", _SPEAKERS)),
    Layout("turns", "OBJECT<turns: ARRAY<OBJECT<role, text>>>", _messages("turns", "role", "text")),
)


def _turn(conversation: str, place: str, role: str, text: str) -> Layout:
    turns = f"array(named_struct('role', variant_get(r, '$.{role}', 'string'), 'text', variant_get(r, '$.{text}', 'string')))"
    return Layout(f"a turn of {conversation}", f"OBJECT<{', '.join(sorted((conversation, place, role, text)))}>", turns, conversation, place)


#: Records of one turn each, as rows of a table are.
TURN_LAYOUTS = (_turn("conv_id", "turn", "role", "text"), _turn("conversation_id", "position", "role", "content"), _turn("conversation_id", "turn", "speaker", "message"))
_SCALARS = "STRING|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|VOID|VARIANT|DECIMAL\\(\\d+,\\s*\\d+\\)"


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, as ``Layout.paths`` writes them."""
    return F.regexp_replace(F.schema_of_variant(record), f": ({_SCALARS})(?=[,>])", "")


def canonical(records: DataFrame, json: str = "record") -> DataFrame:
    """``records`` with ``fingerprint``, ``layout``, ``conversation``, ``place`` and ``turns`` from a column of JSON texts.

    Broken JSON and null have a null fingerprint; these and records of unknown layouts have the layout ``unknown`` and null
    turns. Nulls inside turns become empty when they are written. Only records of one turn have a conversation and a
    place. Records keep their other columns.
    """
    read = records.withColumn("r", F.try_parse_json(F.col(json)))
    read = read.withColumn("fingerprint", F.sha2(field_paths(F.col("r")), 256))
    out = {"layout": F.lit("unknown"), "conversation": F.lit(None).cast("long"), "place": F.lit(None).cast("long"), "turns": F.lit(None).cast(TURNS)}
    for x in (*LAYOUTS, *TURN_LAYOUTS):
        this = F.col("fingerprint") == x.fingerprint
        out["layout"] = F.when(this, x.name).otherwise(out["layout"])
        out["turns"] = F.when(this, F.expr(x.turns).cast(TURNS)).otherwise(out["turns"])
        if x.conversation:
            for name, path in (("conversation", x.conversation), ("place", x.place)):
                out[name] = F.when(this, F.try_variant_get("r", f"$.{path}", "long")).otherwise(out[name])
    return read.withColumns(out).drop("r")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table with a row for each turn: each row is a record, whose fingerprint selects its mapping.

    Columns that no layout of a turn has beside the others are left out of the record. Turns are ordered by position,
    then role and text, nulls first; rows that repeat a position are turns of their own. A null conversation id is one
    conversation. A conversation is one record of the result, so it is as large as that record. A row of over 128 MB, which
    is more than a variant holds, and a text that is no string raise an error; nothing is dropped.
    """
    paths = [x.paths.removeprefix("OBJECT<").removesuffix(">").split(", ") for x in TURN_LAYOUTS]
    columns = next((names for names in paths if set(names) <= set(rows.columns)), None)
    if columns is None:
        raise ValueError(f"no layout of a turn in columns {sorted(rows.columns)}; known: {paths}")
    records = rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record"))
    known = F.when(F.col("layout") != "unknown", F.col("turns")).otherwise(F.raise_error(F.lit("a row that is no turn of a known layout, or over a variant's 128 MB")))
    each = canonical(records).select("conversation", F.explode(known).alias("turn"), "place")
    one = F.struct(F.col("place").alias("at"), F.col("turn.role").alias("role"), F.col("turn.text").alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    return each.groupBy(F.col("conversation").alias("conv_id")).agg(turns.alias("turns"))


_CONTROL = "(s>|/s>|INST\\]|/INST\\])"


def escaped(text: Column) -> Column:
    """The text with one more backslash in everything that looks like a control string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def formatted(turns: Column) -> Column:
    """The turns as one text; null turns give null."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<s>[INST]"), escaped(x.role), F.lit("[/INST]"), escaped(x.text), F.lit("</s>"))), "")


def _pieces(text: Column) -> Column:
    """What stands between the turn marks: (role, text), still escaped."""
    pieces = F.filter(F.split(text, "</s>", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, r"(?s)^<s>\[INST\](.*?)\[/INST\]", 1).alias("role"), F.regexp_replace(x, r"(?s)^<s>\[INST\].*?\[/INST\]", "").alias("text")))


def parsed(text: Column) -> Column:
    """The turns of a formatted text, unescaped; what ``formatted`` was given, with nulls as empty texts."""
    return F.transform(_pieces(text), lambda x: F.struct(unescaped(x.role).alias("role"), unescaped(x.text).alias("text")))


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """(start, length) in code points of the formatted text, for each text that a model is to learn."""
    mark = len("<s>[INST][/INST]")
    start = F.aggregate(
        _pieces(text),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + mark + F.length(x.role) + F.length(x.text) + len("</s>")).alias("at"),
            F.when(unescaped(x.role) == role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + mark + F.length(x.role)).alias("start"), F.length(x.text).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return start["spans"]


def chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from (conv_id, turns)."""
    return turns.withColumn("formatted", formatted(F.col("turns"))).select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: turns by their marks, learned text by the loss spans."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(s.start + 1, s.length))), "")
    back = chats.withColumns({"turns": parsed(F.col("formatted")), "loss": loss})
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation of control strings, added to every run of the query.
PROBE = r"SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"

SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
